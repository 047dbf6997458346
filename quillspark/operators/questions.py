"""Enrichment of question tables: aliases, terms, intents, facets, frames. Rules are parameters."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.functions import text as T
from quillspark.operators.inventory import AUTOMATON_CHARS, containment, ordered, term_machine
from quillspark.operators.ordinals import ordinals
from quillspark.operators.retrieval import by_rarity, prefix_candidates
from quillspark.sources.scratch import fits, measured_bytes, small, written

# fixed values: thresholds of intent resolution
SURE, HIGH, CLOSE, SECOND = 0.65, 0.9, 0.15, 0.5
SAME_QUESTION, LIKE_QUESTION, RELEVANT = 0.97, 0.86, 0.18
VOTE, VOTE_SCORE = 0.74, 3.0
#: Bytes of the items' words up to which they go to the tasks, and characters of expanded questions that a task hands on at once.
ITEM_BYTES, TEXT_CHARS = 150_000_000, 4_000_000
#: Labelled examples up to which every task holds a question against each of them, from INDEXED on.
FEW_EXAMPLES = 5000
#: Labelled examples that all questions meet at once.
EXAMPLE_BLOCK = 500
#: Similarity from which pairs are taken from an index; below it nearly all pairs are results.
INDEXED = 0.6


class _Folded(dict):
    """Code points to those that stand for them whatever the case, one for one."""

    def __missing__(self, code: int) -> str:
        upper = chr(code).upper()
        low = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = low if len(low) == 1 else chr(code)
        return self[code]


_folded = _Folded()


def _rewrite(text: str, entries: list[tuple[str, str]], machine: ahocorasick.Automaton) -> str:
    """Each pass of the automaton finds the next alias in order that occurs; those in between cannot fire, so they are not tried."""
    at = 0
    while True:
        low = text.translate(_folded)
        here = {id(ranks): ranks for _, ranks in machine.iter(low)}
        nexts = [ranks[i] for ranks in here.values() if (i := bisect_left(ranks, at)) < len(ranks)]
        if not nexts:
            return text
        alias, canonical = entries[min(nexts)]
        out, start = [], 0
        while (found := low.find(alias, start)) >= 0:
            out += [text[start:found], canonical]
            start = found + len(alias)
        text, at = "".join([*out, text[start:]]), min(nexts) + 1


def _rewritten(rows: DataFrame, column: str, part: DataFrame) -> DataFrame:
    """rows with the aliases of a part (alias, canonical, n) of bounded size replaced in column, in the order of n."""
    entries = [(r["alias"].translate(_folded), r["canonical"]) for r in part.orderBy("n").collect()]
    named: dict[str, list[int]] = {}
    for rank, (alias, _) in enumerate(entries):
        named.setdefault(alias, []).append(rank)
    shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, named, entries))
    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, named, entries = shared.value
        for batch in batches:
            if named:
                machine = term_machine(key, named)
                texts = [None if t is None else _rewrite(t, entries, machine) for t in batch.column(place).to_pylist()]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def alias_order(aliases: DataFrame) -> DataFrame:
    """(alias, canonical, n): usable rows of an alias table, numbered from 0, the longest alias first, then by alias and canonical."""
    usable = aliases.select("alias", "canonical").where("alias != '' AND canonical != ''").distinct()
    rows = ordinals(usable, [], [F.desc(F.length("alias")), F.col("alias"), F.col("canonical")], "n")
    return written(rows.select("alias", "canonical", (F.col("n") - 1).alias("n")), "aliases")


def rewrite_aliases(questions: DataFrame, aliases: DataFrame, column: str = "text", part_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """questions with the aliases of (alias, canonical) replaced in column, whatever the case, and white space compacted.

    The result is that of literal replacements one after the other, longest alias first (alias_order), so
    later aliases see what earlier ones wrote. Each task holds an automaton of the aliases: a pass over
    the text names the next alias that can fire, and only those are folded in. The table is cut, in its order,
    into parts of about part_chars characters, one step of the plan each, however many aliases there are.
    Null and empty aliases and canonicals are left out, null texts stay null.
    """
    return _in_order(questions, alias_order(aliases), column, part_chars)


def _in_order(questions: DataFrame, numbered: DataFrame, column: str, part_chars: int) -> DataFrame:
    """rewrite_aliases() by a table of alias_order()."""
    n, longest = numbered.agg(F.count(F.lit(1)), F.max(F.length("alias"))).first()
    each = max(1, part_chars // (longest or 1))
    rows = questions.withColumn(column, T.drop_controls(F.col(column)))
    for start in range(0, n, each):
        rows = _rewritten(rows, column, numbered.where((F.col("n") >= start) & (F.col("n") < start + each)))
    return rows.withColumn(column, T.compact_whitespace(F.col(column)))


def find_terms(questions: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, term, ord): canonical terms inside rewritten questions, residual aliases first, then longest terms; aliases: alias, canonical."""
    numbered = alias_order(aliases)
    rows = _in_order(questions.select(F.col("qid").alias("id"), "text"), numbered, "text", AUTOMATON_CHARS)
    alias_rows = numbered.withColumnRenamed("alias", "term")
    named = terms.select("term").distinct().join(small(alias_rows.select("term", "canonical")), "term", "left").select("term", F.coalesce("canonical", "term").alias("canonical"), F.struct(F.lit(1).alias("src"), (-F.length("term")).cast("long").alias("n"), F.col("term").alias("t")).alias("at"))
    every = alias_rows.select("term", "canonical", F.struct(F.lit(0).alias("src"), F.col("n"), F.col("term").alias("t")).alias("at")).unionByName(named)
    hits = containment(rows, every.select("term")).join(every, "term").groupBy("id", "canonical").agg(F.min("at").alias("at"))
    return ordered(hits, ["id"], F.col("at"), F.col("canonical")).select(F.col("id").alias("qid"), F.col("canonical").alias("term"), "ord")


def _item_words(items: DataFrame) -> DataFrame:
    """term, ord, all words of an item, how many of those behind term and layer one hop shows, and where its related terms begin and end."""
    none = F.array().cast("array<string>")
    full = F.concat(F.array("term", "layer"), "properties", "mechanisms", "forms", "related", F.when(F.col("response") != "", F.array("response")).otherwise(none))
    shown = F.size("properties") + F.size("mechanisms")
    return items.select("term", "ord", full.alias("words"), shown.alias("shown"), (2 + shown + F.size("forms")).alias("first"), F.size("related").alias("n"))


def expand_query(questions: DataFrame, found: DataFrame, items: DataFrame, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """(qid, text): the question with the fields of items whose term was found, and one hop over related terms with fewer fields.

    Items of at most most_bytes (measured) go to the tasks with their words as numbers, and a task writes each question's text from
    its terms: the words of an item, which many questions show, are not shuffled. Beyond it they are joined and grouped by question.
    """
    slim = written(_item_words(items), "item-words")
    if measured_bytes(slim) > most_bytes:
        return questions.join(_joined_words(found, slim), "qid", "left").select("qid", T.compact_whitespace(F.concat_ws(" ", "text", "more")).alias("text"))
    terms = found.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    rows = questions.join(terms, "qid", "left").select("qid", T.compact_whitespace(F.col("text")).alias("text"), "terms")
    return _written_out(rows, slim)


def _joined_words(found: DataFrame, slim: DataFrame) -> DataFrame:
    """(qid, more): the words of expand_query() by joins."""
    hop = F.concat(F.slice("words", 1, 1), F.slice("words", F.lit(3), F.col("shown")))
    own = found.select("qid", "term").join(slim, "term")
    first = own.select("qid", F.struct(F.lit(0).alias("level"), "ord").alias("at"), "words")
    related = own.select("qid", F.explode(F.slice("words", F.col("first") + 1, F.col("n"))).alias("term")).distinct().join(found.select("qid", "term"), ["qid", "term"], "left_anti")
    second = related.join(slim, "term").select("qid", F.struct(F.lit(1).alias("level"), "ord").alias("at"), hop.alias("words"))
    words = first.unionByName(second).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("xs"))
    return words.select("qid", F.array_join(F.array_distinct(F.filter(F.flatten(F.transform("xs", lambda x: x["words"])), lambda w: w != "")), " ").alias("more"))


def _compacted(text: str | None) -> str:
    """T.compact_whitespace() of a text."""
    return re.sub(f"[{T.WHITE}]+", " ", re.sub(T.CONTROL, "", text or "").replace("\u3000", " ")).strip(T.WHITE)


def _written_out(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """(qid, text) of (qid, text, terms): each text, compacted already, with the words of its terms' items of _item_words()."""
    table = slim.orderBy("ord").toArrow().combine_chunks()
    lists = table.column("words").combine_chunks() if isinstance(table.column("words"), pa.ChunkedArray) else table.column("words")
    coded = lists.flatten().dictionary_encode()
    # equal words are one, however they are written out
    raw = coded.dictionary.to_pylist()
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    of_term: dict[str, list[int]] = {}
    for at, term in enumerate(table.column("term").to_pylist()):
        of_term.setdefault(term, []).append(at)
    places = {term: np.array(at, np.int32) for term, at in of_term.items()}
    numbers = coded.indices.fill_null(-1).to_numpy().astype(np.int32)
    counts = [table.column(c).to_numpy().astype(np.int32) for c in ("shown", "first", "n")]
    shared = rows.sparkSession.sparkContext.broadcast((raw, [_compacted(w) for w in raw], numbers, starts, places, *counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, clean, numbers, starts, places, shown, first, n_related = shared.value

        def more(terms: list[str]) -> list[str]:
            own = [places[t] for t in terms if t in places]
            if not own:
                return []
            # by ord, as the items are
            own = np.sort(np.concatenate(own))
            parts = [numbers[starts[i] : starts[i + 1]] for i in own]
            related = {raw[w] for i in own if n_related[i] for w in numbers[starts[i] + first[i] : starts[i] + first[i] + n_related[i]] if w >= 0}
            second = [places[t] for t in related.difference(terms) if t in places]
            for i in np.sort(np.concatenate(second)) if second else ():
                parts += [numbers[starts[i] : starts[i] + 1], numbers[starts[i] + 2 : starts[i] + 2 + shown[i]]]
            every = np.concatenate(parts)
            _, at = np.unique(every, return_index=True)
            return [clean[w] for w in every[np.sort(at)].tolist() if w >= 0 and clean[w]]

        for batch in batches:
            ids, texts, begin, chars = batch.column(0), [], 0, 0
            for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(" ".join([*([text] if text else []), *more(terms or [])]))
                chars += len(texts[-1])
                if chars >= TEXT_CHARS:
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), pa.array(texts, pa.string())], ["qid", "text"])
                    texts, begin, chars = [], begin + len(texts), 0
            if texts:
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), pa.array(texts, pa.string())], ["qid", "text"])

    return rows.mapInArrow(run, StructType([rows.schema["qid"], StructField("text", StringType())]))


@dataclass
class IntentRule:
    """A score for an intent where all patterns match and none of the others does."""

    intent: str
    score: float
    reason: str
    every: list[str] = field(default_factory=list)
    none: list[str] = field(default_factory=list)
    image: bool | None = None


def score_intents(questions: DataFrame, rules: list[IntentRule]) -> DataFrame:
    """(qid, intent, score, reason): best score of each intent, first reason on ties; questions: qid, text, images."""
    hits = []
    for i, rule in enumerate(rules):
        ok = F.lit(True)
        for pattern in rule.every:
            ok = ok & F.col("text").rlike(pattern)
        for pattern in rule.none:
            ok = ok & ~F.col("text").rlike(pattern)
        if rule.image is not None:
            ok = ok & ((F.col("images") > 0) == F.lit(rule.image))
        hits.append(F.when(ok, F.struct(F.lit(rule.intent).alias("intent"), F.lit(rule.score).alias("score"), F.lit(-i).alias("first"), F.lit(rule.reason).alias("reason"))))
    rows = questions.select("qid", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    best = rows.groupBy("qid", "h.intent").agg(F.max(F.struct("h.score", "h.first", "h.reason")).alias("b"))
    return best.select("qid", "intent", F.col("b.score").alias("score"), F.col("b.reason").alias("reason"))


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), T.strip(F.col("text")).alias("text")).where("text != ''")


def _grams(rows: DataFrame) -> DataFrame:
    return rows.select("id", T.bigrams(F.col("text")).alias("tokens"))


def _characters(rows: DataFrame) -> DataFrame:
    """(id, tokens): each character as often as it occurs, with the number of its occurrence: what two texts have in common is what their sets share."""
    each = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("c")).groupBy("id", "c").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return each.groupBy("id").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.col("c"), k.cast("string"))))).alias("tokens"))


def similar_candidates(questions: DataFrame, examples: DataFrame, least: float) -> DataFrame:
    """(qid, eid): every pair that may be as similar as least, by an index on bigrams and on counted characters.

    Dice over bigrams of d is a Jaccard of d / (2 - d). A sequence ratio of r needs r / 2 of both
    lengths in common characters, which is the same condition on the sets of counted characters.
    """
    jaccard = least / (2 - least)
    pairs = None
    for sets in (_grams, _characters):
        sides = by_rarity(sets(_texts(examples, "eid")), sets(_texts(questions, "qid")))
        met = prefix_candidates(*sides, jaccard).select(F.col("b").alias("qid"), F.col("a").alias("eid"))
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


def _similar_in_tasks(questions: DataFrame, examples: DataFrame, least: float) -> DataFrame:
    """example_similarity() of examples that every task gets: Dice from lists of them by bigram, the ratio where lengths, counted characters and the longest common subsequence allow it."""
    rows = [(r["eid"], text) for r in examples.collect() if (text := (r["text"] or "").strip(T.WHITE))]
    shared = questions.sparkSession.sparkContext.broadcast(rows)
    kind = examples.select("eid").limit(0).toArrow().schema.field(0).type
    schema = StructType([questions.schema["qid"], examples.schema["eid"], StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, rows = re.compile(f"[{T.WHITE}]+"), shared.value

        def grams(text: str) -> set[str]:
            bare = white.sub("", text)
            return {bare[i : i + 2] for i in range(len(bare) - 1)} if len(bare) > 1 else {bare}

        texts = [text for _, text in rows]
        sizes, lists = np.array([len(t) for t in texts]), {}
        for e, text in enumerate(texts):
            for gram in grams(text):
                lists.setdefault(gram, []).append(e)
        n_grams = np.array([len(grams(t)) for t in texts])
        lists = {gram: np.array(found) for gram, found in lists.items()}
        column = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        counts = np.zeros((len(texts), len(column)), np.int32)
        for e, text in enumerate(texts):
            np.add.at(counts[e], [column[c] for c in text], 1)
        for batch in batches if texts else []:
            at, found, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = (text or "").strip(T.WHITE)
                if not text:
                    continue
                own = grams(text)
                met = [lists[g] for g in own if g in lists]
                best = 2.0 * (np.bincount(np.concatenate(met), minlength=len(texts)) if met else np.zeros(len(texts))) / (len(own) + n_grams)
                bar = least * (len(text) + sizes) - 1e-9
                likely = np.flatnonzero(2.0 * np.minimum(sizes, len(text)) >= bar)
                mine = np.bincount([column[c] for c in text if c in column], minlength=len(column))
                likely = likely[2.0 * np.minimum(counts[likely], mine).sum(axis=1) >= bar[likely]]
                for e in likely:
                    best[e] = max(best[e], T.ratio_from(text, texts[e], least))
                kept = np.flatnonzero(best >= least)
                at += [i] * len(kept)
                found += [rows[e][0] for e in kept]
                values += best[kept].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, kind), pa.array(values, pa.float64())], ["qid", "eid", "similarity"])

    return questions.mapInArrow(run, schema)


def example_similarity(questions: DataFrame, examples: DataFrame, least: float = RELEVANT) -> DataFrame:
    """(qid, eid, similarity) from least on: the larger of bigram Dice and sequence ratio, exactly.

    From INDEXED on, at most FEW_EXAMPLES go to every task, which counts what a question shares with each; of more of
    them, pairs come from an index (similar_candidates) and few are generated. Below it nearly
    every pair is a result; the labelled examples are a stated set, and all questions meet it in blocks of
    EXAMPLE_BLOCK rows. The ratio is reckoned only where its bounds by length and by common characters
    reach least. Ids are unique; null and blank texts are like nothing.
    """
    # ratios take milliseconds each: few questions of one file are still spread over all cores
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if least >= INDEXED:
        few = written(examples.select("eid", "text"), "example-texts")
        if few.count() <= FEW_EXAMPLES and fits(few):
            return _similar_in_tasks(questions.select("qid", "text").repartition(tasks, "qid"), few, least)
        pairs = similar_candidates(questions, examples, least)
        rows = pairs.join(small(examples.select("eid", F.col("text").alias("example"))), "eid").join(questions.select("qid", "text"), "qid").repartition(tasks, "qid")
        return T.text_similarity(rows, "text", "example", "similarity", least).select("qid", "eid", "similarity")
    # bigrams are made once a text, not once a pair
    numbered = written(examples.select("eid", "text", T.bigrams(F.col("text")).alias("grams")).where("text is not null"), "examples")
    asked = questions.select("qid", "text").repartition(tasks, "qid").withColumn("own", T.bigrams(F.col("text")))
    blocks = max(1, -(-numbered.count() // EXAMPLE_BLOCK))
    found = None
    for i in range(blocks):
        block = numbered.where(F.pmod(F.xxhash64("eid"), F.lit(blocks)) == i).agg(F.collect_list(F.struct("eid", F.col("text").alias("example"), "grams")).alias("examples"))
        pairs = asked.join(F.broadcast(block)).select("qid", "text", "own", F.explode("examples").alias("e")).select("qid", "text", "own", "e.eid", "e.example", "e.grams")
        near = T.text_similarity(pairs, "text", "example", "similarity", least, ("own", "grams")).select("qid", "eid", "similarity")
        found = near if found is None else found.unionByName(near)
    return found


def nearest_examples(questions: DataFrame, examples: DataFrame, k: int = 6, least: float = RELEVANT, levels: tuple[float, ...] = ()) -> DataFrame:
    """(qid, eid, similarity, rank): the k most similar examples from least on, ties to the first.

    With levels the bar goes down one by one. A question with k examples above a bar is done, as all its pairs
    above it are known; only the others meet the examples again below it. That pays where many questions
    have k near twins, and costs a pass over the index where they have none.
    """
    still, found = written(questions.select("qid", "text"), "questions"), []
    for level in levels:
        if level <= least or still.isEmpty():
            continue
        near = written(example_similarity(still, examples, level), "near-examples")
        done = near.groupBy("qid").count().where(F.col("count") >= k).select("qid")
        found.append(near.join(done, "qid", "left_semi"))
        still = written(still.join(done, "qid", "left_anti"), "questions")
    found.append(example_similarity(still, examples, least))
    return relevant_examples(reduce(DataFrame.unionByName, found), k)


def score_by_examples(similar: DataFrame, examples: DataFrame) -> DataFrame:
    """(qid, intent, score) of the best example from LIKE_QUESTION on, ties to the first."""
    best = ordered(similar.where(F.col("similarity") >= LIKE_QUESTION), ["qid"], F.desc("similarity"), F.col("eid"), name="n").where("n = 1")
    return best.join(examples.select("eid", "intent"), "eid").select("qid", "intent", F.when(F.col("similarity") >= SAME_QUESTION, 0.995).otherwise(0.95).alias("score"))


def relevant_examples(similar: DataFrame, k: int = 6) -> DataFrame:
    return ordered(similar, ["qid"], F.desc("similarity"), F.col("eid"), name="rank").where(F.col("rank") <= k)


def score_by_retrieval(hits: DataFrame, intents: DataFrame, k: int = 5) -> DataFrame:
    """(qid, intent, score): layers of the first k hits from VOTE_SCORE on vote for their intent."""
    votes = hits.where((F.col("rank") <= k) & (F.col("score") >= VOTE_SCORE)).join(F.broadcast(intents), "layer")
    return votes.select("qid", "intent").distinct().withColumn("score", F.lit(VOTE))


def mechanism_gate(found: DataFrame, buckets: DataFrame, hits: DataFrame, layer: str = "mechanism", k: int = 3) -> DataFrame:
    """qids with a found term of the buckets and one of their first k hits of the layer from VOTE_SCORE on."""
    named = found.join(buckets.select("term").distinct(), "term", "left_semi").select("qid").distinct()
    good = hits.where((F.col("rank") <= k) & (F.col("layer") == layer) & (F.col("score") >= VOTE_SCORE)).select("qid").distinct()
    return named.join(good, "qid", "left_semi")


def resolve_intent(questions: DataFrame, candidates: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(qid, intent, confidence, n_candidates, needs_clarification) from (qid, intent, score, ord)."""
    ranked = ordered(candidates, ["qid"], F.desc("score"), F.col("ord"), name="n").where("n <= 4")
    top = ranked.groupBy("qid").agg(F.max(F.when(F.col("n") == 1, F.col("intent"))).alias("intent"), F.max("score").alias("confidence"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_candidates"))
    rows = questions.select("qid").join(top, "qid", "left")
    rows = rows.join(missing, ["qid", "intent"], "left") if missing is not None else rows.withColumn("missing", F.lit(0))
    close = (F.col("confidence") < HIGH) & (F.col("confidence") - F.col("second") < CLOSE - 1e-12)
    unclear = F.col("intent").isNull() | (F.col("confidence") < SURE) | F.coalesce(close, F.lit(False)) | (F.coalesce("missing", F.lit(0)) > 0)
    return rows.select("qid", "intent", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), unclear.alias("needs_clarification"))


def ambiguous_options(questions: DataFrame, candidates: DataFrame, labels: DataFrame, k: int = 4) -> DataFrame:
    """(qid, ord, label, value): options of questions whose first two candidates are close and strong enough."""
    ranked = ordered(candidates, ["qid"], F.desc("score"), F.col("ord"), name="n").where(F.col("n") <= k)
    pair = ranked.groupBy("qid").agg(F.max("score").alias("top"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"))
    unsure = pair.where((F.col("top") < HIGH) & (F.col("top") - F.col("second") < CLOSE - 1e-12) & (F.col("second") >= SECOND)).select("qid")
    rows = ranked.join(unsure, "qid", "left_semi").join(questions.select("qid", "text"), "qid").join(F.broadcast(labels), "intent", "left")
    return rows.select("qid", F.col("n").alias("ord"), F.coalesce("label", "intent").alias("label"), F.concat(F.lit("[intent:"), "intent", F.lit("]"), "text").alias("value"))


def clarification_question(questions: DataFrame, candidates: DataFrame, labels: DataFrame, missing_texts: dict[str, str], general: str, several: str, repeat_note: str, k: int = 3) -> DataFrame:
    """(qid, question) to ask back, for (qid, missing, asked): what is missing for the first candidate's intent, else the first k readings, else a general text.

    several holds {options}; each option is its label with the reason. From the second repeat on
    (asked counts earlier questions) the note comes first.
    """
    ranked = ordered(candidates, ["qid"], F.desc("score"), F.col("ord"), name="n").where(F.col("n") <= k).join(F.broadcast(labels), "intent", "left")
    option = F.concat(F.coalesce("label", "intent"), F.lit("("), "reason", F.lit(")"))
    lists = ranked.groupBy("qid").agg(F.min(F.struct("n", "intent")).alias("top"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", option.alias("o")))), lambda x: x["o"]), ", ").alias("options"))
    rows = questions.select("qid", "missing", "asked").join(lists, "qid", "left")
    special = F.lit(None).cast("string")
    for intent, text in missing_texts.items():
        special = F.when(F.col("missing") & (F.col("top.intent") == intent), F.lit(text)).otherwise(special)
    before, after = several.split("{options}")
    listed = F.concat(F.lit(before), "options", F.lit(after))
    note = F.when(F.col("asked") >= 2, F.lit(repeat_note)).otherwise(F.lit(""))
    return rows.select("qid", F.concat(note, F.coalesce(special, listed, F.lit(general))).alias("question"))


def detect_layers(questions: DataFrame, hits: DataFrame, intent_layers: dict[str, str], keywords: list[tuple[str, str]], k: int = 8) -> DataFrame:
    """(qid, layers): known layers of the hits in order, then the intent's, then those that keywords imply."""
    known = hits.where((F.col("rank") <= k) & (F.col("layer") != "unknown")).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "layer"))), lambda x: x["layer"]).alias("seen"))
    mapped = F.create_map(*[F.lit(x) for pair in intent_layers.items() for x in pair])[F.col("intent")]
    implied = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(layer)) for p, layer in keywords]))
    rows = questions.join(known, "qid", "left")
    layers = F.array_distinct(F.concat(F.coalesce("seen", F.array().cast("array<string>")), F.array_compact(F.array(mapped)), implied))
    return rows.select("qid", F.when(F.size(layers) > 0, layers).otherwise(F.array(F.lit("unknown"))).alias("layers"))


def detect_focus(text: Column, buckets: list[tuple[str, list[str]]], default: list[str]) -> Column:
    hit = F.array_compact(F.array(*[F.when(F.greatest(*[text.contains(k) for k in keys], F.lit(False)), F.lit(name)) for name, keys in buckets]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(*map(F.lit, default)))


def compare_targets(text: Column, terms: Column, separators: list[str], k: int = 4) -> Column:
    """First k terms if there are two; else the parts between separators, then the terms."""
    parts = F.flatten(F.array(*[F.when(text.contains(s), F.filter(F.transform(F.split(text, re.escape(s)), lambda p: F.regexp_replace(p, r"^[ ?？。.]+|[ ?？。.]+$", "")), lambda p: (F.length(p) > 1) & (F.length(p) <= 16))).otherwise(F.array().cast("array<string>")) for s in separators]))
    return F.slice(F.when(F.size(terms) >= 2, terms).otherwise(F.concat(parts, F.array_except(terms, parts))), 1, k)


def blocking_missing(intent: Column, text: Column, images: Column, n_terms: Column, facets_missing: Column) -> Column:
    """Names of what keeps a question from being answered."""
    return F.array_compact(F.array(
        F.when((intent == "case") & (images == 0) & (F.length(text) < 30), F.lit("short case")),
        F.when((intent == "compare") & (n_terms < 2), F.lit("two targets")),
        F.when((intent == "evaluation") & facets_missing, F.lit("design facets")),
    ))


def extract_facets(text: Column, vocabularies: dict[str, list[str]], terms: Column, contexts: list[str], goals: list[str], images: Column) -> dict[str, Column]:
    """Facet columns: vocabulary hits joined with given terms, modality, product context and user goal (first pattern that matches)."""
    low = F.lower(text)

    def among(words: list[str]):
        return lambda t: t.isin(*words)

    out = {name: F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words])), F.filter(terms, among(words)))) for name, words in vocabularies.items()}
    first = lambda patterns: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns], F.lit(""))
    return out | {"modality": F.array_compact(F.array(F.when(images > 0, F.lit("image")), F.when(F.trim(text) != "", F.lit("text")))), "context": first(contexts), "goal": first(goals)}


def missing_and_risks(facets: dict[str, Column], text: Column, co_occurring: list[tuple[str, str, str]], short: int = 40) -> tuple[Column, Column]:
    """(missing, risks): empty facets and a short text; pairs of words that occur together, and one risk if anything is missing."""
    lists = [n for n in facets if n not in ("modality", "context", "goal")]
    missing = F.array_compact(F.array(F.when(F.length(text) < short, F.lit("short description")), *[F.when(facets[n] == "", F.lit(f"no {n}")) for n in ("context", "goal")], *[F.when(F.size(facets[n]) == 0, F.lit(f"no {n}")) for n in lists]))
    risks = F.array_compact(F.array(*[F.when(text.contains(a) & text.contains(b), F.lit(name)) for a, b, name in co_occurring], F.when(F.size(missing) > 0, F.lit("incomplete"))))
    return missing, risks


def clarify_subtype(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(qid, subtype, ask) for questions whose intent has options: the first with a keyword inside, else ask."""
    rows = questions.join(F.broadcast(options), "intent")
    hit = F.when(F.exists("keywords", lambda k: F.contains(F.lower("text"), k)), F.struct("ord", "value"))
    return rows.groupBy("qid").agg(F.min(hit).alias("best")).select("qid", F.col("best.value").alias("subtype"), F.col("best").isNull().alias("ask"))


def merge_candidates(rules: DataFrame, external: DataFrame, valid: list[str], k: int = 5) -> DataFrame:
    """(qid, intent, score, rank): external candidates first, best score of each intent, confidence within [0, 1]; unknown intents go."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    outer = external.where(F.col("intent").isin(*valid)).select("qid", "intent", clamp(F.col("score").try_cast("double")).alias("score"), F.lit(0).alias("src"))
    rows = outer.unionByName(rules.select("qid", "intent", "score", F.lit(1).alias("src")))
    best = rows.groupBy("qid", "intent").agg(F.max("score").alias("score"), F.min("src").alias("src"))
    return ordered(best, ["qid"], F.col("src"), F.desc("score"), F.col("intent"), name="rank").where(F.col("rank") <= k).select("qid", "intent", "score", "rank")


def coerce_bool(value: Column, default: Column) -> Column:
    """true, 1, yes, y and false, 0, no, n whatever the case and blanks around; null gives the default, other texts are true if they are not empty."""
    low = F.lower(F.trim(value))
    return F.when(value.isNull(), default).when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False).otherwise(value != "")


def resolve_external(external: DataFrame, valid: list[str]) -> DataFrame:
    """(qid, intent, confidence, needs_clarification) of a model's answers (qid, intent, score, needs): an unknown intent is null and asks back, a score that is no number is 0, others lie within [0, 1]."""
    intent = F.when(F.col("intent").isin(*valid), F.col("intent"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))))
    rows = external.select("qid", intent.alias("intent"), score.alias("confidence"), F.col("needs").cast("string").alias("needs"))
    needs = F.col("intent").isNull() | coerce_bool(F.col("needs"), (F.col("confidence") < SURE) | F.col("intent").isNull())
    return rows.select("qid", "intent", "confidence", needs.alias("needs_clarification"))


@dataclass
class Design:
    """How questions about a design are read: facet columns by name, what is missing and risky, and the intent that they belong to."""

    intent: str
    facets: dict[str, Column]
    missing: Column
    risks: Column


def parse_questions(questions: DataFrame, resolved: DataFrame, found: DataFrame, focus: list[tuple[str, list[str]]], default_focus: list[str], separators: list[str], compare: str = "compare", open_intent: str = "open",
                    layers: DataFrame | None = None, frames: DataFrame | None = None, corrections: DataFrame | None = None, design: Design | None = None, missing: Column | None = None) -> DataFrame:
    """(qid, structure): all that is known of each question before it is answered.

    questions: qid, text, images and what the columns of design read. layers: qid, layers. frames: qid,
    frame, source, as select_frame gives them. corrections: qid, original, canonical. missing may read
    intent, text, images, terms and design_missing; open questions miss nothing, questions about a design
    what their design misses. A question without an intent is open; without its layers it is unknown;
    without a frame it has none, and its source is that of its intent.
    """
    none = F.array().cast("array<string>")
    terms = found.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("found_terms"))
    rows = questions.join(resolved.select("qid", F.coalesce("intent", F.lit(open_intent)).alias("intent"), "confidence", "needs_clarification"), "qid").join(terms, "qid", "left").withColumn("found_terms", F.coalesce("found_terms", none))
    is_design = F.col("intent") == design.intent if design else F.lit(False)
    facets = F.struct(*[c.alias(n) for n, c in design.facets.items()], design.missing.alias("missing"), design.risks.alias("risks")) if design else F.lit(None).cast("struct<missing:array<string>,risks:array<string>>")
    # facets may read the question's own terms; the answer's come after
    rows = rows.withColumn("design", facets).drop("terms").withColumnRenamed("found_terms", "terms").withColumn("design_missing", F.coalesce("design.missing", none))
    if layers is not None:
        rows = rows.join(layers.select("qid", "layers"), "qid", "left")
    if frames is not None:
        rows = rows.join(frames.select("qid", "frame", F.col("source").alias("frame_source")), "qid", "left")
    if corrections is not None:
        fixed = corrections.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("original", "canonical"))).alias("corrections"))
        rows = rows.join(fixed, "qid", "left")
    has = lambda c, other: F.coalesce(c, other) if c in rows.columns else other
    targets = F.when(F.col("intent") == compare, compare_targets(F.col("text"), F.col("terms"), separators)).otherwise(none)
    seen = F.array_compact(F.array(F.when(F.col("images") > 0, F.lit("image")), F.when(F.trim("text") != "", F.lit("text"))))
    gaps = F.when(F.col("intent") == open_intent, none).when(is_design, F.col("design_missing")).otherwise(none if missing is None else missing)
    source = F.when(F.col("intent") == open_intent, "cot").otherwise("static")
    return rows.select("qid", F.struct(
        F.col("text").alias("raw_query"), "intent", "confidence", "needs_clarification", has("layers", F.array(F.lit("unknown"))).alias("layers"), "terms",
        detect_focus(F.col("text"), focus, default_focus).alias("focus"), targets.alias("compare_targets"), F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit("text"))).alias("case_modality"),
        gaps.alias("missing_info"), has("corrections", F.array().cast("array<struct<original:string,canonical:string>>")).alias("term_corrections"),
        has("frame", none).alias("output_frame"), has("frame_source", source).alias("output_frame_source"), F.when(is_design, F.col("design")).alias("design_evaluation"),
    ).alias("structure"))


def select_frame(questions: DataFrame, static: DataFrame, proposed: DataFrame, mode: str = "auto", fallback: list[str] | None = None) -> DataFrame:
    """(qid, frame, source): a proposed frame of 3 to 8 items for open questions, always, or below 0.8 confidence; else the intent's own."""
    ok = proposed.select("qid", F.filter("items", lambda i: F.trim(i) != "").alias("proposed")).where(F.size("proposed").between(3, 8))
    rows = questions.join(ok, "qid", "left").join(F.broadcast(static), "intent", "left")
    wanted = (F.col("intent") == "open") | F.lit(mode == "always") | (F.lit(mode == "auto") & (F.col("confidence") < 0.8))
    use = F.col("proposed").isNotNull() & wanted
    open_frame = F.array(*map(F.lit, fallback or ["summary", "evidence", "limits", "next steps"]))
    frame = F.when(use, F.col("proposed")).when(F.col("intent") == "open", open_frame).otherwise(F.coalesce("sections", F.array().cast("array<string>")))
    return rows.select("qid", frame.alias("frame"), F.when(use | (F.col("intent") == "open"), "cot").otherwise("static").alias("source"))
