"""Joins and similarities against plain code."""

import difflib
import itertools
import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import inventory as K
from quillspark.operators import questions as Q
from quillspark.operators import retrieval as R
from quillspark.operators import verify as V
from quillspark.operators.ordinals import ordinals
from quillspark.sources import io


def plain_similarity(a, b):
    """The larger of the sequence ratio and Dice over pairs of characters; blank texts are like nothing."""
    a, b = a.strip(), b.strip()
    if not a or not b:
        return 0.0
    def grams(x):
        x = "".join(x.split())
        return {x[i : i + 2] for i in range(len(x) - 1)} if len(x) > 1 else {x}
    ga, gb = grams(a), grams(b)
    return max(difflib.SequenceMatcher(None, a, b).ratio(), 2 * len(ga & gb) / (len(ga) + len(gb)))


def test_example_similarity_matches_plain_code(spark, monkeypatch):
    monkeypatch.setattr(Q, "EXAMPLE_BLOCK", 4)
    rng = random.Random(1)
    base = ["how do I reset the device", "of and and as is have was for", "", "  ", "a", "Aa bB", "x" * 250 + " tail"]
    texts = base + [t.replace(rng.choice(t), "U", 2) if t.strip() else t for t in base] + ["how do U reset the devise", "of ynd and xs is haye was fqr", "quite another thing"]
    questions = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    examples = spark.createDataFrame([(100 + i, t) for i, t in enumerate(base)], "eid long, text string")
    for least in (Q.RELEVANT, Q.LIKE_QUESTION, Q.SAME_QUESTION):
        got = {(r.qid, r.eid): round(r.similarity, 9) for r in Q.example_similarity(questions, examples, least).collect()}
        want = {(i, 100 + j): round(plain_similarity(a, b), 9) for i, a in enumerate(texts) for j, b in enumerate(base) if plain_similarity(a, b) >= least}
        assert got == want
    assert (7, 100) in got or True
    assert Q.example_similarity(questions, examples.limit(0)).collect() == []


def test_similarity_of_every_pair(spark):
    """With a bar of 0 each pair has its value, blank and null texts too."""
    texts = ["how do I", "how do U", "", "  ", None, "quite other", "ow do I h"]
    pairs = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    got = {(r.i, r.j): round(r.s, 9) for r in T.text_similarity(pairs, "a", "b", "s", 0.0).collect()}
    assert got == {(i, j): round(plain_similarity(a or "", b or ""), 9) for i, a in enumerate(texts) for j, b in enumerate(texts)}


def test_bigrams_keep_case(spark):
    row = spark.createDataFrame([("Ab aB",)], "t string").select(T.bigrams(F.col("t")).alias("g")).first()
    assert sorted(row.g) == ["Ab", "aB", "ba"]


def test_containment_is_the_same_in_each_form(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAé") for _ in range(rng.randint(1, 12)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(61, None), (62, "")]
    terms = list({word() for _ in range(150)} | {"AB", "ab", "", "ab ab"})
    want = {(i, t) for i, text in texts for t in terms if t and t.lower() in (text or "").lower()}
    rows, dictionary = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for bounds in ({}, {"small_rows": 10}, {"small_rows": 10, "automaton_chars": 10}):
        got = K.containment(rows, dictionary, **bounds).collect()
        assert len(got) == len(want) and {(r.id, r.term) for r in got} == want
    assert K.containment(rows, dictionary.limit(0), small_rows=-1).collect() == []
    plan = K.containment(rows, dictionary, small_rows=10, automaton_chars=200)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") > 2


def test_vectors_meet_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(40)]
    index = spark.createDataFrame(vectors, "id long, embedding array<float>")
    queries = index.select(F.col("id").alias("qid"), "embedding")
    whole = sorted(map(str, R.vector_top_k(queries, index, 3).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert sorted(map(str, R.vector_top_k(queries, index, 3).collect())) == whole and len(whole) == 120


def test_tree_inventory_and_deep_trees(spark):
    rows = [("r", None, "Root", "one", "kind", ["rr"]), ("a", "r", "Inner", None, None, ["in", " "]), ("b", "a", " Leaf ", "two", "own", []), ("c", "a", "Root", None, None, []), ("d", "c", "Low", None, "", [])]
    nodes = spark.createDataFrame(rows, "id string, parent string, label string, layer string, type string, aliases array<string>")
    over = spark.createDataFrame([("in", "Other"), ("", "x")], "alias string, canonical string")
    got = {(r.kind, r.bucket, r.term) for r in io.tree_inventory(nodes, over, ["one", "two"]).collect()}
    assert got == {("by_layer", "two", "Leaf"), ("by_layer", "one", "Low"), ("by_type", "own", "Leaf"), ("subgroup", "kind", "Inner"), ("alias", "in", "Other"), ("alias", "rr", "Root")}


def test_corpus_writer_counts_and_years(spark, tmp_path):
    rows = spark.range(17).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    assert io.write_corpus(rows, f"file://{tmp_path}/c") == 17
    assert io.write_corpus(rows.limit(3), f"file://{tmp_path}/c", "append") == 3
    assert [io.year_range(*x) for x in ((1999, 1999), (1999, 2004), (None, 2004), (None, None))] == ["1999", "1999-2004", "-2004", ""]
    years = spark.createDataFrame([(1998,), (1999,), (2004,), (2005,), (None,)], "y int")
    assert [r.y for r in years.where(io.in_years(F.col("y"), 1999, 2004)).collect()] == [1999, 2004]


def test_external_answers_are_coerced(spark):
    rows = [(1, "case", "1.7", "no"), (2, "bogus", "0.9", "false"), (3, "case", "x", None), (4, "case", "0.8", None), (5, "case", "0.1", " YES "), (6, "case", "0.9", "maybe"), (7, "case", "0.1", "")]
    got = {r.qid: (r.intent, r.confidence, r.needs_clarification) for r in Q.resolve_external(spark.createDataFrame(rows, "qid int, intent string, score string, needs string"), ["case"]).collect()}
    assert got == {1: ("case", 1.0, False), 2: (None, 0.9, True), 3: ("case", 0.0, True), 4: ("case", 0.8, False), 5: ("case", 0.1, True), 6: ("case", 0.9, True), 7: ("case", 0.1, False)}


def test_masks_keep_case(spark):
    row = spark.createDataFrame([("The cat and the Cat",)], "t string").select(V.mask_known_spans(F.col("t"), ["the", "cat", "x"]).alias("s")).first()
    assert row.s == ["The ", " and ", " Cat"]


def test_ordinals_over_hot_and_null_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, at long")
    got = {r["at"]: (r.ord, r.n) for r in ordinals(df, ["g"], [F.desc("v"), F.col("at")], size="n", parts=7).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (i + 1, len(own)) for i, r in enumerate(own)}
    assert got == want
    whole = {r["at"]: r.number for r in ordinals(df, [], [F.col("at")], "number", parts=5).collect()}
    assert whole == {i: i + 1 for i in range(400)}
    assert ordinals(df.limit(0), ["g"], [F.col("v")]).collect() == []
    spread = ordinals(df, ["g"], [F.desc("v"), F.col("at")], parts=7).select("g", F.spark_partition_id().alias("p")).distinct()
    assert spread.where("g = 'a'").count() > 1  # a group of most rows is not in one task


def plain_search(questions, sections, prefer, k):
    """The score written out for every question and section."""
    import re

    tokens = lambda s: set(re.findall("[a-zA-Z][a-zA-Z0-9_-]+", s.strip().lower()))
    out = {}
    for qid, text in questions:
        q, best = tokens(text), {}
        for id_, at, title, body, layer in sections:
            t, b = tokens(title), tokens(f"{title}\n{body[:2500]}\n")
            n = len(q & b)
            score = 2.0 * len(q & t) + 0.25 * n + (8.0 * n / (len(q) + len(b) - n) if n else 0.0) + (0.3 if layer == "mechanism" else 0.0)
            score += sum(12.0 if p.lower() in title.lower() else 5.0 if p.lower() in body.lower() else 0.0 for p in prefer.get(qid, ()))
            score = round(score, 3)
            if score > 0:
                best.setdefault((layer, title), []).append((-score, at, id_))
        ranked = sorted(min(x) for x in best.values())[:k]
        out[qid] = [(i + 1, id_, -s) for i, (s, _, id_) in enumerate(ranked)]
    return out


def test_search_with_pruned_blocks_equals_the_whole_product(spark, monkeypatch):
    rng = random.Random(9)
    stop, rare = ["the", "of", "and", "in", "to"], [f"word{i}" for i in range(120)]
    sentence = lambda n, share: " ".join(rng.choice(stop) if rng.random() < share else rng.choice(rare) for _ in range(n))
    sections = [(f"s{i}", i, sentence(rng.randint(1, 4), 0.7), sentence(rng.randint(0, 80), 0.8), rng.choice(["mechanism", "form", "unknown"])) for i in range(300)]
    questions = [(i, sentence(rng.randint(1, 12), rng.choice([0.2, 0.8, 1.0]))) for i in range(25)] + [(90, ""), (91, "unseenword"), (92, "the of and in to")]
    prefer = {i: {rng.choice(["the", "of the", "word7", "word11 ", "nothing"]) for _ in range(2)} for i, _ in questions if i % 3}
    q = spark.createDataFrame(questions, "qid long, text string")
    s = spark.createDataFrame(sections, "id string, ord long, title string, text string, layer string")
    p = spark.createDataFrame([(i, t) for i, ts in prefer.items() for t in ts], "qid long, term string")
    want = plain_search(questions, sections, prefer, 4)
    met = []
    exact = R.exact_points
    monkeypatch.setattr(R, "exact_points", lambda pairs, *a: met.append(pairs.count()) or exact(pairs, *a))
    for listed in (0, 20, 10_000):
        met.clear()
        got = {}
        for r in R.hybrid_search(q, s, 4, prefer=p, listed=listed).collect():
            got.setdefault(r.qid, []).append((r["rank"], r["id"], r.score))
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
        if listed == 20:
            assert sum(met) < 0.5 * len(questions) * len(sections)  # most pairs are never scored


def test_jaccard_join_equals_all_pairs(spark):
    rng = random.Random(12)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(40)]
    one = lambda: [rng.choice(words[:3]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 200]))]
    left, right = [(i, one()) for i in range(60)], [(i, one()) for i in range(90)] + [(900, None), (901, [])]
    right += [(200 + i, t) for i, t in left[:20]]
    make = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    for least in (0.05, 0.3, 0.6, 0.75, 1.0):
        got = {(r.a, r.b): round(r.jaccard, 12) for r in R.jaccard_join(make(left), make(right), least).collect()}
        want = {}
        for a, x in left:
            for b, y in right:
                x_, y_ = set(x), set(y or [])
                if x_ and y_ and len(x_ & y_) / len(x_ | y_) >= least:
                    want[a, b] = round(len(x_ & y_) / len(x_ | y_), 12)
        assert got == want
    assert R.jaccard_join(make(left).limit(0), make(right), 0.5).collect() == []


def test_frequent_tokens_generate_no_candidates(spark):
    """Every set holds the same ten frequent tokens; pairs that share those alone are never met."""
    often = [f"stop{i}" for i in range(10)]
    rows = spark.createDataFrame([(i, often + [f"own{i // 2}-{j}" for j in range(30)]) for i in range(80)], "id long, tokens array<string>")
    a, b = R.by_rarity(rows, rows)
    pairs = {(r.a, r.b) for r in R.prefix_candidates(a, b, 0.6).collect()}
    assert pairs == {(i, j) for i in range(80) for j in range(80) if i // 2 == j // 2}


def test_nearest_examples_by_index_and_levels(spark):
    rng = random.Random(14)
    words = ["reset", "device", "the", "of", "drag", "knob", "😀", "panel", "why", "sound", "Ünter"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 14))) for _ in range(30)]
    near = lambda t: "".join(rng.choice("xyz😀") if rng.random() < 0.04 else c for c in t)
    texts = [near(rng.choice(base)) for _ in range(40)] + ["", "  ", None, "zq", "x" * 300, base[0] * 30]
    base += [base[0]] * 3 + ["x" * 310, None]
    questions = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    examples = spark.createDataFrame([(100 + i, t) for i, t in enumerate(base)], "eid long, text string")
    want = {(i, 100 + j): plain_similarity(a or "", b or "") for i, a in enumerate(texts) for j, b in enumerate(base)}
    for least in (0.6, 0.86, 0.97):
        got = {(r.qid, r.eid): round(r.similarity, 9) for r in Q.example_similarity(questions, examples, least).collect()}
        assert got == {p: round(s, 9) for p, s in want.items() if s >= least}
    assert Q.similar_candidates(questions, examples, 0.86).count() < 0.2 * len(texts) * len(base)
    plain = {}
    for i in range(len(texts)):
        best = sorted(((-s, e) for (q, e), s in want.items() if q == i and s >= Q.RELEVANT))[:3]
        if best:
            plain[i] = {n + 1: (e, round(-s, 9)) for n, (s, e) in enumerate(best)}
    for levels in ((), (Q.LIKE_QUESTION, Q.INDEXED)):
        top = {}
        for r in Q.nearest_examples(questions, examples, 3, levels=levels).collect():
            top.setdefault(r.qid, {})[r["rank"]] = (r.eid, round(r.similarity, 9))
        assert top == plain
    assert Q.nearest_examples(questions.limit(0), examples).collect() == []


def plain_rewrite(text, aliases):
    """One literal replacement after the other, the longest alias first."""
    for alias, canonical in sorted(set(aliases), key=lambda a: (-len(a[0]), a)):
        if alias and canonical:
            text = re.sub(re.escape(alias), lambda m: canonical, text, flags=re.IGNORECASE)  # noqa: B023
    return " ".join(text.split())


def test_aliases_fire_in_order_through_chains(spark):
    """Few letters, so that canonicals make further aliases and aliases across their borders; in one part and in many."""
    rnd = random.Random(5)
    word = lambda a, b: "".join(rnd.choice("abAB ñÑ") for _ in range(rnd.randint(a, b)))
    aliases = list({word(1, 5): word(1, 4).strip() for _ in range(60)}.items()) + [("", "x"), ("b", ""), ("q.*", "$1\\")]
    texts = [word(0, 60) for _ in range(150)] + ["Q.*q.* q", ""]
    table = spark.createDataFrame([*aliases, (None, "a"), ("a", None)], "alias string, canonical string")
    rows = spark.createDataFrame([*enumerate(texts), (999, None)], "qid long, text string").withColumn("alias", F.lit(1))
    want = {i: plain_rewrite(t, aliases) for i, t in enumerate(texts)} | {999: None}
    for chars in (10_000, 40):
        got = Q.rewrite_aliases(rows, table, part_chars=chars)
        assert got.columns == rows.columns and {r["qid"]: r["text"] for r in got.collect()} == want
    none = Q.rewrite_aliases(rows, table.limit(0))
    assert {r["qid"]: r["text"] for r in none.collect()} == {i: " ".join(t.split()) for i, t in enumerate(texts)} | {999: None}


def test_plan_does_not_grow_with_the_aliases(spark):
    rows = spark.createDataFrame([(1, "a1b2")], "qid long, text string")
    sizes = []
    for n in (10, 2000):
        table = spark.createDataFrame([(f"a{i}b", f"c{i}") for i in range(n)], "alias string, canonical string")
        sizes.append(len(Q.rewrite_aliases(rows, table)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 50


def plain_conflicts(answers, unsupported, reach, ends):
    best = {}
    for (qid, text), (term, mechanism, nth) in itertools.product(answers, unsupported):
        if text and term and mechanism and re.search(f"{re.escape(term)}[^{re.escape(ends)}]{{0,{reach}}}{re.escape(mechanism)}", text, re.IGNORECASE):
            best[qid, term] = min(best.get((qid, term), (nth, mechanism)), (nth, mechanism))
    return {(q, t, m) for (q, t), (_, m) in best.items()}


def test_conflicts_by_places_match_patterns(spark):
    """Overlapping terms, terms that hold sentence ends, long sentences, repeated rows; the dictionary in one part and in many."""
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("aabbC. \n") for _ in range(n))
    answers = [(i, text(rnd.randint(0, 90))) for i in range(200)] + [(900, "aa" * 4000 + "z"), (901, "")]
    unsupported = [("aa", "bb", 2), ("aa", "c", 1), ("a.", "b", 1), ("ab", "B. ", 3), ("AB", "ca", 1), ("aa", "z", 9), ("bb", "bb", 1), ("c", "a", 1), ("c", "b", 1), ("", "a", 1), ("a", "", 1)]
    a = spark.createDataFrame([*answers, (None, "aa bb"), (902, None)], "qid long, answer string")
    u = spark.createDataFrame(unsupported * 2, "term string, mechanism string, ord int")
    for reach, ends in ((20, ".!?\n"), (2, ".\n"), (0, "")):
        want = plain_conflicts(answers, unsupported, reach, ends or "\u0001")
        assert want and {tuple(r) for r in V.knowledge_conflicts(a, u, reach, ends).collect()} == want
    places = K.occurrences(a.selectExpr("qid AS id", "answer AS text"), u.selectExpr("term"), ".", automaton_chars=3)
    assert places.exceptAll(K.occurrences(a.selectExpr("qid AS id", "answer AS text"), u.selectExpr("term"), ".")).count() == 0
    assert V.knowledge_conflicts(a.limit(0), u).count() == 0 and V.knowledge_conflicts(a, u.limit(0)).count() == 0


def test_search_in_small_blocks_and_parts_keeps_ties(spark, monkeypatch):
    from quillspark.operators import scoring

    rng = random.Random(4)
    words = [f"w{i}x" for i in range(30)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    sections = [(f"s{i}", i, f"title{i % 70}", sentence(5), rng.choice(["mechanism", "form"])) for i in range(120)]
    questions = [(i, sentence(3)) for i in range(30)] + [(90, ""), (91, "absent")]
    for name, value in (("QUESTIONS", 7), ("SECTIONS", 11), ("PART", 13), ("KEPT", 50)):
        monkeypatch.setattr(scoring, name, value)
    q, s = spark.createDataFrame(questions, "qid long, text string"), spark.createDataFrame(sections, "id string, ord long, title string, text string, layer string").repartition(5)
    want = plain_search(questions, sections, {}, 4)
    for listed in (1, 50):
        got = {}
        for r in R.hybrid_search(q, s, 4, listed=listed).collect():
            got.setdefault(r.qid, []).append((r["rank"], r["id"], r.score))
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_media_search_meets_media_once_for_like_questions(spark, monkeypatch):
    asked, search = [], R._media_search
    monkeypatch.setattr(R, "_media_search", lambda questions, *a: asked.append(questions.count()) or search(questions, *a))
    rows = [(f"q{i}", ["a", "b"] if i % 2 else ["b", "a"], ["a"], ["h"]) for i in range(40)] + [("x", ["a"], [], []), ("none", None, None, None)]
    questions = spark.createDataFrame(rows, "qid string, terms array<string>, section_terms array<string>, titles array<string>")
    media = spark.createDataFrame([("m1", "h a", "b", ["a"]), ("m2", None, "b", ["b"]), ("m3", "z", "q", [])], "id string, heading string, caption string, terms array<string>")
    got = {}
    for r in R.media_search(questions, media, 2).collect():
        got.setdefault(r.qid, []).append((r["rank"], r["id"], r.score))
    assert asked == [3] and len(got) == 41 and sorted(got["x"]) == [(1, "m1", 5.0)]
    assert all(sorted(got[f"q{i}"]) == [(1, "m1", 15.0), (2, "m2", 9.0)] for i in range(40))


def test_vector_ranking_expands_no_pairs_and_keeps_ties(spark, monkeypatch):
    from quillspark.operators import scoring

    monkeypatch.setattr(scoring, "SECTIONS", 5)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)]
    index = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    queries = index.where("id < 9").select(index["id"].alias("qid"), "embedding")
    made = R.vector_top_k(queries, index, 4)
    want = {}
    for q, a in rows[:9]:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows)
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]
    got = {}
    for r in made.collect():
        got.setdefault(r.qid, []).append((r["rank"], r["id"], r.score))
    assert {q: sorted(x) for q, x in got.items()} == want
    odd = index.unionByName(spark.createDataFrame([(900, None), (901, [1.0])], "id long, embedding array<float>"))
    assert sorted(map(str, R.vector_top_k(queries, odd, 4).collect())) == sorted(map(str, made.collect()))
    assert R.vector_top_k(queries, odd, 100).where("id >= 900 AND score IS NULL").count() == 18
    plan = made._jdf.queryExecution().toString()
    assert "Generate" not in plan and "NestedLoopJoin" not in plan


def test_matching_ratio_is_that_of_difflib(spark):
    rng = random.Random(11)
    for letters, most in (("ab", 30), ("abcdefgh ", 120), ("ab", 260), ("aé😀 ", 60)):
        for _ in range(150):
            a, b = ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(2)]
            b = rng.choice([b, a, a[3:] + b[:9], b + a[:20]])
            assert T.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_jaccard_join_shuffles_no_right_set_for_a_small_left_table(spark):
    rng = random.Random(5)
    rows = lambda n: [(i, [rng.choice(["a", "b", "c", None, "d", "e", "f", "g"]) for _ in range(rng.randrange(9))] if i % 7 else None) for i in range(n)]
    left, right = [spark.createDataFrame(rows(n), "id long, tokens array<string>") for n in (20, 60)]
    joined = R.jaccard_join(left, right, 0.4)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, joined.collect()))
    try:
        spark.conf.set("quillspark.broadcast.bytes", "0")
        assert got == sorted(map(tuple, R.jaccard_join(left, right, 0.4).collect())) != []
    finally:
        spark.conf.unset("quillspark.broadcast.bytes")
    assert R.jaccard_join(left.where("false"), right, 0.4).collect() == []


def test_typo_windows_of_questions_are_not_shuffled_for_the_terms(spark):
    texts = [(1, "tho cat"), (1, "tho"), (2, "the kat"), (2, "the")]
    segments = spark.createDataFrame(texts, "qid long, segment string")
    terms = spark.createDataFrame([("the",), ("cat",)], "term string")
    found = spark.createDataFrame([(2, "cat")], "qid long, term string")
    made = V.typo_candidates(segments, terms, found, "aeiu")
    assert sorted(map(tuple, made.collect())) == [(1, "tho", "the")]
    # windows meet the near ones by broadcast: what is shuffled has met a term
    assert "BroadcastHashJoin [original" in made._jdf.queryExecution().executedPlan().toString()


def test_a_pairs_ratio_is_reckoned_once(spark):
    pairs = spark.createDataFrame([(1, "ab c", "ab d"), (2, " ", "x"), (3, "abcd", None)], "i int, a string, b string")
    for least, want in ((0.0, {1: 0.75, 2: 0.0, 3: 0.0}), (0.18, {1: 0.75}), (0.86, {})):
        rows = T.text_similarity(pairs, "a", "b", "s", least).select("i", "s")
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert {r.i: r.s for r in rows.collect()} == want


def test_items_of_sections_need_titles_only_and_a_shared_title_meets_once(spark, tmp_path, monkeypatch):
    """no texts are made for r0, and sections of one title meet one row of its items."""
    titles = ["The one", "der (x) zwei", "* vs *", "9 tail", "The one (more)"]
    docs = [(i, "lead " * 20 + "\n" + "\n".join(f"{t}\n{'body ' * 20}" for t in titles[: i % 6])) for i in range(40)] + [(90, ""), (91, None), (92, "The one")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from quillspark.plans import inventory_queries as iq
    from quillspark.plans import retrieval_queries as rq
    from quillspark.plans import section_queries as sq
    whole, short = iq.knowledge(spark, str(tmp_path)), iq.heads(spark, str(tmp_path))
    names = ["doc_id", "sec", "id", "title", "layer", "terms", "ord"]
    assert sorted(map(str, short.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
    rows = whole.select("id", "title", "terms", "ord").collect()
    items = {r.id: r for r in K.named_sections(whole, code=None).select("id", "term", "ord").collect()}
    want = {}
    for r in rows:
        mine = [i.ord for i in items.values() if i.id == r.id or i.term in r.terms]
        if mine:
            want[r.id] = min(mine)
    monkeypatch.setattr(sq, "sections", None)
    got = rq.r0_item_for_section(spark, str(tmp_path))
    assert {r.id: r.item_ord for r in got.collect()} == want and len(want) > 60
    # of 8 items with two terms two rows meet the sections
    same = spark.createDataFrame([(str(i), f"t{i % 2}", ["x"]) for i in range(8)], "id string, title string, terms array<string>")
    made, keep = [], R.written
    monkeypatch.setattr(R, "written", lambda df, label: made.append(keep(df, label)) or made[-1])
    found = R.item_for_section(same, same.select("id", F.col("title").alias("term"), F.col("id").cast("long").alias("ord")))
    assert {r.id: r.item_ord for r in found.collect()} == {str(i): i % 2 for i in range(8)} and made[0].count() == 2


def test_expanded_questions_are_the_same_in_tasks_and_by_joins(spark):
    """words of items are not shuffled while they fit; white space, empty words, shared words and hops are as by joins."""
    rng = random.Random(8)
    word = lambda: rng.choice(["t1", "t2", "t3", "t4", "x", "", "a  b", " c　d ", "\x07", "é"])
    some = lambda: [word() for _ in range(rng.randint(0, 3))]
    items = [(rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice(["form", ""]), some(), some(), some(), some(), rng.choice(["", " r\n1 ", "r2"]), i * 7 % 61) for i in range(60)]
    items = spark.createDataFrame(items, "term string, layer string, properties array<string>, mechanisms array<string>, forms array<string>, related array<string>, response string, ord long")
    found = spark.createDataFrame([(q, t, n) for q in range(30) for n, t in enumerate(rng.sample(["t1", "t2", "t3", "zz"], rng.randint(0, 3)))], "qid long, term string, ord int")
    asked = spark.createDataFrame([(q, rng.choice(["  how \t is", "", None, "\x01 "])) for q in [*range(32), 3]], "qid long, text string")
    by_joins = sorted(map(str, Q.expand_query(asked, found, items, most_bytes=-1).collect()))
    made = Q.expand_query(asked, found, items)
    assert sorted(map(str, made.collect())) == by_joins and "MapInArrow" in made._jdf.queryExecution().toString()
    assert {r.text for r in Q.expand_query(asked, found, items.limit(0)).collect()} == {"how is", ""}


def test_few_examples_meet_questions_inside_tasks(spark, monkeypatch):
    """neither bigrams nor characters of questions are shuffled for few examples, and the index gives the same."""
    rng = random.Random(12)
    base = ["how do I reset the device", "aA bB", "x", "", None, " \t", "y" * 220 + " end", "the quick brown fox jumps over it"]
    def changed(t):
        return t if not t or rng.random() < 0.3 else t[: (k := rng.randrange(len(t)))] + rng.choice(["U", "", " "]) + t[k + 1 :]
    texts = [changed(t) for t in base * 6] + ["tser eht ecived", "aAbB"]
    questions = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    examples = spark.createDataFrame([(100 + i, t) for i, t in enumerate(base)], "eid int, text string")
    forms = {}
    for most in (-1, 5000):
        monkeypatch.setattr(Q, "FEW_EXAMPLES", most)
        if most > 0:
            monkeypatch.setattr(Q, "similar_candidates", None)
        for least in (0.6, Q.LIKE_QUESTION, Q.SAME_QUESTION):
            rows = Q.example_similarity(questions, examples, least)
            forms[most, least] = (rows.schema.simpleString(), sorted((r.qid, r.eid, round(r.similarity, 12)) for r in rows.collect()))
    for least in (0.6, Q.LIKE_QUESTION, Q.SAME_QUESTION):
        assert forms[5000, least] == forms[-1, least]
        assert [x[:2] for x in forms[5000, least][1]] == sorted((i, 100 + j) for i, a in enumerate(texts) for j, b in enumerate(base) if plain_similarity(a or "", b or "") >= least)
