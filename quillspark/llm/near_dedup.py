"""Near-duplicate documents by bottom-k sketches.

One hash function gives each document the k smallest hashes of its word shingles. Documents with
equal sets form one class. Inverted lists of the retained values give candidate overlaps: values are
ordered by rarity, and only so many of a sketch's rarest values are listed that two similar sketches
must share one of them. In every list one hub meets all others; documents whose components are still
apart meet in a second pass, so no list is expanded into all its pairs. The union sketch estimates a
candidate's similarity and filters; the full sets then decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import discard, materialize, narrowed, small, table
from quillspark.llm.components import connected_components

SKETCH = 224
#: Standard deviations that a sketch's count may fall short of its mean.
SLACK = 4.0
#: Values by which the mean of the shared values falls short where both sketches are cut.
END_VALUES = 3.0
#: Passes in which one hub of each list meets the rest, before the rest meet each other.
HUB_PASSES = 1
#: 64-bit words of the bitmap that filters pairs of the last pass.
SIGNATURE = 16


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in textvec.chunks(column):
        hashes, first = textvec.words(data, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(textvec.shingles(hashes[first[i] : first[i + 1]], width))


def shingle_sketches(docs: DataFrame, width: int = 5, k: int = SKETCH) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, set_a, set_b, sketch): two 64-bit sums and the size identify the full set.

    Null, empty and blank texts have no shingles and an empty sketch; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), width))
            raw = [s.view(np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([s.sum(dtype=np.uint64) for s in raw], np.uint64).view(np.int64)),
                pa.array(np.array([textvec.mix(s).sum(dtype=np.uint64) for s in raw], np.uint64).view(np.int64)),
                textvec.lists([s[:k] for s in sets]),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text) to (doc_id, shingles): the whole set, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for first, last, data, offsets in textvec.chunks(batch.column(1)):
                hashes, word = textvec.words(data, offsets)
                sets = [np.unique(textvec.shingles(hashes[word[i] : word[i + 1]], width)) for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, last - first), textvec.lists(sets)], ["doc_id", "shingles"])
                at = last

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _needed(n_a: Column, n_b: Column, k: int, similarity: float) -> Column:
    """Values that the sketches of two similar sets must share, all but certainly; exactly if both sketches are whole."""
    large, both = F.greatest(n_a, n_b), n_a + n_b
    common = similarity / (1 + similarity) * both  # of two sets that are just similar enough
    # drawing k of large without replacement; the ends of two sketches differ, which costs a few values more
    spread = F.sqrt(F.lit(float(k)) * common / large * (1 - common / large) * F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / large))
    return F.when(large <= k, common).otherwise(common * F.lit(float(k)) / large - SLACK * spread - END_VALUES)


def _ranked(reps: DataFrame) -> DataFrame:
    """(rep, n, ranked): the values of each sketch that others retain too, rarest first."""
    values = reps.select("rep", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(counts, "value").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("ranked"))
    return ranked.join(reps.select("rep", "n").distinct(), "rep").select("rep", "n", "ranked")


def _postings(ranked: DataFrame, k: int, similarity: float) -> DataFrame:
    """(value, rep, n, left): the listed values of each sketch; left counts shared values from this one on."""
    # partners have from similarity * n to n / similarity shingles; between these ends the need rises and then falls, so one of them needs least
    n = F.col("n").cast("double")
    ends = F.ceil(n * F.lit(similarity) - 1e-9), F.floor(n / F.lit(similarity) + 1e-9)
    least = F.ceil(F.least(*[_needed(n, m.cast("double"), k, similarity) for m in ends]) - 1e-9)
    ranked = ranked.withColumn("listed", F.size("ranked") - F.greatest(least, F.lit(1)) + 1).where("listed > 0")
    each = ranked.select("rep", "n", F.size("ranked").alias("total"), F.posexplode(F.slice("ranked", F.lit(1), F.col("listed").cast("int"))))
    return each.select(F.col("col.value").alias("value"), "rep", "n", (F.col("total") - F.col("pos")).alias("left"))


def _signatures(ranked: DataFrame) -> DataFrame:
    """(rep, n, total, g0..): a bitmap of the shared values. Two sets differ in at least as many values as their bitmaps in bits."""
    words = [
        F.expr(f"aggregate(filter(ranked, x -> (x.value & {SIGNATURE - 1}) = {w}), 0L, (bits, x) -> bits | shiftleft(1L, cast(shiftright(x.value, 8) & 63 as int)))").alias(f"g{w}")
        for w in range(SIGNATURE)
    ]
    return ranked.select("rep", "n", F.size("ranked").alias("total"), *words)


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar: by union sketches first, by full sets then."""
    ids = materialize(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "paired")
    sketches = narrowed(sketches, ids, "rep", "paired-sketches")
    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    rows = pairs.join(right, "b").join(left, "a")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    whole = F.greatest("n_a", "n_b") <= k
    union = F.when(whole, F.array_union("s_a", "s_b")).otherwise(union)
    hits = F.when(whole, F.size(F.array_intersect("s_a", "s_b"))).otherwise(F.size(F.array_intersect(F.array_intersect(union, F.col("s_a")), F.col("s_b"))))
    rows = rows.select("a", "b", "n_a", "n_b", whole.alias("whole"), F.size(union).alias("union"), hits.alias("hits"))
    # a union sketch is k of the union's shingles, drawn without replacement
    every = (F.col("n_a") + F.col("n_b")) / (1 + similarity)
    slack = (SLACK + 1) * sqrt(similarity * (1 - similarity) / k) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / every))
    enough = F.when(F.col("whole"), F.col("hits") * 100 >= F.lit(round(similarity * 100)) * F.col("union")).otherwise(F.col("hits") >= (F.lit(similarity) - slack) * F.col("union") - 1e-6)
    rows = materialize(rows.where(enough), "candidates")
    sure = rows.where("whole").select("a", "b")
    rest = rows.where("not whole").select("a", "b", "n_a", "n_b")
    if rest.isEmpty():
        return sure
    wanted = materialize(rest.select(F.col("a").alias("rep")).unionByName(rest.select(F.col("b").alias("rep"))).distinct(), "wanted")
    texts = docs.join(small(wanted), docs["doc_id"] == wanted["rep"], "left_semi")
    sets = materialize(full_sets(texts, width), "sets")
    rows = rest.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("t_a")), "a")
    rows = rows.withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    exact = rows.where(F.col("common") * 100 >= F.lit(round(similarity * 100)) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return sure.unionByName(exact.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.75, k: int = SKETCH, hub_passes: int = HUB_PASSES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * common shingles >= 100 * similarity * shingles of the union.
    component_id is the smallest identifier that links reach; kept marks it. Texts of fewer words
    than width are one shingle; null, empty and blank texts have none and link with nothing, equal
    ones neither. Rows that repeat an identifier share its component (their texts are taken as
    linked with themselves). A null identifier gets a null component and kept = false. Very long
    texts count whole. No rows give no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(shingle_sketches(base, width, k), "sketches")
    key = ["n_shingles", "set_a", "set_b"]
    # sets that occur twice: only their rows meet, by a written table, so that a large group need not meet in one task
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    classes = materialize(classes.select(*key, "first"), "classes")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    placed = sketches.join(small(classes), key, "left").withColumn("rep", own)
    members = materialize(placed.select("doc_id", "n_shingles", "rep"), "members")
    firsts = placed.where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "first", "set_a", "set_b", "sketch")
    # rows that repeat an identifier and its text are one; two sets can have one representative only where identifiers repeat
    single, twice = firsts.where("first is null"), firsts.where("first is not null").dropDuplicates(["rep", "n", "set_a", "set_b"])
    reps = materialize(single.unionByName(twice).select("rep", "n", "sketch"), "reps")
    discard(sketches, classes)
    ranked = materialize(_ranked(reps), "ranked")
    lists = materialize(_postings(ranked, k, similarity), "postings")

    links = None
    tested = None
    labels = None
    for step in range(hub_passes + 1):
        open_lists = lists
        if labels is not None:
            open_lists = lists.join(labels, lists["rep"] == labels["id"], "left").withColumn("label", F.coalesce("component", "rep")).drop("id", "component")
        else:
            open_lists = lists.withColumn("label", F.col("rep"))
        apart = open_lists.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct(F.col("left") / F.least(F.col("n"), F.lit(k)), -F.col("rep"), F.col("n"), F.col("left"), F.col("label"))).alias("hub")).where("low < high")
        if step < hub_passes:
            # the hub is the document with the largest part of its sketch shared, as originals of copies are
            hub = apart.select("value", (-F.col("hub").getField("col2")).alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.left").alias("hub_left"), F.col("hub.label").alias("hub_label"))
            near = open_lists.join(hub, "value").where((F.col("label") != F.col("hub_label")) & (F.least("left", "hub_left") >= _needed(F.col("n").cast("double"), F.col("hub_n").cast("double"), k, similarity) - 1e-9))
            pairs = near.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        else:
            open_lists = open_lists.join(apart.select("value"), "value", "left_semi")
            rest = materialize(open_lists.join(_signatures(ranked), ["rep", "n"]), "rest")
            other = rest.select("value", *[F.col(c).alias(f"{c}_b") for c in rest.columns if c != "value"])
            differ = sum((F.bit_count(F.col(f"g{w}").bitwiseXOR(F.col(f"g{w}_b"))) for w in range(SIGNATURE)), F.lit(0))
            needed = _needed(F.col("n").cast("double"), F.col("n_b").cast("double"), k, similarity) - 1e-9
            met = rest.join(other, "value").where((F.col("rep") < F.col("rep_b")) & (F.col("label") != F.col("label_b")) & (F.least("left", "left_b") >= needed) & (F.col("total") + F.col("total_b") - differ >= 2 * needed))
            met = met.withColumnRenamed("rep_b", "b")
            pairs = met.select(F.col("rep").alias("a"), "b")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = materialize(_verified(pairs, reps, base, width, k, similarity), "links")
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links, label="component")
    rows = members
    if links is not None:
        rows = members.join(labels, members["rep"] == labels["id"], "left").drop("id")
        component = F.coalesce("component", "rep", "doc_id")
    else:
        component = F.coalesce("rep", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
