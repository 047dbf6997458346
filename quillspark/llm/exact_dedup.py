"""Exact deduplication with a log-structured merge index of text digests.

A memtable takes up to MEMTABLE_ROWS rows; its flush is a run, sorted by digest, with one entry (digest,
identifier that stays, count) for each digest and a bitmap filter of them. Compaction goes by levels: up to
FANOUT runs become one of the next level. Entries first probe the filters of the other runs of their
merge; only those that some filter may hold are shuffled and merged, the rest pass into the new run as
they are. Hits, the texts of digests that occur twice, are then compared byte by byte with the text that
stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, fits, materialize, scratch_dir, small, table

#: Rows that one memtable takes before it is flushed as a run.
MEMTABLE_ROWS = 65_536
#: Runs that one compaction merges.
FANOUT = 8
#: Bits of the filters for each row of a run.
FILTER_BITS = 32
#: Bits of one piece of a filter, as Spark's bitmap functions cut them.
_PIECE = 32_768
#: Rows of one group that meet in one task when hits are verified.
HITS_PER_SALT = 2048


class DigestIndex:
    """Runs of digests under one folder. keep: 'smallest' or 'largest' identifier stays."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
        self.spark, self.keep, self.memtable_rows, self.fanout = spark, keep, memtable_rows, fanout
        self.path = path or f"{scratch_dir(spark)}/digests-{uuid.uuid4().hex}"
        #: (level, folder, number of runs) of what compaction has not merged yet
        self.levels: list[tuple[int, str, int]] = []

    def _best(self, column: str) -> Column:
        return F.min(column) if self.keep == "smallest" else F.max(column)

    def _write(self, entries: DataFrame, level: int, runs: int) -> DataFrame:
        """Entries (run, digest, keep_id, n) as one folder of runs, each file sorted by run and digest."""
        folder = f"{self.path}/level-{level:02d}-{len(self.levels):03d}"
        entries.select("run", "digest", "keep_id", "n").sortWithinPartitions("run", "digest").write.option("compression", "zstd").parquet(folder)
        self.levels.append((level, folder, runs))
        return self.spark.read.parquet(folder)

    def flush(self, digests: DataFrame) -> DataFrame:
        """Rows (digest, id) through memtables into runs of level 0; rows are dealt to memtables by identifier hash."""
        runs = max(1, -(-digests.count() // self.memtable_rows))
        dealt = digests.select("digest", "id", F.pmod(F.xxhash64("id", "digest"), F.lit(runs)).cast("int").alias("run"))
        return self._write(dealt.groupBy("run", "digest").agg(self._best("id").alias("keep_id"), F.count("*").alias("n")), 0, runs)

    def filters(self, entries: DataFrame, runs: int) -> DataFrame:
        """(merge, piece, maps): for each merge of runs and piece of the filters, the bitmaps of its runs."""
        rows = entries.select("run", *self._place(runs))
        pieces = rows.groupBy("merge", "piece", "run").agg(F.bitmap_construct_agg("bit").alias("map"))
        # at most fanout small bitmaps each
        return pieces.groupBy("merge", "piece").agg(F.collect_list(F.struct("run", "map")).alias("maps"))

    def _place(self, runs: int) -> list[Column]:
        """merge, piece and bit of an entry in the filters of its level."""
        pieces = max(1, -(-self._rows_of_run * FILTER_BITS // _PIECE))
        at = F.pmod(F.xxhash64(F.lit("filter"), "digest"), F.lit(pieces * _PIECE))
        return [F.floor(F.col("run") / self.fanout).cast("int").alias("merge"), F.floor(at / _PIECE).cast("int").alias("piece"), F.pmod(at, F.lit(_PIECE)).alias("bit")]

    def compact(self) -> DataFrame:
        """Merge all runs, level by level: digest, keep_id, group_size."""
        level, folder, runs = max(self.levels)
        entries = self.spark.read.parquet(folder)
        for other, path, more in sorted(self.levels)[:-1]:
            entries = entries.unionByName(self.spark.read.parquet(path).withColumn("run", F.col("run") + runs))
            runs += more
        self._rows_of_run = self.memtable_rows
        while runs > 1:
            placed = entries.select("*", *self._place(runs))
            filters = self.filters(entries, runs)
            probed = placed.join(small(materialize(filters, "digest-filters")), ["merge", "piece"])
            # bits count from the low end of each byte
            byte = F.floor(F.col("bit") / 8).cast("int") + 1
            held = lambda f: F.getbit(F.conv(F.hex(F.substring(f["map"], byte, F.lit(1))), 16, 10).cast("int"), F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1
            probed = probed.select("merge", "digest", "keep_id", "n", F.exists("maps", lambda f: (f["run"] != F.col("run")) & held(f)).alias("maybe"))
            probed = materialize(probed, "digest-probed")
            merged = probed.where("maybe").groupBy("merge", "digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            runs = -(-runs // self.fanout)
            level, self._rows_of_run = level + 1, self._rows_of_run * self.fanout
            new = probed.where("not maybe").select("merge", "digest", "keep_id", "n").unionByName(merged).withColumnRenamed("merge", "run")
            self.levels = []
            entries = self._write(new, level, runs)
        return entries.select("digest", "keep_id", F.col("n").alias("group_size"))


def _same(a: Column, b: Column) -> Column:
    return a.cast("binary") == b.cast("binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Column | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal; null counts as the empty text, so null and empty
    texts form one group. Of a group the smallest (or largest) identifier stays. Rows that repeat an
    identifier with an equal text are all marked kept if that identifier stays. A null identifier
    never wins against another and is kept only when its whole group has none. No rows give no rows.
    Other columns are ignored, whatever their names. digest replaces the default SHA-256 in tests:
    rows that share a digest but not their bytes are told apart by the byte verification.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("body"))
    made = F.sha2(F.col("body"), 256) if digest is None else digest
    index = DigestIndex(docs.sparkSession, keep=keep)
    run = materialize(base.select(made.alias("digest"), "id"), "digests")
    index.flush(run)
    index_rows = index.compact()
    alone = index_rows.where("group_size = 1").select(F.col("keep_id").alias("id"), "digest", "keep_id", "group_size")

    # hits: the texts of groups of two and more meet the text that stays; large groups are salted
    hits = materialize(index_rows.where("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / HITS_PER_SALT).cast("int")), "digest-hits")
    hit_ids = materialize(run.join(small(hits), "digest").select("id", "digest", "keep_id", "group_size", "salts").distinct(), "hit-ids")
    hit_ids = hit_ids.withColumnsRenamed({"id": "hit_id", "digest": "hit_digest"})
    if fits(hit_ids):
        hit_ids = F.broadcast(hit_ids)
    texts = base.withColumn("digest", made).join(hit_ids, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))).drop("hit_id", "hit_digest")
    texts = materialize(texts, "hits")
    keepers = (
        texts.where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "salts").agg(F.min("body").alias("keep_body"))
        .select("digest", "keep_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    verified = salted.join(keepers, ["digest", "salt"]).select("id", "digest", "body", "keep_id", "group_size", _same(F.col("body"), F.col("keep_body")).alias("same"))
    verified = materialize(verified.withColumn("body", F.when(~F.col("same"), F.col("body"))), "verified")

    # texts that share a digest only: regrouped by their bytes (no rows at all with SHA-256)
    other = verified.where("not same")
    best = F.min("id") if keep == "smallest" else F.max("id")
    regrouped = other.groupBy("digest", "body").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    lost = other.groupBy("digest").agg(F.count("*").alias("lost"))
    good = verified.where("same").join(lost, "digest", "left").select("id", "digest", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"), F.lit(None).cast("string").alias("body"))
    fixed = other.drop("keep_id", "group_size").join(regrouped, ["digest", "body"]).select("id", "digest", "keep_id", "group_size", "body")
    rows = alone.withColumn("body", F.lit(None).cast("string")).unionByName(good).unionByName(fixed)
    sha = F.col("digest") if digest is None else F.lit(None).cast("string")
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup of documents; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
