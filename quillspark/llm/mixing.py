"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its documents gets at least: that
whole part is allocated with certainty. What is left open of the target is filled by one more copy of
some documents, with inclusion probabilities p proportional to their words and 1 at most, so that the
expected words are what is open. Documents are ranked by the random odds u/(1-u), u a hash of the
identifier, over the inclusion odds p/(1-p); the lowest ranks are taken until the open words are
reached. 4096 cells of the rank carry the running sums, and only the one cell per source that holds the
cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, materialize, small, table

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the rank.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with target and the copies each document gets for certain.

    Weights go to the sources by code point, null last, and repeat. Targets stop at most times the
    source's size; the excess is shared again by weight, which ends at one level of target per
    weight for all sources below their limit. One row per source meets here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    everything = Window.partitionBy()
    fill = Window.orderBy("fill_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(most))).withColumn("fill_at", F.col("top") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("top").over(fill), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("fill_at") <= F.col("level"))
    found = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    ranked = ranked.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.least("top", F.col("weight") * found)))
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return ranked.select("source", "source_size", "weight", "target", certain.alias("certain")).withColumn("open", F.col("target") - F.col("certain") * F.col("source_size"))


def inclusion_scales(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, scale): p = least(1, scale * size) of a source's documents, so that the sum of p * size is what is open.

    counts: (source, size, n). Sizes from 1/scale on have p = 1; their number is found on the table of
    different sizes, largest first.
    """
    larger = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.where("size > 0").withColumnRenamed("source", "s").join(targets.where("open > 0").select("source", "open"), F.col("s").eqNullSafe(F.col("source")))
    sure = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0))
    squares = F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).over(smaller).cast("double")
    rows = rows.select("s", "size", ((F.col("open") - sure) / squares).alias("scale"))
    # the largest size whose own documents are not certain; with none, all are
    return rows.where(F.col("scale") * F.col("size") <= 1).groupBy("s").agg(F.max(F.struct("size", "scale")).getField("scale").alias("scale"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken, p, odds.

    size counts words (null text: 0); taken = copies * size. A source's taken words differ from its
    target by at most half of one document. Documents without words get the certain copies only and
    take nothing. A null source is a source of its own, after all others. A null identifier is hashed
    by its text; rows that share an identifier are ordered by a digest of their text, and equal rows
    are interchangeable. p is the inclusion probability of one more copy, odds the rank (null without
    words or where nothing is open). An empty table gives no rows. Reruns and other partitionings
    agree. Other columns are ignored. Sources meet in one task as one row each, documents never.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.md5(text)
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), tie), F.lit("|" + seed))), 1, 13)
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.conv(digest, 16, 10).cast("long") / F.lit(2.0**52)).alias("u"), tie.alias("tie"),
    )
    sized = materialize(sized, "sized")
    counts = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    targets = materialize(targets, "targets")
    scales = inclusion_scales(counts, targets)
    plan = targets.join(scales, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("t"), "source_size", "target", "certain", "open", "scale")
    rows = sized.join(small(materialize(plan, "mix-scales")), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    p = F.when((F.col("open") > 0) & (F.col("size") > 0), F.least(F.lit(1.0), F.coalesce("scale", F.lit(1.0)) * F.col("size")))
    rows = rows.withColumn("p", p).withColumn("odds", F.col("u") * (1.0 - F.col("p")) / ((1.0 - F.col("u")) * F.col("p")))
    # the odds run from 0 to infinity, with the cut near 1
    rows = materialize(rows.withColumn("cell", F.floor(CELLS * F.col("odds") / (1.0 + F.col("odds"))).cast("int")).drop("scale"), "ranked")
    cells = rows.where("cell is not null").groupBy("source", "cell", "open").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")
    # the cell that holds the cut: words before it fall short of what is open, words with it do not
    at = cells.withColumn("before", before).where((F.col("before") < F.col("open")) & (F.col("before") + F.col("words") >= F.col("open")))
    cuts = materialize(at.select(F.col("source").alias("s"), F.lit(True).alias("has"), F.col("cell").alias("cut"), "before"), "mix-cuts")
    rows = rows.join(small(cuts), F.col("source").eqNullSafe(F.col("s")) & F.col("cell").isNotNull(), "left")
    inside = F.coalesce(F.col("cell") == F.col("cut"), F.lit(False))
    order = Window.partitionBy("source").orderBy("odds", "u", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    # without a cut, all ranked documents together do not exceed what is open
    done = rows.where(~inside).withColumn("more", F.col("cell").isNotNull() & (F.col("has").isNull() | (F.col("cell") < F.col("cut"))))
    cut = rows.where(inside).withColumn("more", middle <= F.col("open"))
    copies = F.col("certain") + F.col("more").cast("long")
    return done.unionByName(cut).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "p", "odds")


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its copies say; columns and other values stay.

    Rows of one identifier and size share out the copies that mixed has for them, so that repeated rows
    are not multiplied. mixed must come from docs.
    """
    mix_id, size, total, rows_of, copies, copy, nth = [fresh(docs, n) for n in ("mix_id", "mix_size", "mix_total", "mix_rows", "mix_copies", "mix_copy", "mix_nth")]
    own_id, out = F.col(f"`{id_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    counts = materialize(mixed.groupBy(F.col(id_col).alias(mix_id)).agg(F.count("*").alias(rows_of), F.sum("copies").alias(total)), "mix-counts")
    rows = docs.join(small(counts.where((F.col(rows_of) == 1) & (F.col(total) > 0))), own_id.eqNullSafe(F.col(mix_id))).select(*out, F.col(total).cast("int").alias(copies))
    repeated = counts.where(F.col(rows_of) > 1).select(F.col(mix_id).alias(nth))
    if not repeated.isEmpty():
        by_size = mixed.join(repeated, F.col(id_col).eqNullSafe(F.col(nth))).groupBy(F.col(id_col).alias(mix_id), F.col("size").alias(size))
        by_size = materialize(by_size.agg(F.count("*").alias(rows_of), F.sum("copies").alias(total)), "mix-repeated")
        words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD))
        many = docs.join(small(by_size), own_id.eqNullSafe(F.col(mix_id)) & (words == F.col(size)))
        many = many.withColumn(nth, F.row_number().over(Window.partitionBy(mix_id, size).orderBy(F.xxhash64(F.col(f"`{text_col}`")))))
        each = F.floor(F.col(total) / F.col(rows_of))
        many = many.withColumn(copies, (each + (F.col(nth) <= F.col(total) - each * F.col(rows_of)).cast("int")).cast("int")).where(F.col(copies) > 0)
        rows = rows.unionByName(many.select(*out, copies))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*out)


def _columns(df: DataFrame) -> list[Column]:
    return [df[c] for c in ("doc_id", "size", "source_size", "target", "taken")]


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources of documents; the cases of odd rows are those of mix_sources."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(*_columns(mixed))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / weight AS fill_at FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(top) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
      FROM f WINDOW o AS (ORDER BY fill_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN fill_at <= level THEN top ELSE least(top, weight * (SELECT max(level) FROM l WHERE fill_at > level)) END AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t),
o AS (SELECT *, target - certain * source_size AS open FROM c),
n AS (SELECT source, size, count(*)::BIGINT AS n FROM d WHERE size > 0 GROUP BY 1, 2),
k AS (SELECT n.source, size, (open - coalesce(sum(size * n) OVER (PARTITION BY n.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(size * size * n) OVER (PARTITION BY n.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS scale
      FROM n JOIN o ON n.source IS NOT DISTINCT FROM o.source WHERE open > 0),
x AS (SELECT source, arg_max(scale, size) AS scale FROM k WHERE scale * size <= 1 GROUP BY source),
p AS (SELECT d.*, source_size, target, certain, open, CASE WHEN open > 0 AND size > 0 THEN least(1.0::DOUBLE, coalesce(scale, 1.0::DOUBLE) * size) END AS p
      FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
q AS (SELECT *, u * (1.0::DOUBLE - p) / ((1.0::DOUBLE - u) * p) AS odds FROM p),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, p IS NULL ORDER BY odds, u, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle FROM q)
SELECT doc_id, size, source_size, target, (size * (certain + CASE WHEN p IS NOT NULL AND middle <= open THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
