"""Positions of rows in their groups without one task per group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import written


def ordinals(df: DataFrame, groups: list[str], order: list[Column], name: str = "ord", size: str | None = None, parts: int | None = None) -> DataFrame:
    """df with name: the position (from 1) of each row in its group, and with size: the rows of its group.

    The rows are dealt by ranges of (groups, order), so that a group of any size is spread over many
    tasks; one count per group and task gives what comes before. Rows that tie in order stand in any
    order: give enough columns. Null groups are a group of their own. No rows give none.
    """
    spark = df.sparkSession
    taken = {c.lower() for c in df.columns} | {name.lower()}
    at, part, first, before, rows = (_free(x, taken) for x in ("at", "part", "first", "before", "rows"))
    by = [F.col(g).asc_nulls_first() for g in groups] + order
    dealt = df.repartitionByRange(parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by)
    # the number holds the task in its upper bits and counts on inside it
    dealt = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ordinals").withColumn(part, F.shiftright(at, 33))
    runs = dealt.groupBy(*groups, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    # this window has a row per group and task, never the rows themselves
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    runs = runs.withColumn(before, F.sum(rows).over(own.orderBy(part)) - F.col(rows))
    if size:
        runs = runs.withColumn(size, F.sum(rows).over(own))
    runs = runs.select(*[F.col(g).alias(f"{g}_{before}") for g in groups], F.col(part).alias(f"{part}_"), first, before, *([size] if size else []))
    same = reduce(and_, [dealt[g].eqNullSafe(runs[f"{g}_{before}"]) for g in groups], dealt[part] == runs[f"{part}_"])
    return dealt.join(runs, same).select(*df.columns, (F.col(at) - F.col(first) + F.col(before) + 1).alias(name), *([size] if size else []))


def _free(name: str, taken: set[str]) -> str:
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name
