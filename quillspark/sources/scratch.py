"""Tables that several plans read, written once into the session's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of column values up to which a measured table may be broadcast; the session setting of that name overrides it.
BROADCAST_BYTES = 32_000_000
BROADCAST_SETTING = "quillspark.broadcast.bytes"
_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the session's shared folder; in a folder of our own where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master!r}")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to a new path and read again: what several plans read is made once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of df, which is read for it."""
    def of(kind: DataType, value: Column) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 8
        if isinstance(kind, ArrayType):
            each = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + of(kind.elementType, x).cast("long"))
            return F.coalesce(each, F.lit(0)) + 16
        if isinstance(kind, StructType):
            return reduce(add, [of(f.dataType, value[f.name]) for f in kind.fields], F.lit(8))
        return F.lit(8)

    row = reduce(add, [of(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields], F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def fits(df: DataFrame) -> bool:
    """Whether the values of df, which are measured here, are few enough bytes to be broadcast."""
    most = int(df.sparkSession.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))
    return 0 < most and measured_bytes(df) <= most


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its measured values are small enough; else as it is, for a shuffled join. df should be a written table: it is read twice."""
    return F.broadcast(df) if fits(df) else df
