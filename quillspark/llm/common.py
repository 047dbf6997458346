"""Scratch tables in the cluster's shared folder, table reading and checked broadcasts."""

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

#: Bytes of an Arrow batch: the JVM's buffers and the worker's copies hold several batches for each core.
BATCH_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir). Where it is unset, a folder of this machine, for local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master!r}")
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        root = _own_dirs[app]
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).options(**(options or {})).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no further plan reads, and the shuffle files of plans that have ended."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        # Spark keeps shuffle files until the driver's JVM collects the plans they belong to
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values."""
    def of(kind: DataType, value: Column) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 8
        if isinstance(kind, ArrayType):
            return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * (24 if isinstance(kind.elementType, (StructType, StringType)) else 8) + 16
        if isinstance(kind, StructType):
            return reduce(add, [of(f.dataType, value[f.name]) for f in kind.fields], F.lit(8))
        return F.lit(8)

    return reduce(add, [of(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields], F.lit(16))


def fits(df: DataFrame) -> bool:
    """Whether df, which is measured here, is small enough to be broadcast."""
    most = int(df.sparkSession.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))
    return most > 0 and (df.agg(F.sum(value_bytes(df).cast("long"))).first()[0] or 0) <= most


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it fits; else unchanged, for a shuffled join. df should be a written table: it is read twice."""
    return F.broadcast(df) if fits(df) else df


def narrowed(df: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """The rows of df whose key is among ids: by broadcast if ids fit, else by one shuffle into a written table."""
    if fits(ids):
        return df.join(F.broadcast(ids), key, "left_semi")
    return materialize(df.join(ids, key, "left_semi"), label)


def bounded_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python by BATCH_BYTES, not 10,000 at once; a bound that the user has set stays."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column (names clash whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
