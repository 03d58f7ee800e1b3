"""Session helpers: shared scratch space, lineage cuts, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: A side is broadcast up to this many rows and bytes, both counted; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000
_OWN = uuid.uuid4().hex


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of this machine only where that is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand texts to Python tasks in batches of about `size`: a task's memory then follows its longest text, not the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _stored(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/lodestone/{_OWN}"


def store(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared scratch folder and read it back: a cut that survives lost executors."""
    path = f"{_stored(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what `store` has written in this process; results that were not yet written or collected are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stored(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it comes in fewer partitions than there are cores, as from one small file; a table of many partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared scratch folder; for narrow tables inside loops."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def _bytes(column: Column, kind: t.DataType) -> Column:
    if isinstance(kind, t.StringType | t.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, t.ArrayType):
        each = F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(16).cast("long"), lambda s, x: s + _bytes(x, kind.elementType))
        return F.coalesce(F.size(column).cast("long"), F.lit(0)) * 8 + 16 if isinstance(kind.elementType, t.NumericType) else each
    if isinstance(kind, t.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(16).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where `df` is counted to hold at most `rows` rows and `size` bytes; else leave the choice of join to Spark."""
    counted = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if counted["n"] <= rows and counted["bytes"] <= size else df
