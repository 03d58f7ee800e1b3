"""Writers: JSON lines, audit tables, write-once and frozen outputs, content-addressed caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.validation import multiset_digest


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with the keys in alphabetical order; an existing path raises."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_audit(rows: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV with a header and fixed fields, floating numbers with nine decimals."""
    kinds = dict(rows.dtypes)
    rows.select(*[F.format_string("%.9f", c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in fields]).write.mode("errorifexists").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def freeze(rows: DataFrame, path: str) -> bool:
    """Write Parquet, and beside it the digest of its rows, where nothing stands; else require rows of the same digest. True where it wrote.

    The digest counts repeated rows and no order; of a table without one it is computed.
    """
    spark = rows.sparkSession
    said = tuple(multiset_digest(rows).first())
    if not _exists(spark, path):
        rows.write.parquet(path)
        spark.createDataFrame([said], "n long, digest string").coalesce(1).write.json(f"{path}/_digest")
        return True
    if _exists(spark, f"{path}/_digest/_SUCCESS"):
        held = tuple(spark.read.schema("n long, digest string").json(f"{path}/_digest").first())
    else:
        held = tuple(multiset_digest(spark.read.parquet(path)).first())
    if held != said:
        raise ValueError(f"{path} holds other rows")
    return False


def cached(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table built under these settings, from a folder named by their hash; built and written there the first time.

    The settings stand beside the table and are compared when it is read again: a folder that holds others raises.
    """
    said = json.dumps(settings, sort_keys=True)
    path = f"{folder}/{hashlib.sha256(said.encode()).hexdigest()[:16]}"
    if not _exists(spark, f"{path}/rows/_SUCCESS"):
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(said,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    if [r[0] for r in spark.read.parquet(f"{path}/settings").collect()] != [said]:
        raise ValueError(f"{path} was built under other settings")
    return spark.read.parquet(f"{path}/rows")


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file; more rows or an existing path raise."""
    first = row.limit(2).collect()
    if len(first) != 1:
        raise ValueError("a summary is one row")
    row.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append request records with the time of writing."""
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)
