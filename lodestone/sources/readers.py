"""Readers of claims, corpora, relevance tables and archives, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import files

CLAIMS = "id long, claim string, cited_doc_ids array<long>, evidence map<string, array<struct<sentences: array<int>, label: string>>>"
CORPUS = "doc_id long, title string, abstract array<string>, structured boolean"
QRELS = "`query-id` long, `corpus-id` long, score int"


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, repeated: str = "raise") -> DataFrame:
    """JSON lines with a schema; blank lines are skipped, broken ones raise.

    With a key, repeated keys raise, or the last in file order wins (`repeated="last"`).
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key is None:
        return rows
    if repeated == "last":
        # A task reads one split of a file from front to back, so its own numbering follows the rows within the split.
        placed = rows.withColumn("__at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
        last = Window.partitionBy(key).orderBy(F.col("__at").desc())
        return placed.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__at", "__n")
    twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[0] for r in twice]}")
    return rows


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole file as one JSON value."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score): a tab-separated relevance table with a header, scores above 0."""
    rows = spark.read.schema(QRELS).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.toDF("query_id", "doc_id", "score").where("score > 0")


def read_audit(spark: SparkSession, path: str, labels: tuple[str, ...], require_labels: bool = False) -> DataFrame:
    """An audit CSV with a header; a human_label outside the labels raises, and so does a missing one (not judged yet) where labels are required."""
    rows = spark.read.option("header", True).csv(path)
    unknown = F.col("human_label").isNotNull() & ~F.col("human_label").isin(*labels)
    wrong = rows.where(unknown | F.col("human_label").isNull() if require_labels else unknown).limit(1).collect()
    if wrong:
        raise ValueError(f"unknown label {wrong[0]['human_label']!r}")
    return rows


def read_archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line): the non-blank lines of the one member of each zip or tar archive whose name ends in `member`, archives of any size."""
    return files.archive_lines(spark, path, member)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files of any size, to compare with pinned values."""
    return files.file_digests(spark, path).select("path", "sha256")
