"""A training corpus in five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept: quality classifier, MinHash near-dedup, benchmark decontamination,
mixing sources to target weights, sharding.  All but the last return the columns of the
documents, further columns of theirs included; the last adds the shard columns, which replace columns of the same names.

Null ids, texts and sources, empty and very long texts, and repeated rows pass through every stage: what each
does with them is stated there and in its operator.  An empty corpus gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jump, minhash, mixing, ordinal, spaced
from lodestone.llm.queries import ratings
from lodestone.runtime import small, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of the best grade reaches the classifier's threshold; null and empty texts are graded by the thresholds alone."""
    model = ordinal.fit_on(docs, ratings(spark, sf_dir))
    return ordinal.kept_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the smallest doc_id (null last): five-word shingles, similarity 0.8 and more.

    A document is a doc_id with a text: different texts under one id are documents of their own, and of rows that
    repeat both one stays.  Rows without words are no copies of each other and all stay.
    """
    keyed = docs.withColumn("__node", F.xxhash64("doc_id", "text"))
    found = store(minhash.near_duplicates(keyed.select(F.col("__node").alias("doc_id"), "text"), width=5, percent=80))
    members = found.where("n_shingles > 0").select(F.col("doc_id").alias("__node"), F.col("component_id").alias("__group"))
    several = members.where("__node <> __group").select("__group").distinct()
    members = members.join(small(store(several)), "__group").distinct()
    owned = keyed.select("__node", "doc_id").join(small(store(members)), "__node")
    first = owned.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__node"))["__node"].alias("__first"))
    gone = store(members.join(first, "__group").where("__node <> __first").select("__node").distinct())
    kept = keyed.join(small(gone), "__node", "left_anti")
    twice = store(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__node")).count().where("count > 1").select("__node"))
    if twice.isEmpty():
        return kept.drop("__node")
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(small(twice), "__node", "left_semi").groupBy("__node").agg(F.min_by(rows, F.xxhash64(rows)).alias("__row")).select("__row.*")
    return kept.join(small(twice), "__node", "left_anti").drop("__node").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark items; null texts hold none, and rows with a null id stay."""
    return spaced.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mixture of sources: a row per block, so a document drawn twice stands there twice and one without words not at all."""
    return mixing.drawn_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number the documents in 16 shards by jump consistent hashing of doc_id; null counts as -1."""
    return jump.sharded(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: A fitted classifier, hashed candidates and drawn blocks have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
