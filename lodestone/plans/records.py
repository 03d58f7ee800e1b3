"""Queries over files, annotations and written tables: pins, rationales, targets, checks and digests, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parsing
from lodestone.operators import rationales, training, validation
from lodestone.plans.catalogue import _DENSE, _V, _dense, _query, _table, _verdicts
from lodestone.runtime import scratch_dir, store
from lodestone.sources import readers

# Files


@_query("""SELECT source, doc_id // 1000 AS shelf, count(*) AS n, sha256(string_agg(text || chr(10), '' ORDER BY doc_id, text)) AS sha256, true AS pinned
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2""")
def file_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source as files of a thousand documents, hashed as files and compared with pins that are made from the rows."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL").select("source", F.expr("doc_id div 1000").alias("shelf"), "doc_id", "text")
    folder = f"{scratch_dir(spark).rstrip('/')}/lodestone/pins-{uuid.uuid4().hex}"
    named = docs.withColumn("file", F.concat(F.hex("source"), F.lit("-"), F.col("shelf").cast("string")))
    named.repartition("file").sortWithinPartitions("file", "doc_id", "text").select("file", "text").write.partitionBy("file").text(folder)
    hashed = readers.file_hashes(spark, folder).select(F.regexp_extract("path", r"file=([^/]*)/", 1).alias("path"), "sha256")
    lines = named.groupBy("file", "source", "shelf").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))  # a thousand documents
    pins = store(lines.select(F.col("file").alias("path"), "source", "shelf", "n", F.sha2(F.concat(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit("\n")), 256).alias("sha256")))
    wrong = validation.pin_differences(hashed, pins.select("path", "sha256")).withColumnRenamed("path", "wrong")
    shown = pins.drop("sha256").join(hashed, "path", "full").join(wrong, F.col("path") == F.col("wrong"), "left")
    return shown.select("source", "shelf", "n", "sha256", F.col("problem").isNull().alias("pinned"))


# Rationales

_ANNOTATED = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
a AS (SELECT doc_id % 500 AS claim_id, doc_id, 0 AS alternative, list_distinct([0, n_chars % len(s)]) AS ids FROM d JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)
  UNION ALL SELECT doc_id % 500, doc_id, 1, [len(s) - 1] FROM d WHERE len(s) > 3)"""


def _annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, corpus): a claim for each 500th of the documents, decided by their first and one more line, or by the last of a long one."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("source").alias("title"), F.split("text", "\n").alias("sentences"), "n_chars")
    first = F.array_sort(F.array_distinct(F.array(F.lit(0), (F.col("n_chars") % F.size("sentences")).cast("int"))))
    sets = F.when(F.size("sentences") > 3, F.array(first, F.array(F.size("sentences") - 1))).otherwise(F.array(first))
    each = docs.select((F.col("doc_id") % 500).alias("claim_id"), F.create_map("doc_id", sets).alias("evidence"))
    return each, docs.drop("n_chars")


@_query(_ANNOTATED + " SELECT DISTINCT claim_id, doc_id, unnest(ids)::INT AS sentence FROM a")
def rationale_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationales.rationale_pairs(_annotations(spark, sf_dir)[0])


@_query(_ANNOTATED + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY len(ids), doc_id, list_sort(ids)) AS rank FROM a),
u AS (SELECT claim_id, doc_id, list_sort(ids) AS ids FROM r WHERE rank = 1)
SELECT claim_id, doc_id, source AS title, (i - 1)::INT AS turn, ids[i]::INT AS sentence_index, md5(s[ids[i] + 1]) AS text_key FROM (SELECT *, unnest(generate_series(1, len(ids))) AS i FROM u) JOIN d USING (doc_id)""")
def gold_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationales.gold_rationales(*_annotations(spark, sf_dir)).withColumn("text_key", F.md5("text")).drop("text")


@_query(_V + """, t AS (SELECT doc_id, gold, CASE WHEN gold = 'INSUFFICIENT' THEN []::BIGINT[] ELSE [0, n_chars % 7 + 1] END AS r FROM v)
SELECT doc_id, '{"decision":"' || gold || '","rationale_sentences":[' || array_to_string(r, ',') || ']}' AS target, gold AS decision, array_to_string(r, ',') AS rationale, true AS parses FROM t""")
def target_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is trained to answer, and that the strict parser reads it back."""
    rationale = F.when(F.col("gold") == "INSUFFICIENT", F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint"), F.col("n_chars") % 7 + 1))
    made = _verdicts(spark, sf_dir).select("doc_id", parsing.target_json(F.col("gold"), rationale).alias("target"))
    read = made.withColumn("p", parsing.parse_decision(F.col("target"), F.lit(8)))
    return read.select("doc_id", "target", "p.decision", F.array_join(F.transform("p.rationale", lambda i: i.cast("string")), ",").alias("rationale"), (F.size("p.errors") == 0).alias("parses"))


@_query(_DENSE + """, top AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM r WHERE rank <= 3 GROUP BY 1), ann AS (SELECT query_id, list(doc_id) AS ids FROM rel WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT query_id, coalesce(list_has_any(top.ids, ann.ids), false) AS covered FROM top LEFT JOIN ann USING (query_id)""")
def covered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first three documents of each query hold an annotated one."""
    ranking, relevance, _ = _dense(spark, sf_dir, 3)
    top = ranking.groupBy("query_id").agg(F.collect_list("doc_id").alias("found"))
    annotated = relevance.where("doc_id % 2 = 0").groupBy("query_id").agg(F.collect_list("doc_id").alias("annotated"))
    return top.join(annotated, "query_id", "left").select("query_id", training.overlap(F.col("found"), F.col("annotated")).alias("covered"))


# Written tables


@_query("""SELECT count(*) AS "rows", count(*) FILTER (text IS NULL) AS text_missing, count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) AS lang_outside, count(*) FILTER (n_chars <> length(text)) AS length_drifts,
count(*) FILTER (n_chars < 100) AS too_short FROM documents""")
def checks_in_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted while a checked table is written; here every count is allowed."""
    docs = _table(spark, sf_dir, "documents")
    checks = {"text_missing": F.col("text").isNull(), "lang_outside": ~F.col("lang").isin("en", "fr", "de"), "length_drifts": F.col("n_chars") != F.length("text"), "too_short": F.col("n_chars") < 100}
    found = validation.checks_in_one_scan(docs, f"{scratch_dir(spark).rstrip('/')}/lodestone/checked-{uuid.uuid4().hex}", checks, dict.fromkeys(checks, 1 << 62))
    return spark.createDataFrame([found], "rows long, " + ", ".join(f"{name} long" for name in checks))


@_query("""WITH h AS (SELECT sha256('{"c0":' || doc_id || ',"c1":' || quality || ',"c2":' || toxic || '}') AS h FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT i, (sum(('0x' || substr(h, 8 * i + 1, 8))::BIGINT) % 4294967296)::BIGINT AS s FROM h, (SELECT unnest(range(8)) AS i) GROUP BY i)
SELECT (SELECT count(*) FROM h) AS n, string_agg(printf('%08x', s), '' ORDER BY i) AS digest FROM s""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")
    return validation.multiset_digest(rows)
