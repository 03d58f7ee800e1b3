"""Rationales: alternatives of sentences that decide a claim, as nested annotations and as rows.

Annotations are (claim_id, evidence), where evidence maps a document's id to its alternatives, each an array of
sentence numbers: any one alternative is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alternatives(annotations: DataFrame) -> DataFrame:
    """(claim_id, doc_id, alternative, sentences): a row for each alternative, numbered from 0 within its document; null or empty evidence has none."""
    documents = annotations.select("claim_id", F.explode("evidence").alias("doc_id", "sets"))
    return documents.select("claim_id", "doc_id", F.posexplode("sets").alias("alternative", "sentences"))


def rationale_pairs(annotations: DataFrame) -> DataFrame:
    """(claim_id, doc_id, sentence): the sentences of all alternatives, each once."""
    return alternatives(annotations).select("claim_id", "doc_id", F.explode("sentences").alias("sentence")).distinct()


def rationale_problems(annotations: DataFrame, corpus: DataFrame) -> DataFrame:
    """(claim_id, doc_id, alternative, problem): alternatives of (doc_id, sentences array) documents that are not there, of no or repeated (or null) sentences, or beyond the document."""
    sizes = corpus.select("doc_id", F.size("sentences").alias("held"))
    listed = alternatives(annotations).join(sizes, "doc_id", "left")
    outside = F.exists("sentences", lambda i: (i < 0) | (i >= F.col("held")))
    problem = (
        F.when(F.col("held").isNull(), "no document")
        .when(F.coalesce(F.size("sentences"), F.lit(0)) <= 0, "empty")
        .when(F.exists("sentences", lambda i: i.isNull()) | (F.size("sentences") > F.size(F.array_distinct("sentences"))), "malformed")
        .when(outside, "out of range")
    )
    return listed.select("claim_id", "doc_id", "alternative", problem.alias("problem")).where("problem IS NOT NULL")


def gold_rationales(annotations: DataFrame, corpus: DataFrame) -> DataFrame:
    """(claim_id, doc_id, title, sentence_index, text): each claim's shortest alternative, then that of the smallest doc_id, then of the first sentences; in the order annotated.

    `corpus` is (doc_id, title, sentences).  A claim without annotations has no rows; an alternative with a problem raises, whether chosen or not.
    Only the numbers of sentences meet the alternatives; texts meet the chosen ones.
    """
    problems = rationale_problems(annotations, corpus).groupBy("claim_id").agg(F.min(F.struct("problem", "doc_id")).alias("first"))
    best = alternatives(annotations).groupBy("claim_id").agg(F.min(F.struct(F.size("sentences").alias("n"), "doc_id", "sentences")).alias("m"))
    stopped = F.raise_error(F.concat(F.lit("rationale of claim "), F.col("claim_id").cast("string"), F.lit(": "), F.col("first.problem"))).cast("long")
    chosen = best.join(problems, "claim_id", "left").select("claim_id", "first", "m.doc_id", F.posexplode_outer("m.sentences").alias("turn", "sentence_index"))
    claim = F.when(F.col("first").isNotNull(), stopped).otherwise(F.col("claim_id")).alias("claim_id")
    return chosen.join(corpus, "doc_id", "left").select(claim, "doc_id", "title", "turn", "sentence_index", F.get("sentences", F.col("sentence_index")).alias("text"))
