"""Ranking, classification, calibration and rationale metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels of a verdict, in their fixed order.
LABELS = ("SUPPORT", "CONTRADICT", "INSUFFICIENT")


def ir_metrics(ranking: DataFrame, qrels: DataFrame, asked: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg_10, recall_10, recall_100, mrr_10) per query with a positive.

    `ranking` is (query_id, doc_id, rank), `qrels` (query_id, doc_id).  Gains
    are binary, 1 / log2(rank + 1), ideal over the first ten or all positives; a query
    without hits scores 0.  A ranking that holds a document twice raises, and so does a query of `asked` (query_id), where given, without a positive.
    `counts` (query_id, n_pos) are the positives of each query where they are known; `qrels` then need hold those in the ranking only.
    """
    once = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.count("*").alias("__n"))
    ranking = once.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a document stands twice in the ranking of query "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    if asked is not None:
        lacking = asked.select("query_id").join(qrels, "query_id", "left_anti").limit(1).collect()
        if lacking:
            raise ValueError(f"query {lacking[0][0]} has no positive")
    positives = counts if counts is not None else qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_pos"))
    hits = ranking.join(qrels.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if(F.col("rank") <= 10).alias("h10"),
        F.count_if(F.col("rank") <= 100).alias("h100"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_pos")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = positives.join(hits, "query_id", "left")
    return both.select(
        "query_id",
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg_10"),
        F.coalesce(F.col("h10") / F.col("n_pos"), F.lit(0.0)).alias("recall_10"),
        F.coalesce(F.col("h100") / F.col("n_pos"), F.lit(0.0)).alias("recall_100"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_10"),
    )


def confusion(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., gold, predicted, n): counts with zeros for every gold label and every label or extra prediction."""
    counts = pairs.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    gold = spark.createDataFrame([(x,) for x in LABELS], "gold string")
    groups = pairs.select(*by).distinct() if by else spark.range(1).select()
    extra = pairs.select("predicted").distinct().unionByName(gold.toDF("predicted")).distinct().where("predicted IS NOT NULL")
    grid = groups.crossJoin(F.broadcast(gold)).crossJoin(F.broadcast(extra))  # groups x labels
    return grid.join(counts, [*by, "gold", "predicted"], "left").fillna(0, ["n"])


def classification(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, support, said, precision, recall, f1, label_accuracy, macro_f1, accuracy) over (gold, predicted).

    said counts the predictions of a label and label_accuracy, its hits over its support, is null without support.  0/0 is 0; a prediction outside the labels is a miss and never a class; the
    macro mean always divides by the three labels.
    """
    counts = pairs.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))
    labels = pairs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LABELS)], "label string, __i int")
    sums = counts.crossJoin(F.broadcast(labels)).groupBy(*by, "label", "__i").agg(
        F.coalesce(F.sum(F.when((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("gold") == F.col("label"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n"))), F.lit(0)).alias("said"),
        F.sum("n").alias("total"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = sums.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    each = each.withColumn("label_accuracy", F.try_divide("tp", "support"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    over = Window.partitionBy(*by)
    each = each.withColumns({"macro_f1": F.sum("f1").over(over) / len(LABELS), "accuracy": F.sum("tp").over(over) / F.col("total")})
    return each.select(*by, "label", "support", "said", "precision", "recall", "f1", "label_accuracy", "macro_f1", "accuracy")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (n, ece, brier, nll, accuracy, agreement) over (gold, probabilities in label order).

    agreement is the share of rows whose most probable label is `predicted`, null without such a column.

    Confidence is the largest probability, of the first label on ties.  Bins
    are [i/bins, (i+1)/bins), the last closed; the Brier score sums over the labels; the
    likelihood is held above 1e-300.
    """
    p = F.col("probabilities")
    confidence, at = F.array_max(p), F.array_position(p, F.array_max(p))
    gold = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("gold"))
    edge = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    brier = F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i + 1 == gold, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    agrees = (F.element_at(F.array(*[F.lit(x) for x in LABELS]), at.cast("int")) == F.col("predicted")).cast("double") if "predicted" in rows.columns else F.lit(None).cast("double")
    each = rows.select(
        confidence.alias("confidence"), (at == gold).cast("double").alias("hit"), F.size(F.filter(edge, lambda e: e <= confidence)).alias("bin"), brier.alias("brier"),
        (-F.log(F.greatest(F.element_at(p, gold.cast("int")), F.lit(1e-300)))).alias("nll"), agrees.alias("agrees"),
    )
    per_bin = each.groupBy("bin").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("hit").alias("h"), F.sum("brier").alias("b"), F.sum("nll").alias("l"), F.sum("agrees").alias("a"))
    return per_bin.agg(
        F.sum("n").alias("n"), (F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("nll"), (F.sum("h") / F.sum("n")).alias("accuracy"), (F.sum("a") / F.sum("n")).alias("agreement")
    )


def rationale_scores(rows: DataFrame) -> DataFrame:
    """`rows` with precision, recall and f1 of `predicted` (array<int>) against the best of `alternatives` (array<array<int>>).

    Rows without alternatives are not eligible and get nulls and, with a column `gold`, the reason why in `excluded`: gold_insufficient, or
    retrieved_document_without_valid_gold_rationale.  An empty prediction scores 0.
    """
    one = """transform(alternatives, g -> named_struct('f1', CASE WHEN size(array_intersect(g, predicted)) = 0 THEN 0D
        ELSE 2D * size(array_intersect(g, predicted)) / (size(array_distinct(g)) + size(array_distinct(predicted))) END,
        'p', CASE WHEN size(predicted) = 0 THEN 0D ELSE double(size(array_intersect(g, predicted))) / size(array_distinct(predicted)) END,
        'r', double(size(array_intersect(g, predicted))) / size(array_distinct(g))))"""
    best = F.array_max(F.expr(one))
    left_out = F.coalesce(F.size("alternatives"), F.lit(0)) <= 0
    reason = F.when(left_out & ~F.coalesce(F.col("gold").isin("SUPPORT", "CONTRADICT"), F.lit(False)), "gold_insufficient").when(left_out, "retrieved_document_without_valid_gold_rationale") if "gold" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("__b", best).withColumns({"precision": F.col("__b.p"), "recall": F.col("__b.r"), "f1": F.col("__b.f1"), "excluded": reason}).drop("__b")
