"""Request-log analytics: percentiles in their three conventions, component rollups, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import small, store


#: Accuracy of the sketch that leads to the values around a percentile: those of a few of so many parts of a group are ordered.
SKETCH = 10_000


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p95, p95_low): linear percentiles, and the value at position max(1, floor(0.95 n)) of the sorted values.

    Exact: a sketch bounds each percentile from both sides, the rows below the bounds are counted and only those between them
    are ordered, equal values as one.  Groups of up to SKETCH rows are ordered whole.  Null values are left out, a group of nothing else has n = 0, and null is a group of its own.
    """
    v, shares, margin = F.col(value), (0.5, 0.95), 3 / SKETCH
    marks = F.percentile_approx(v, [q for p in shares for q in (p - margin, p + margin)], SKETCH)
    state = store(rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), marks.alias("marks")))
    few = F.col("n") <= SKETCH
    bounds = F.array(*[F.struct(F.lit(i).alias("i"), F.when(few, F.col("least")).otherwise(F.get("marks", F.lit(2 * i))).alias("low"), F.when(few, F.col("most")).otherwise(F.get("marks", F.lit(2 * i + 1))).alias("high")) for i in range(len(shares))])
    spans = state.select(F.col(by).alias("__by"), F.explode(bounds).alias("s")).select("__by", "s.*")
    # Groups meet null-safely: null is a group like any other.
    spans = spans.withColumnRenamed("__by", "__of")
    placed = rows.where(v.isNotNull()).select(F.col(by).alias("__by"), v.alias("v")).join(small(spans), F.col("__by").eqNullSafe(F.col("__of"))).where("v <= high").drop("__of")
    # Values below the bounds count together, under a null.
    counts = placed.groupBy("__by", "i", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__by", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).where("v IS NOT NULL").join(small(state.select(F.col(by).alias("__of"), "n")), F.col("__by").eqNullSafe(F.col("__of"))).drop("__of")
    spot = {i: 1 + (F.col("n") - 1) * p for i, p in enumerate(shares)}
    value_at = lambda i, k: F.min(F.when((F.col("i") == i) & (F.col("upto") >= k), F.col("v")))
    wanted = [value_at(i, g(spot[i])).alias(f"{name}{i}") for i in spot for name, g in (("floor", F.floor), ("ceil", F.ceil))]
    found = ranked.groupBy("__by").agg(*wanted, value_at(1, F.greatest(F.lit(1), F.floor(0.95 * F.col("n")))).alias("p95_low"))
    both = state.join(found, state[by].eqNullSafe(found["__by"]), "left")
    linear = {i: F.col(f"floor{i}") + (F.col(f"ceil{i}") - F.col(f"floor{i}")) * (spot[i] - F.floor(spot[i])) for i in spot}
    return both.select(state[by], "n", "mean", linear[0].alias("p50"), linear[1].alias("p95"), "p95_low")


def components(rows: DataFrame, timing: str = "timing_ms") -> DataFrame:
    """(component, n, mean, peak): a rollup of a map of component times."""
    each = rows.select(F.explode(timing).alias("component", "ms"))
    return each.groupBy("component").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.max("ms").alias("peak"))


def nearest_length(rows: DataFrame, targets: list[int]) -> DataFrame:
    """(target, id, tokens): for each target the row of the nearest length, ties to the smaller id.

    Every task keeps one row a target.
    """
    wanted = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    return rows.select("id", "tokens", wanted).groupBy("target").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("target")).alias("apart"), "id", "tokens")).alias("m")).select("target", "m.id", "m.tokens")


def weighted_mean(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, n, mean): the mean of a value weighted by a count; null where the weights sum to 0."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("mean"))


def measured(rows: DataFrame, by: str, step: str, warmup: int, amount: str, seconds: str) -> DataFrame:
    """(by, steps, per_second): amounts over seconds of the steps after the warm-up."""
    return rows.where(F.col(step) > warmup).groupBy(by).agg(F.count("*").alias("steps"), F.try_divide(F.sum(amount), F.sum(seconds)).alias("per_second"))
