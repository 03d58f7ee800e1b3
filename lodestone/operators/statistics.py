"""Paired tests, intervals and resampling over small per-query or per-cluster tables.

Resampled tables are per query, cluster or group, of any number of rows: those of a checked size go to
every task, others meet their draws by a shuffle.  Draws are md5 numbers of a seed, the replicate and the draw, so they are the same
on every cluster and in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.runtime import small, store

#: The two-sided 95 % point of the normal law.
Z = 1.959963984540054

def wilson(k: Column, n: Column, z: float = Z, strict: bool = False) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of k of n; for n = 0 null, or an error where `strict`."""
    if strict:
        n = F.when(n == 0, F.raise_error(F.lit("an interval of no rows")).cast("bigint")).otherwise(n)
    p, zz = F.try_divide(k, n), z * z
    middle, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, middle - spread), F.when(n > 0, middle + spread)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value from the discordant counts; 1 where there are none.

    Twice the lower binomial tail at one half, summed as logarithms of the terms' ratios.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), k),
        F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.when(n - i > 0, F.log(F.greatest((n - i) / (i + 1), F.lit(1e-300)))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * terms))


def holm(rows: DataFrame, p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with holm: step-down adjusted p-values within each family, never falling along the order."""
    order = Window.partitionBy(*by).orderBy(p)
    stepped = rows.withColumn("__a", F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(order) + 1) * F.col(p)))
    return stepped.withColumn("holm", F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__a")


def sign_class(value: Column, tolerance: float = 1e-12) -> Column:
    """improved, unchanged or degraded."""
    return F.when(value > tolerance, "improved").when(F.abs(value) <= tolerance, "unchanged").otherwise("degraded")


def _word(seed: object, *parts: Column) -> Column:
    """A reproducible number below 2^32: the first eight digits of the md5 of the seed and the parts."""
    return F.conv(F.substring(T.seeded_order(seed, *parts), 1, 8), 16, 10).cast("bigint")


def _numbered(units: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(`units` with `unit`, numbered from 0 in the order of its columns; how many): ranges of the order are numbered side by side, whatever the number of units."""
    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = store(units.select(*columns).repartitionByRange(parts, *columns).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = store(counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all")))
    held = before.select("__all").first()
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*columns)) - 1 + F.col("__before")
    return dealt.join(F.broadcast(before), "__part").select(*columns, place.cast("bigint").alias("unit")), held[0] if held else 0


def _draws(units: DataFrame, replicates: int, columns: list[str], seed: object) -> DataFrame:
    """(replicate, times, columns...): for each replicate the drawn units, as many as there are, with how often.

    Draw d of replicate r is the unit numbered md5(seed|r|d) modulo their number.  Draws are counted before the join, and units go to every task.
    """
    numbered, n = _numbered(units, columns)
    spark = units.sparkSession
    each = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("d"))
    picked = each.select("replicate", (_word(seed, F.col("replicate"), F.col("d")) % max(n, 1)).alias("unit")).groupBy("replicate", "unit").agg(F.count("*").alias("times"))
    return picked.join(small(store(numbered)), "unit").drop("unit")


def bootstrap(units: DataFrame, replicates: int = 10_000, seed: object = 0) -> DataFrame:
    """(mean, low, high): percentile interval of sum(total) / sum(size) over resampled units (total, size).

    A unit is a query (size 1) or a cluster of queries with the sum of their differences.
    """
    draws = _draws(units, replicates, ["total", "size"], seed).groupBy("replicate").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("size"))).alias("value"))
    point = units.agg((F.sum("total") / F.sum("size")).alias("mean"))
    return point.crossJoin(draws.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high")))


def sign_flip(units: DataFrame, permutations: int = 10_000, seed: object = 0) -> DataFrame:
    """(mean, p): two-sided sign-flip test of sum(total) / sum(size), (extreme + 1) / (permutations + 1).

    The sign of a unit in permutation r is the parity of md5(seed|r|unit).  Every task turns its units into sums for each permutation, and those sums
    add up: what is shuffled is a row a permutation and task, whatever the number of units.
    """
    numbered, _ = _numbered(units, ["total", "size"])
    each = numbered.select("total", "size", "unit", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("replicate"))
    sign = 1 - 2 * (_word(seed, F.col("replicate"), F.col("unit")) % 2)
    values = each.groupBy("replicate").agg(F.abs(F.sum(F.col("total") * sign) / F.sum("size")).alias("value"))
    point = units.agg((F.sum("total") / F.sum("size")).alias("mean"))
    return values.crossJoin(F.broadcast(point)).groupBy("mean").agg(((F.count_if(F.col("value") >= F.abs("mean") - 1e-12) + 1) / (permutations + 1)).alias("p"))


def paired_summary(diff: Column) -> list[Column]:
    """Aggregates of paired differences: mean, median, and counts and shares of improved, unchanged and degraded."""
    kind = sign_class(diff)
    counts = {k: F.count_if(kind == k) for k in ("improved", "unchanged", "degraded")}
    return [F.avg(diff).alias("mean_difference"), F.median(diff).cast("double").alias("median_difference"), *[c.alias(k) for k, c in counts.items()], *[F.try_divide(c, F.count(diff)).alias(f"{k}_share") for k, c in counts.items()]]


def comparison_family(differences: DataFrame, comparisons: list[str], metrics: list[str], primary: tuple[str, str], replicates: int, permutations: int, seed: int) -> DataFrame:
    """(comparison, metric, role, mean, low, high, p, holm): a family of paired comparisons over clusters.

    `differences` is (comparison, metric, total, size), a row a cluster.  Test number i of the family, comparison by comparison, has the seed + i; one is
    primary, and the p-values of all others, the exploratory ones, are adjusted together.
    """
    parts = None
    for i, (comparison, metric) in enumerate((c, m) for c in comparisons for m in metrics):
        units = store(differences.where((F.col("comparison") == comparison) & (F.col("metric") == metric)).select("total", "size"))
        role = "primary" if (comparison, metric) == primary else "exploratory"
        row = bootstrap(units, replicates, seed + i).crossJoin(sign_flip(units, permutations, seed + i).select("p"))
        row = row.select(F.lit(comparison).alias("comparison"), F.lit(metric).alias("metric"), F.lit(role).alias("role"), "mean", "low", "high", "p")
        parts = row if parts is None else parts.unionByName(row)
    family = store(parts)
    adjusted = holm(family.where("role = 'exploratory'"), "p")
    return adjusted.unionByName(family.where("role = 'primary'").withColumn("holm", F.lit(None).cast("double")))


def cluster_macro_f1(rows: DataFrame, cluster: str, replicates: int, seed: object = 0) -> DataFrame:
    """(value, low, high): percentile interval of the gain in macro F1 of `predicted` over `other`, clusters of rows being resampled.

    Clusters enter as counts of their label combinations, a few dozen each at most.
    """
    from lodestone.operators.metrics import LABELS

    counts = [f"{kind}{k}" for kind in ("g", "p", "q", "pt", "qt") for k in range(len(LABELS))]
    hit = {"g": F.col("gold"), "p": F.col("predicted"), "q": F.col("other")}
    sums = [F.count_if(hit[kind] == label).alias(f"{kind}{k}") for kind in "gpq" for k, label in enumerate(LABELS)]
    sums += [F.count_if((F.col(c) == label) & (F.col("gold") == label)).alias(f"{kind}{k}") for kind, c in (("pt", "predicted"), ("qt", "other")) for k, label in enumerate(LABELS)]
    units = store(rows.groupBy(cluster).agg(*sums).select(*counts))
    f1 = lambda said, right: sum((F.coalesce(F.try_divide(2 * F.col(f"{right}{k}"), F.col(f"{said}{k}") + F.col(f"g{k}")), F.lit(0.0)) for k in range(len(LABELS))), F.lit(0.0)) / len(LABELS)
    gain = (f1("p", "pt") - f1("q", "qt")).alias("value")
    draws = _draws(units, replicates, counts, seed).groupBy("replicate").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in counts]).select(gain)
    point = units.agg(*[F.sum(c).alias(c) for c in counts]).select(gain)
    return point.crossJoin(draws.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high")))


def macro_f1_bootstrap(pairs: DataFrame, other: str | None = None, replicates: int = 2_000, seed: int = 0) -> DataFrame:
    """(value, low, high): macro F1 of (gold, predicted), or its gain over the column `other`, under resampled rows.

    Rows enter as counts of their label combinations, at most a few dozen: a resample is one multinomial draw.
    """
    from lodestone.operators.metrics import LABELS

    code = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(c)) - 1, F.lit(-1)).cast("int")
    columns = ["predicted", *([other] if other else [])]
    cells = pairs.select(code("gold").alias("g"), *[code(c).alias(f"p{i}") for i, c in enumerate(columns)]).groupBy("g", *[f"p{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"))
    table = cells.orderBy(*cells.columns).toPandas().to_numpy(np.int64)  # combinations of labels

    def macro(g: np.ndarray, p: np.ndarray, n: np.ndarray) -> float:
        total = 0.0
        for k in range(len(LABELS)):
            tp, said, real = n[(g == k) & (p == k)].sum(), n[p == k].sum(), n[g == k].sum()
            total += 2 * tp / (said + real) if said + real else 0.0
        return total / len(LABELS)

    def value(n: np.ndarray) -> float:
        scores = [macro(table[:, 0], table[:, i + 1], n) for i in range(len(columns))]
        return scores[0] - scores[1] if other else scores[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = int(table[:, -1].sum())
        for batch in batches:
            out = [value(np.random.default_rng([seed, int(r.as_py())]).multinomial(n, table[:, -1] / n)) for r in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["value"])

    draws = pairs.sparkSession.range(replicates if len(table) else 0).mapInArrow(run, "value double")
    point = float(value(table[:, -1])) if len(table) else None
    return draws.agg(F.lit(point).cast("double").alias("value"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
