"""Integrity checks: each returns the rows that violate it, and none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions import text as T


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n): keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def id_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids missing, extra or repeated in `actual`."""
    a, b = expected.select(key).distinct(), actual.groupBy(key).agg(F.count("*").alias("n"))
    missing = a.join(b, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = b.join(a, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return missing.unionByName(extra).unionByName(b.where("n > 1").select(key, F.lit("repeated").alias("problem")))


def overlaps(parts: DataFrame, key: str, part: str = "part") -> DataFrame:
    """(key, parts): keys that stand in more than one part."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("parts")).where("size(parts) > 1")


def outside(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """The rows whose column is null or not among the values."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def dangling(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands nowhere in the target."""
    return rows.join(target.select(key).distinct(), key, "left_anti")


def bad_indices(rows: DataFrame, indices: str, size: Column) -> DataFrame:
    """The rows with an index below 0 or not below the size."""
    return rows.where(~F.forall(indices, lambda i: (i >= 0) & (i < size)))


def text_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key): rows of both whose texts differ in more than white space."""
    both = left.select(key, T.collapsed(F.col("text")).alias("a")).join(right.select(key, T.collapsed(F.col("text")).alias("b")), key)
    return both.where("NOT (a <=> b)").select(key)


def drifted(stored: DataFrame, recomputed: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """(key, stored, recomputed): aggregates that differ by more than the tolerance or stand on one side only."""
    both = stored.select(key, F.col(value).alias("stored")).join(recomputed.select(key, F.col(value).alias("recomputed")), key, "full")
    return both.where(F.col("stored").isNull() | F.col("recomputed").isNull() | (F.abs(F.col("stored") - F.col("recomputed")) > tolerance))


def reordered(before: DataFrame, after: DataFrame, by: str, doc: str) -> DataFrame:
    """(by): groups whose candidate set changed in a reranking."""
    sets = [d.groupBy(by).agg(F.array_sort(F.collect_list(doc)).alias(name)) for d, name in ((before, "a"), (after, "b"))]
    return sets[0].join(sets[1], by, "full").where("NOT (a <=> b)").select(by)


def multiset_digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest): the number of rows, and 256 bits that do not depend on their order but on how often each stands.

    Eight lanes of 32 bits of each row's SHA-256 are summed; tables add up lane by lane.  Columns count by place, not by name; -0.0 is 0.0.
    """
    floats = {"double", "float"}
    values = [(F.col(f"`{c}`") + F.lit(0.0) if kind in floats else F.col(f"`{c}`")).alias(f"c{i}") for i, (c, kind) in enumerate(rows.dtypes)]
    each = rows.select(F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias("h"))
    lanes = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = each.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(lane), F.lit(0)).alias(f"s{i}") for i, lane in enumerate(lanes)])
    digits = [F.lpad(F.lower(F.hex((F.col(f"s{i}") % F.lit(1 << 32)).cast("bigint"))), 8, "0") for i in range(8)]
    return sums.select("n", F.concat(*digits).alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repetitions counted: their digests are compared, each made in one scan."""
    return len(a.columns) == len(b.columns) and multiset_digest(a).first() == multiset_digest(b).first()


def checks_in_one_scan(rows: DataFrame, path: str, checks: dict[str, Column], allowed: dict[str, int] | None = None) -> dict[str, int]:
    """Write `rows` to `path` while counting the rows that break each check (a condition that is true of a violation); returns the counts.

    The counts are observed by the tasks that write, so a table is scanned once whatever the number of checks.
    It is written beside `path` and moved there only where no check is broken by more rows than `allowed` (none);
    otherwise what was written is deleted and the counts are raised.  An existing path raises.  "rows" counts all.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = where(path), where(f"{path.rstrip('/')}__unchecked")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise ValueError(f"{path} exists")
    observed = Observation()
    counts = [F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in checks.items()]
    rows.observe(observed, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(aside.toString())
    found = {name: int(n) for name, n in observed.get.items()}
    broken = {name: found[name] for name in checks if found[name] > (allowed or {}).get(name, 0)}
    if broken:
        system.delete(aside, True)
        raise ValueError(f"{path}: rows break {broken}")
    if not system.rename(aside, target):
        raise ValueError(f"{path} could not be published")
    return found


def label_gate(rows: DataFrame, label: str) -> DataFrame:
    """(available, reason): whether every row of a table has its label, or none, or only some."""
    state = rows.agg(F.count("*").alias("n"), F.count(label).alias("k"))
    reason = F.when(F.col("n") == 0, "no rows").when(F.col("k") == 0, "labels hidden").when(F.col("k") < F.col("n"), "labels incomplete").otherwise("labels complete")
    return state.select(((F.col("n") > 0) & (F.col("k") == F.col("n"))).alias("available"), reason.alias("reason"))


def filter_rule(score: Column, rule: str, most: float | None = None) -> Column:
    """Whether a candidate passes a pool's rule: absolute_score_max (inclusive), drop_all or no_filter."""
    if rule == "absolute_score_max":
        return F.coalesce(score <= F.lit(float(most)), F.lit(False))
    if rule in ("drop_all", "no_filter"):
        return F.lit(rule == "no_filter")
    raise ValueError(f"unknown filter rule {rule!r}")


def kept_pools(audit: DataFrame, threshold: float) -> DataFrame:
    """(pool, n, contaminated, kept): whether a pool's share of contaminated audit rows (pool, contaminated boolean) is within the threshold."""
    counts = audit.groupBy("pool").agg(F.count("*").alias("n"), F.count_if("contaminated").alias("contaminated"))
    return counts.withColumn("kept", F.col("contaminated") <= F.col("n") * F.lit(threshold))


#: Columns that a pool row must have.
POOL_COLUMNS = ("claim_id", "doc_id", "condition", "source_split", "claim_gold_label", "pair_annotation", "context_label", "rationale_sentences", "retrieval_score", "filter_version", "filter_status")


def pool_problems(rows: DataFrame, versions: dict[str, str], most: dict[str, float]) -> DataFrame:
    """(claim_id, doc_id, condition, problem): rows that break what their condition A to D asks for, one row a problem.

    A rows carry their gold label as annotation and context, with a rationale.  B, C and D rows are unannotated,
    insufficient and without one; B and C need the filter version of their pool and its approval, B a score within its
    bound.  MIXED claims belong in A alone.  `versions` and `most` are by condition.  Missing columns raise.
    """
    missing = [c for c in POOL_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    condition, gold = F.col("condition"), F.col("condition") == "A"
    version = F.element_at(F.create_map(*[F.lit(x) for pair in (versions or {"": ""}).items() for x in pair]), condition)
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in (most or {"": 0.0}).items() for x in pair]), condition)
    none = F.coalesce(F.size("rationale_sentences"), F.lit(0)) <= 0
    sided = F.coalesce(F.col("pair_annotation").isin("SUPPORT", "CONTRADICT"), F.lit(False))
    found = {
        "condition": ~F.coalesce(condition.isin("A", "B", "C", "D"), F.lit(False)),
        "split": ~F.col("source_split").eqNullSafe("TRAIN"),
        "gold": gold & (~sided | ~F.col("context_label").eqNullSafe(F.col("pair_annotation")) | none),
        "negative": ~gold & (F.col("pair_annotation").isNotNull() | ~F.col("context_label").eqNullSafe("INSUFFICIENT") | ~none),
        "filter": condition.isin("B", "C") & (~F.col("filter_version").eqNullSafe(version) | ~F.col("filter_status").eqNullSafe("approved")),
        "score": bound.isNotNull() & F.coalesce(F.col("retrieval_score") > bound + 1e-12, F.lit(True)),
        "mixed": ~gold & F.col("claim_gold_label").eqNullSafe("MIXED"),
    }
    listed = F.filter(F.array(*[F.when(F.coalesce(is_so, F.lit(False)), name) for name, is_so in found.items()]), lambda x: x.isNotNull())
    return rows.select("claim_id", "doc_id", "condition", F.explode(listed).alias("problem"))


def cluster_problems(expected: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """(key, problem): `clusters` (members array) must hold every expected key exactly once."""
    return id_differences(expected, clusters.select(F.explode("members").alias(key)), key)


def sentence_problems(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id): documents (doc_id, sentences array) whose passages (doc_id, sentence_index, text) are not all of their sentences, each unchanged and once."""
    wanted = docs.select("doc_id", F.posexplode("sentences").alias("sentence_index", "text"))
    sides = [d.groupBy("doc_id", "sentence_index").agg(F.count("*").alias(f"n{k}"), F.min("text").alias(f"t{k}")) for k, d in ((1, wanted), (2, passages))]
    both = sides[0].join(sides[1], ["doc_id", "sentence_index"], "full")
    return both.where("NOT (n1 <=> n2) OR NOT (t1 <=> t2)").select("doc_id").distinct()


def derived_problems(rows: DataFrame, key: str, product: str, factors: tuple[str, str], tolerance: float = 1e-12) -> DataFrame:
    """(key, problem): rows where a stored product is missing or differs from its factors' by more than the tolerance."""
    a, b, c = F.col(factors[0]), F.col(factors[1]), F.col(product)
    problem = F.when(a.isNull() | b.isNull() | c.isNull(), "missing").when(F.abs(c - a * b) > tolerance, "differs")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def pin_differences(hashes: DataFrame, pins: DataFrame) -> DataFrame:
    """(path, problem): files (path, sha256) that differ from their pins, are missing or have none."""
    both = hashes.select("path", F.col("sha256").alias("a")).join(pins.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "not pinned").when(F.col("a") != F.col("b"), "changed").alias("problem")).where("problem IS NOT NULL")


def resolved_labels(rows: DataFrame, by: str, label: str, strict: bool = False) -> DataFrame:
    """(by, label): no decided label gives INSUFFICIENT, one gives itself, several give MIXED, or raise where `strict`."""
    decided = rows.groupBy(by).agg(F.array_sort(F.collect_set(F.when(F.col(label) != "INSUFFICIENT", F.col(label)))).alias("s"))
    several = F.raise_error(F.concat(F.lit("conflicting labels of "), F.col(by).cast("string"))).cast("string") if strict else F.lit("MIXED")
    return decided.select(by, F.when(F.size("s") == 0, "INSUFFICIENT").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(several).alias("label"))


def pair_conflicts(rows: DataFrame, *pair: str, label: str = "label") -> DataFrame:
    """(pair..., labels): pairs with more than one decided label."""
    return rows.where(F.col(label) != "INSUFFICIENT").groupBy(*pair).agg(F.array_sort(F.collect_set(label)).alias("labels")).where("size(labels) > 1")
