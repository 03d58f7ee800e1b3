"""Training and evaluation rows built from rankings, positives and folds, and the audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.metrics import LABELS


def rank_score(rank: Column, top: int = 100) -> Column:
    """A strictly falling score from a rank: `top` for the first."""
    return F.lit(top + 1) - rank


def listed_ranking(scores: Column) -> Column:
    """The ids of a map from id to score, best first, ties by id: a ranking that is a list stays one."""
    entries = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("id"))))
    return F.transform(entries, lambda e: e["id"])


def first_per_label(rows: DataFrame, label: str, by: str) -> DataFrame:
    """(label, by): the first row of each label."""
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(by).alias(by))


def paired_rows(positives: DataFrame, arms: DataFrame) -> DataFrame:
    """(query_id, positive_id, arm, negative_ids): every positive (query_id, doc_id) with the negatives of every arm (query_id, arm, doc_id, negative)."""
    lists = arms.groupBy("query_id", "arm").agg(F.array_sort(F.collect_list(F.struct("negative", "doc_id"))).alias("n"))
    lists = lists.select("query_id", "arm", F.transform("n", lambda x: x["doc_id"]).alias("negative_ids"))
    return positives.select("query_id", F.col("doc_id").alias("positive_id")).distinct().join(lists, "query_id")


def unpaired(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The keys that two arms do not both hold the same number of times."""
    sides = [d.groupBy(*keys).agg(F.count("*").alias(name)) for d, name in ((left, "a"), (right, "b"))]
    return sides[0].join(sides[1], list(keys), "full").where("NOT (a <=> b)").select(*keys)


def negative_audit(positives: DataFrame, arms: DataFrame, prints: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row (queries, overlap_slots, duplicate_contents) and cross_<arm>: the counters of a mined training set.

    overlap_slots counts a query's documents that stand in more than one arm, cross_<arm> the negatives of an arm
    that are a positive of another query and not of their own, and duplicate_contents the documents of `prints`
    beyond the first of each fingerprint.  `names` are the arms, for those that may have no rows.
    """
    arms = arms.select("query_id", "arm", "doc_id").distinct()
    own = positives.select("query_id", "doc_id").distinct()
    crossed = arms.join(own, ["query_id", "doc_id"], "left_anti").join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    names = names or sorted(r[0] for r in arms.select("arm").distinct().collect())  # a few arms
    crosses = crossed.agg(*[F.count_if(F.col("arm") == a).alias(f"cross_{a}") for a in names])
    overlap = arms.groupBy("query_id", "doc_id").count().agg(F.count_if(F.col("count") > 1).alias("overlap_slots"))
    totals = arms.agg(F.countDistinct("query_id").alias("queries")).crossJoin(overlap).crossJoin(crosses)  # single rows
    return totals.crossJoin(prints.agg((F.count("*") - F.countDistinct("fingerprint")).alias("duplicate_contents")))


def overlap(a: Column, b: Column) -> Column:
    """Whether two id arrays share any id; false for empty ones."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def coverage(ranking: DataFrame, annotated: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row (eligible, top<k>...): the share of queries with an annotated document that have one among the first k."""
    best = annotated.select("query_id", "doc_id").distinct().join(ranking, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.agg(F.count("*").alias("eligible"), *[F.avg((F.coalesce("best", F.lit(1 << 30)) <= k).cast("double")).alias(f"top{k}") for k in ks])


def top_changes(before: DataFrame, after: DataFrame, marked: DataFrame) -> DataFrame:
    """One row (unchanged, promoted, demoted): how the first document of queries changed, into or out of the marked (query_id, doc_id)."""
    one, two = (d.where("rank = 1").select("query_id", F.col("doc_id").alias(name)) for d, name in ((before, "a"), (after, "b")))
    marks = marked.select("query_id", "doc_id").distinct()
    both = one.join(two, "query_id")
    for side in ("a", "b"):
        both = both.join(marks.select("query_id", F.col("doc_id").alias(side), F.lit(True).alias(f"in_{side}")), ["query_id", side], "left")
    was, now = (F.coalesce(f"in_{side}", F.lit(False)) for side in ("a", "b"))
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("unchanged"), F.count_if(~was & now).alias("promoted"), F.count_if(was & ~now).alias("demoted"))


def sentence_hits(passages: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row (eligible, top<k>_hits..., selected_document): over queries with targets (query_id, doc_id, sentence_index).

    `passages` is (query_id, doc_id, sentence_index, rank); selected_document counts first passages of a target's document.
    """
    spots = targets.select("query_id", "doc_id", "sentence_index").distinct()
    best = spots.join(passages, ["query_id", "doc_id", "sentence_index"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    chosen = passages.where("rank = 1").select("query_id", "doc_id").join(spots.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select("query_id", F.lit(1).alias("selected")).distinct()
    return best.join(chosen, "query_id", "left").agg(F.count("*").alias("eligible"), *[F.count_if(F.col("best") <= k).alias(f"top{k}_hits") for k in ks], F.count("selected").alias("selected_document"))


def condition_rankings(**conditions: DataFrame) -> DataFrame:
    """(condition, query_id, doc_id, rank): rankings of several conditions as one table."""
    parts = [d.select(F.lit(name).alias("condition"), "query_id", "doc_id", "rank") for name, d in conditions.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_rows(rows: DataFrame, folds: DataFrame, k: int, by: str = "group_id") -> DataFrame:
    """`rows` with fold and part, once per fold: valid where the row's group is dealt to the fold, train elsewhere; a group without a fold raises."""
    dealt = rows.join(folds.select(by, F.col("fold").alias("__own")), by, "left")
    own = F.coalesce("__own", F.raise_error(F.lit("a group without a fold")).cast("bigint"))
    each = dealt.withColumn("__own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.withColumn("part", F.when(F.col("fold") == F.col("__own"), "valid").otherwise("train")).drop("__own")


def epoch_order(rows: DataFrame, seed: int, epochs: int, key: str) -> DataFrame:
    """`rows` with epoch and order_key once per epoch: sorted by epoch and order_key, every epoch has an order of its own, the same on every run."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return each.withColumn("order_key", T.seeded_order(seed, F.col("epoch"), F.col(key)))


def order_fingerprint(ordered: DataFrame, key: str) -> DataFrame:
    """(epoch, n, order_sha): a digest of each epoch's order; sums over the 4,096 parts of the order keys, so no task holds an order."""
    part = F.substring("order_key", 1, 3)
    cells = ordered.groupBy("epoch", part.alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_key", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ","), 256).alias("h"))
    listed = cells.groupBy("epoch").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "h"))).alias("all"))
    return listed.select("epoch", "n", F.sha2(F.array_join(F.transform("all", lambda x: x["h"]), ""), 256).alias("order_sha"))


def sampler_shard(place: Column, workers: int) -> Column:
    """The worker of the row at a place, from 0, of an epoch's order: rows are dealt in turn."""
    return F.pmod(place, F.lit(workers)).cast("int")


def few_shot_problems(examples: DataFrame, train: DataFrame, dev: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """(problem): what is wrong with few-shot examples (claim_id, decision); none for `least` to `most` rows of training claims with all labels."""
    state = examples.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("decision")).alias("labels"))
    leaks = examples.join(train.select("claim_id").distinct(), "claim_id", "left_anti").unionByName(examples.join(dev.select("claim_id").distinct(), "claim_id", "left_semi")).agg(F.count("*").alias("leaks"))
    found = F.array(
        F.when((F.col("n") < least) | (F.col("n") > most), "count"), F.when(F.col("leaks") > 0, "not of the training split"), F.when(F.col("labels") != F.array(*[F.lit(x) for x in sorted(LABELS)]), "labels")
    )
    return state.crossJoin(leaks).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def seed_average(rows: DataFrame, by: str, arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """(by, <first>, <second>, difference): averages over seeds per `by` and arm, side by side."""
    means = rows.groupBy(by).pivot(arm, list(arms)).agg(F.avg(value))
    return means.withColumn("difference", F.col(arms[0]) - F.col(arms[1]))


def seed_class(values: Column, reference: Column, tolerance: float = 1e-12) -> Column:
    """all_improve, all_degrade, all_tie or mixed, of an array of one value a seed against the reference."""
    d = F.transform(values, lambda v: v - reference)
    return F.when(F.forall(d, lambda x: x > tolerance), "all_improve").when(F.forall(d, lambda x: x < -tolerance), "all_degrade").when(F.forall(d, lambda x: F.abs(x) <= tolerance), "all_tie").otherwise("mixed")


def margin_ranking(candidates: DataFrame, score: str, simplicity: str, margin: float = 0.005, most: int = 10_000) -> DataFrame:
    """`candidates` with place: again and again the simplest of those within `margin` of the best that is left.

    A few candidates are compared: they are folded as one array, in order of simplicity, by an expression; more than `most` raise.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(simplicity).alias("s"), F.col(score).cast("double").alias("v"))))
    few = candidates.agg(F.count("*").alias("n"), listed.alias("all")).select(F.when(F.col("n") <= most, F.col("all")).otherwise(F.raise_error(F.lit("too many candidates")).cast(candidates.select(F.array(F.struct(F.col(simplicity).alias("s"), F.col(score).cast("double").alias("v")))).schema[0].dataType)).alias("all"))
    fold = f"""
      aggregate(all, named_struct('left', transform(all, (x, i) -> named_struct('s', x.s, 'v', x.v, 'i', i)), 'done', slice(transform(all, x -> x.s), 1, 0)),
        (state, x) -> transform(array(array_max(transform(state.left, y -> y.v))), top -> transform(array(filter(state.left, y -> top - y.v <= {margin!r}D)[0]), chosen ->
          named_struct('left', filter(state.left, y -> y.i <> chosen.i), 'done', array_append(state.done, chosen.s)))[0])[0],
        state -> state.done)"""
    places = few.select(F.posexplode(F.expr(fold)).alias("place", simplicity)).withColumn("place", F.col("place") + 1)
    return candidates.join(F.broadcast(places), simplicity)  # `most` rows


def schedule(rows: Column, batch: int, epochs: int, warmup: float) -> Column:
    """struct(steps_per_epoch, total_steps, warmup_steps) of a training run over so many rows."""
    per = F.ceil(rows / batch)
    return F.struct(per.alias("steps_per_epoch"), (per * epochs).alias("total_steps"), F.ceil(per * epochs * warmup).alias("warmup_steps"))


def claim_problem(claim: Column, k: Column, longest: int = 20_000) -> Column:
    """What is wrong with a request: too long, empty once trimmed, or k outside 1 to 10; null where nothing is."""
    return F.when(claim.isNull() | (F.length(claim) > longest), "length").when(F.btrim(claim, F.lit(" \t\n\r\x0b\x0c")) == "", "empty").when(~F.coalesce(k.between(1, 10), F.lit(False)), "k")
