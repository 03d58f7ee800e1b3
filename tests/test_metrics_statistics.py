from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import latency, metrics, retrieval, statistics, training


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_ranking_metrics_at_the_edges(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 10), (2, 10, 100), (2, 12, 101), (4, 10, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 10), (2, 12), (3, 10)], "query_id long, doc_id long")
    out = {r["query_id"]: r for r in metrics.ir_metrics(ranking, qrels).collect()}
    assert set(out) == {1, 2, 3}
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert out[1]["ndcg_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(11)) / ideal)
    assert (out[1]["recall_10"], out[1]["mrr_10"]) == (pytest.approx(2 / 3), 0.5)
    assert (out[2]["recall_100"], out[2]["recall_10"], out[2]["mrr_10"]) == (0.5, 0.0, 0.0)
    assert (out[3]["ndcg_10"], out[3]["recall_100"]) == (0.0, 0.0)


def test_macro_f1_of_a_published_confusion_matrix(spark):
    # rows of gold SUPPORT, CONTRADICT, INSUFFICIENT; the last column is unparsable output
    table = {"SUPPORT": (92, 8, 23, 1), "CONTRADICT": (13, 38, 13, 0), "INSUFFICIENT": (17, 15, 80, 0)}
    rows = [(g, p) for g, counts in table.items() for p, n in zip((*metrics.LABELS, "INVALID"), counts, strict=True) for _ in range(n)]
    each = metrics.classification(spark.createDataFrame(rows, "gold string, predicted string")).collect()
    assert each[0]["macro_f1"] == pytest.approx(0.6859, abs=5e-5) and each[0]["accuracy"] == pytest.approx(0.7)
    grid = {(r["gold"], r["predicted"]): r["n"] for r in metrics.confusion(spark.createDataFrame(rows, "gold string, predicted string")).collect()}
    assert grid["SUPPORT", "INVALID"] == 1 and grid["CONTRADICT", "INVALID"] == 0 and len(grid) == 12


def test_absent_labels_count_nothing(spark):
    each = {r["label"]: r for r in metrics.classification(spark.createDataFrame([("SUPPORT", "SUPPORT")], "gold string, predicted string")).collect()}
    assert each["SUPPORT"]["macro_f1"] == pytest.approx(1 / 3) and each["CONTRADICT"]["f1"] == 0.0


def test_calibration_by_hand(spark):
    rows = [("SUPPORT", [0.3, 0.3, 0.4]), ("SUPPORT", [1.0, 0.0, 0.0]), ("CONTRADICT", [0.5, 0.0, 0.5])]
    out = one(metrics.calibration(spark.createDataFrame(rows, "gold string, probabilities array<double>")))
    assert out["n"] == 3 and out["accuracy"] == pytest.approx(1 / 3)
    assert out["ece"] == pytest.approx((0.4 + 0.0 + 0.5) / 3)
    assert out["brier"] == pytest.approx((0.49 + 0.09 + 0.16 + 0 + 0.25 + 1 + 0.25) / 3)
    assert out["nll"] == pytest.approx((-math.log(0.3) + 0 - math.log(1e-300)) / 3)


def test_rationales_take_the_best_alternative(spark):
    rows = spark.createDataFrame([(1, [0, 1], [[5], [1, 2]]), (2, [], [[1]]), (3, [1], [])], "id int, predicted array<int>, alternatives array<array<int>>")
    out = {r["id"]: r for r in metrics.rationale_scores(rows).collect()}
    assert (out[1]["precision"], out[1]["recall"], out[1]["f1"]) == (0.5, 0.5, 0.5)
    assert (out[2]["precision"], out[2]["f1"]) == (0.0, 0.0) and out[3]["f1"] is None


def test_closed_forms(spark):
    rows = spark.createDataFrame([(58, 106), (85, 20), (34, 38), (0, 0), (0, 5), (3, 3)], "b int, c int").withColumn("p", statistics.mcnemar(F.col("b"), F.col("c")))
    p = {(r["b"], r["c"]): r["p"] for r in rows.collect()}
    assert p[58, 106] == pytest.approx(2.207e-4, rel=1e-3) and p[85, 20] == pytest.approx(1.008e-10, rel=1e-3) and p[34, 38] == pytest.approx(0.7239, abs=5e-5)
    assert p[0, 0] == 1 and p[0, 5] == pytest.approx(2 / 32) and p[3, 3] == 1
    family = statistics.holm(spark.createDataFrame([(0.001,), (0.5,), (0.02,)], "p double")).collect()
    assert {r["p"]: round(r["holm"], 9) for r in family} == {0.001: 0.003, 0.02: 0.04, 0.5: 0.5}
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    out = spark.createDataFrame([(10, 50), (1, 50), (0, 0)], "k int, n int").select("k", low.alias("l"), high.alias("h")).collect()
    assert [(round(r["l"], 4), round(r["h"], 4)) for r in out[:2]] == [(0.1124, 0.3304), (0.0035, 0.105)] and out[2]["l"] is None


def test_resampling_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    units = spark.createDataFrame([(float(x), 1.0) for x in rng.normal(0.3, 1, 60)], "total double, size double")
    a, b = one(statistics.bootstrap(units, 500)), one(statistics.bootstrap(units.repartition(7), 500))
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-12) and a["low"] < a["mean"] < a["high"]
    values = np.sort([r["total"] for r in units.collect()])
    word = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    draws = [values[[word(0, r, d) % 60 for d in range(60)]].mean() for r in range(500)]
    assert a["low"] == pytest.approx(np.percentile(draws, 2.5)) and a["high"] == pytest.approx(np.percentile(draws, 97.5))
    flips = [abs(sum(v * (1 - 2 * (word(0, r, u) % 2)) for u, v in enumerate(values)) / 60) for r in range(99)]
    assert one(statistics.sign_flip(units, 99))["p"] == pytest.approx((sum(f >= abs(values.mean()) - 1e-12 for f in flips) + 1) / 100)
    p = one(statistics.sign_flip(units, 999))["p"]
    assert 0 < p < 0.2
    none = one(statistics.sign_flip(spark.createDataFrame([(0.0, 2.0), (0.0, 1.0)], "total double, size double"), 99))
    assert none["p"] == 1.0


def test_macro_f1_interval_holds_its_value(spark):
    rows = [("SUPPORT", "SUPPORT", "CONTRADICT"), ("CONTRADICT", "CONTRADICT", "CONTRADICT"), ("INSUFFICIENT", "INVALID", "SUPPORT")] * 30
    out = one(statistics.macro_f1_bootstrap(spark.createDataFrame(rows, "gold string, predicted string, other string"), "other", 300))
    assert out["low"] <= out["value"] <= out["high"] and out["value"] == pytest.approx(2 / 3 - (2 / 3) / 3)


def test_cluster_gain_in_macro_f1(spark):
    rows = [(k % 12, "SUPPORT", "SUPPORT", "CONTRADICT") for k in range(40)] + [(k % 12, "CONTRADICT", "INVALID", "CONTRADICT") for k in range(20)]
    out = one(statistics.cluster_macro_f1(spark.createDataFrame(rows, "c int, gold string, predicted string, other string"), "c", 200))
    assert out["low"] <= out["value"] <= out["high"] and out["value"] == pytest.approx((1 - 2 * 20 / 80) / 3)


def test_rankings_and_queries_that_are_refused(spark):
    qrels = spark.createDataFrame([(1, 10)], "query_id long, doc_id long")
    twice = spark.createDataFrame([(1, 10, 1), (1, 10, 2)], "query_id long, doc_id long, rank int")
    with pytest.raises(Exception, match="stands twice"):
        metrics.ir_metrics(twice, qrels).collect()
    with pytest.raises(ValueError, match="query 2 has no positive"):
        metrics.ir_metrics(twice, qrels, spark.createDataFrame([(1,), (2,)], "query_id long"))
    second = spark.createDataFrame([(1, 10, float("inf"))], "query_id long, doc_id long, second double")
    with pytest.raises(Exception, match="not finite"):
        retrieval.reranked_prefix(twice.limit(1), second, 3).collect()


def test_containment_as_brute_force(spark):
    docs = [(1, "Say: the Harbour opens at noon, on Sundays."), (2, "the harbour opens at noon"), (3, "xthe Harbour opens at noony"), (4, None), (5, "one two")]
    items = [(1, "the Harbour opens at noon"), (2, "two"), (3, ""), (4, None), (5, "opens never at noon"), (6, "Harbour opens")]
    found = retrieval.containment(spark.createDataFrame(items, "query_id long, item string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(i, d) for i, item in items for d, text in docs if item is not None and text is not None and item in text}


def test_coverage_changes_and_hits(spark):
    before, after = (spark.createDataFrame(r, "query_id long, doc_id long, rank int") for r in ([(1, 10, 1), (1, 11, 2), (2, 20, 1)], [(1, 11, 1), (1, 10, 2), (2, 20, 1)]))
    marked = spark.createDataFrame([(1, 11), (2, 99)], "query_id long, doc_id long")
    assert tuple(one(training.coverage(before, marked, (1, 3)))) == (2, 0.0, 0.5)
    assert tuple(one(training.top_changes(before, after, marked))) == (1, 1, 0) and tuple(one(training.top_changes(after, before, marked))) == (1, 0, 1)
    spots = spark.createDataFrame([(1, 11, 4), (2, 20, 1)], "query_id long, doc_id long, sentence_index long")
    passages = spark.createDataFrame([(1, 11, 3, 1), (1, 11, 4, 2), (2, 21, 1, 1)], "query_id long, doc_id long, sentence_index long, rank int")
    assert tuple(one(training.sentence_hits(passages, spots))) == (2, 0, 1, 1)
    arms = spark.createDataFrame([(1, "x", 20, 1), (1, "y", 20, 1), (2, "x", 11, 1), (2, "y", 12, 1)], "query_id long, arm string, doc_id long, negative int")
    positives = spark.createDataFrame([(1, 11), (2, 20)], "query_id long, doc_id long")
    prints = spark.createDataFrame([(11, "p"), (12, "p"), (20, "q")], "doc_id long, fingerprint string")
    assert one(training.negative_audit(positives, arms, prints)).asDict() == {"queries": 2, "overlap_slots": 1, "cross_x": 2, "cross_y": 1, "duplicate_contents": 1}
    assert {(r["query_id"], r["arm"]): r["negative_ids"] for r in training.paired_rows(positives, arms).collect()} == {(1, "x"): [20], (1, "y"): [20], (2, "x"): [11], (2, "y"): [12]}


def test_softmax_and_dot(spark):
    out = one(spark.range(1).select(vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))).alias("p"), vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"), vectors.unit(F.array(F.lit(0.0))).alias("u")))
    assert out["p"] == [0.5, 0.5, 0.0] and out["d"] == 11.0 and out["u"] is None


def test_percentile_conventions(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 301)] + [("b", 7.0), ("c", None)], "k string, v double")
    out = {r["k"]: r for r in latency.percentiles(rows, "k", "v").collect()}
    assert out["a"]["p95_low"] == 285.0 and out["a"]["p95"] == pytest.approx(np.percentile(range(1, 301), 95)) and out["a"]["p50"] == 150.5
    assert out["b"]["p95_low"] == 7.0 and out["c"]["n"] == 0


def test_dense_search_as_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.integers(-2, 3, (60, 4)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(99, None)], "doc_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(q, vecs[q].tolist()) for q in range(6)], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.dense_topk(queries, corpus, 7).collect()}
    for q in range(6):
        order = sorted(range(60), key=lambda d: (-round(float(vecs[q] @ vecs[d]), 9), d))
        assert [got[q, k] for k in range(1, 8)] == order[:7]
    retrieval.QUERY_ROWS, old = 2, retrieval.QUERY_ROWS
    try:
        assert {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.dense_topk(queries, corpus, 7).collect()} == got
    finally:
        retrieval.QUERY_ROWS = old
    assert retrieval.dense_topk(queries.limit(0), corpus, 3).count() == 0


def test_bm25_fills_ranks_and_weighs_common_terms(spark):
    corpus = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, None), (5, "cat")], "doc_id long, text string")
    out = retrieval.bm25_topk(spark.createDataFrame([(7, "CAT, cat bird")], "query_id long, text string"), corpus, 5).orderBy("rank").collect()
    idf = {"cat": math.log(5 - 3 + 0.5) - math.log(3.5), "dog": math.log(4.5 / 1.5), "bird": math.log(4.5 / 1.5), "fish": math.log(4.5 / 1.5)}
    cat = 0.25 * sum(idf.values()) / 4
    length = 7 / 5
    w = lambda i, tf, n: i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / length))
    score = {1: 2 * w(cat, 1, 2), 2: 2 * w(cat, 2, 3) + w(idf["bird"], 1, 3), 5: 2 * w(cat, 1, 1), 3: 0.0, 4: 0.0}
    assert [r["doc_id"] for r in out] == sorted(score, key=lambda d: (-score[d], d))
    assert all(r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-8) for r in out)


def test_reranking_keeps_the_tail_and_refuses_gaps(spark):
    ranking = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 6, 7, 8], 1)], "query_id long, doc_id long, rank int")
    second = spark.createDataFrame([(1, 5, 0.1), (1, 6, 0.9), (1, 7, 0.9), (1, 8, 5.0)], "query_id long, doc_id long, second double")
    out = {r["doc_id"]: r["new_rank"] for r in retrieval.reranked_prefix(ranking, second, 3).collect()}
    assert out == {6: 1, 7: 2, 5: 3, 8: 4}
    with pytest.raises(Exception, match="not finite"):
        retrieval.reranked_prefix(ranking, second.where("doc_id <> 6"), 3).collect()


def test_hard_negatives_skip_positives_and_copies(spark):
    ranking = spark.createDataFrame([(1, d, r) for r, d in enumerate([10, 11, 12, 13, 14, 15], 1)], "query_id long, doc_id long, rank int")
    positives = spark.createDataFrame([(1, 10)], "query_id long, doc_id long")
    prints = spark.createDataFrame([(10, "p"), (11, "p"), (12, "x"), (13, "x"), (14, "y"), (15, "z")], "doc_id long, fingerprint string")
    assert [r["doc_id"] for r in retrieval.hard_negatives(ranking, positives, prints, 2).orderBy("negative").collect()] == [12, 14]


def test_hard_negatives_of_short_rankings(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2)], "query_id long, doc_id long, rank int")
    positives = spark.createDataFrame([(1, 10), (2, 12), (2, 13)], "query_id long, doc_id long")
    prints = spark.createDataFrame([(10, "p"), (11, "x"), (12, "y"), (13, "z")], "doc_id long, fingerprint string")
    with pytest.raises(Exception, match="too few negatives"):
        retrieval.hard_negatives(ranking, positives, prints, 2).collect()
    assert [tuple(r) for r in retrieval.hard_negatives(ranking, positives, prints, 2, strict=False).collect()] == [(1, 11, 2, 1)]


def test_metrics_from_counts_of_positives(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11), (1, 13), (2, 14)], "query_id long, doc_id long")
    counts = spark.createDataFrame([(1, 2), (2, 1)], "query_id long, n_pos long")
    assert sorted(metrics.ir_metrics(ranking, qrels.where("doc_id = 11"), counts=counts).collect()) == sorted(metrics.ir_metrics(ranking, qrels).collect())
