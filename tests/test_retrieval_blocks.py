from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, sampling

VECTORS = "doc_id long, vector array<double>"


def brute(queries: dict, corpus: dict, k: int) -> dict:
    out = {}
    for q, v in queries.items():
        scored = [(-round(float(np.dot(v, w)), 9), d) for d, w in corpus.items() if len(w) == len(v)]
        out[q] = [d for _, d in sorted(scored)[:k]]
    return out


def made(hits) -> dict:
    out: dict = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_searches_of_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    draw = np.random.default_rng(0)
    corpus = {i: draw.normal(size=8).round(2).tolist() for i in range(900)} | {1000 + i: [1.0, 2.0] for i in range(4)}
    corpus |= {2000 + i: corpus[i] for i in range(40)}  # ties
    queries = {i: draw.normal(size=8).round(2).tolist() for i in range(20)} | {50: [0.5, 0.5], 51: [0.0] * 8}
    odd = [(3000, None), (3001, []), (3002, [None] * 8), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (None, [0.0] * 8)]
    frame = spark.createDataFrame([*corpus.items(), *odd], VECTORS).repartition(5)
    asked = spark.createDataFrame([*queries.items(), (60, None), (61, []), (62, [1.0] * 3)], "query_id long, vector array<double>")
    blocks = retrieval.vector_blocks(frame, rows=64)
    assert blocks.count() > 10
    hits, _ = retrieval.indexed_topk(asked, blocks, 11)
    assert made(retrieval.ranked(hits, 11)) == brute(queries, corpus, 11)
    assert made(retrieval.dense_topk(asked, frame, 3)) == brute(queries, corpus, 3)
    assert retrieval.dense_topk(asked, frame.limit(0), 3).count() == 0


def test_far_blocks_are_not_searched(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16)) * 10
    rows = [(i, (centres[i % 12] + draw.normal(size=16) * 0.1).tolist()) for i in range(1800)]
    blocks = retrieval.vector_blocks(spark.createDataFrame(rows, VECTORS), rows=100, pivots=64)
    queries = [(i, (centres[i] / np.linalg.norm(centres[i])).tolist()) for i in range(12)]
    hits, pairs = retrieval.indexed_topk(spark.createDataFrame(queries, "query_id long, vector array<double>"), blocks, 20)
    assert made(retrieval.ranked(hits, 20)) == brute(dict(queries), dict(rows), 20)
    assert pairs.count() < 0.5 * 12 * blocks.count()


def okapi(queries: dict, docs: dict, k: int) -> dict:
    tokens = {d: t.split() for d, t in docs.items()}
    df = Counter(w for t in tokens.values() for w in set(t))
    mean_length = sum(map(len, tokens.values())) / len(docs)
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = {}
    for q, text in queries.items():
        scored = []
        for d, t in tokens.items():
            tf, s = Counter(t), 0.0
            for w in text.split():
                if tf[w]:
                    s += (idf[w] if idf[w] >= 0 else 0.25 * mean) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean_length))
            scored.append((-round(s, 9), d))
        out[q] = [d for _, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_bm25_over_blocks_is_exact_and_skips(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 9)
    seen = []
    real = retrieval.best_first
    monkeypatch.setattr(retrieval, "best_first", lambda *a: seen.append(real(*a)) or seen[-1])
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = {i: " ".join(draw.choices(words, k=draw.randrange(1, 60), weights=[1 / (j + 1) for j in range(200)])) for i in range(600)}
    docs |= {700 + i: "rare words here " + docs[i] for i in range(6)}
    queries = {i: " ".join(draw.choices(words, k=5)) for i in range(20)} | {30: "rare words here", 31: "nothing of this", 32: "w1 w1 w2"}
    found = retrieval.bm25_topk(spark.createDataFrame(list(queries.items()), "query_id long, text string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4), 5)
    assert made(found) == okapi(queries, docs, 5)
    if block == 16:
        searched = Counter(r["query_id"] for r in seen[0][1].collect())
        assert searched[30] <= 12 < 38 == len({r["block"] for r in spark.range(606).select(F.pmod(F.xxhash64("id"), F.lit(38)).alias("block")).collect()})


def test_similar_sets_of_all_sizes_and_shares(spark):
    draw = random.Random(8)
    for percent in (50, 80, 100):
        sets = {}
        for i in range(160):
            if i % 3 and sets:
                items = set(draw.choice(list(sets.values())))
                for _ in range(draw.randrange(4)):
                    items ^= {f"t{draw.randrange(60)}"}
            else:
                items = {f"t{draw.randrange(60)}" for _ in range(draw.randrange(1, 40))}
            sets[i] = items
        wanted = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        frame = spark.createDataFrame([(i, [*x, *x][: len(x) + i % 2]) for i, x in sets.items()], "id long, items array<string>").repartition(3)
        got = {tuple(r) for r in sampling.similar_sets(frame, percent).collect()}
        reps = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        assert got == {(a, b) for a, b in wanted if reps[b] == b and reps[a] == a or reps[b] == a}


def near_copies(draw, families, copies, size):
    sets = {}
    for k in range(families):
        first = [f"t{draw.randrange(4 * size)}" for _ in range(size)]
        for _ in range(copies):
            changed = set(first) ^ {f"t{draw.randrange(4 * size)}" for _ in range(draw.randrange(1 + size // 6))}
            sets[len(sets)] = changed
    return sets


def test_similar_sets_in_cells_and_blocks(spark, monkeypatch):
    for name, n in {"LARGE": 30, "CELL": 2000, "NAMED": 40, "BLOCK": 1500, "PAIRS": 50, "SKETCHED": 16}.items():
        monkeypatch.setattr(sampling, name, n)
    draw = random.Random(4)
    sets = {}
    for size in (12, 60, 300, 1500):
        sets |= {len(sets) + i: {f"{size} {w}" for w in x} for i, x in near_copies(draw, 3, 20, size).items()}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    reps = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items() if x], "id long, items array<string>").repartition(3)
    got = sorted(tuple(r) for r in sampling.similar_sets(frame, 80).collect())
    assert got == sorted((a, b) for a, b in wanted if sets[a] and (reps[b] == b and reps[a] == a or reps[b] == a)) and len(got) > 500


def test_similar_sets_store_few_pairs_and_each_set_once(spark, monkeypatch):
    draw = random.Random(6)
    sets = near_copies(draw, 1, 80, 40) | {100 + i: {f"t{draw.randrange(45)}" for _ in range(45)} for i in range(400)}
    stored = []
    store = sampling.store
    monkeypatch.setattr(sampling, "store", lambda df: stored.append((df.columns, (out := store(df)).count())) or out)
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<string>")
    found = sampling.similar_sets(frame, 80).count()
    named = max(n for columns, n in stored if columns[:2] == ["x", "y"])
    needed = [n for columns, n in stored if columns == ["of_cell", "of_i", "of_j", "rep"]]
    assert found > 400 and named < 3 * found  # pairs are written after sketches were compared
    assert needed and max(needed) <= len(sets)  # a set goes to its candidates' cell, not to each candidate


def test_postings_are_counted_within_rows(spark, monkeypatch):
    docs = {1: "b a b, A _x", 2: "", 3: None, 4: "é e é"}
    made = retrieval.postings(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {tuple(r) for r in made.select("doc_id", "term", "length", "tf").collect()} == {(1, "a", 5, 2), (1, "b", 5, 2), (1, "_x", 5, 1), (4, "é", 3, 2), (4, "e", 3, 1)}
    plans = []
    monkeypatch.setattr(retrieval, "store", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    retrieval.postings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8))
    assert "HashAggregate" not in plans[0] and "SortAggregate" not in plans[0]


def test_random_negatives_over_blocks(spark, monkeypatch):
    from hashlib import md5

    monkeypatch.setattr(sampling, "DRAWN", 7)
    docs = [(i, i % 3) for i in range(100)] + [(200, None), (None, 1)]
    excluded = [(q, d) for q in (0, 10) for d in range(0, 60)]
    made = sampling.random_negatives(spark.createDataFrame([(0, 0), (10, 1), (20, 2)], "query_id long, label int"), spark.createDataFrame(docs, "doc_id long, label int"), spark.createDataFrame(excluded, "query_id long, doc_id long"), 7)
    key = lambda q, d: md5(f"7|{q}|{d}".encode()).hexdigest()
    wanted = {(q, min((d for d, x in docs if d is not None and x is not None and x != label and (q, d) not in excluded), key=lambda d: key(q, d))) for q, label in ((0, 0), (10, 1), (20, 2))}
    assert {tuple(r) for r in made.collect()} == wanted
