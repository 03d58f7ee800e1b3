from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import jump, mixing

DOCS = "doc_id long, text string, source string, size string, slot string, extra int"


def rows():
    rng = np.random.RandomState(0)
    out = []
    for i in range(400):
        source = ["hot", "b", "a", "z", None, "é"][0 if i % 3 == 0 else i % 6]
        out.append((i, " ".join(["w"] * int(rng.choice([0, 1, 5, 60, 400]))), source, "s", "t", i))
    return [*out, (None, "x y", "a", "s", "t", 1), (None, None, "b", "s", "t", 1), (5, out[5][1], out[5][2], "s", "t", 1), (900, "one\x0btwo\x0cthree four \r\n", "a", "s", "t", 2)]


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = goal - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    data = rows()
    made = mixing.mixed(spark.createDataFrame(data, DOCS), shards=5)
    assert made.columns == ["doc_id", "text", "source", "slot", "extra", "size", "source_size", "target", "taken", "blocks"]
    out = made.collect()
    assert len(out) == len(data)
    sizes = defaultdict(int)
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    target, taken, shard = expected_targets(sizes), Counter(), defaultdict(Counter)
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(b["words"] for b in r["blocks"])
        taken[r["source"]] += r["taken"]
        for b in r["blocks"]:
            shard[b["shard"]][r["source"]] += 1
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    assert max(map(Counter.total, shard.values())) - min(map(Counter.total, shard.values())) <= 3
    again = mixing.mixed(spark.createDataFrame(data, DOCS).repartition(7), shards=5)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_quotas_of_the_tree_add_up_and_vary_like_draws(spark):
    quotas = spark.createDataFrame([(0, 900), (1, 90), (2, 7), (3, 0)], "number int, blocks long")
    seen = []
    for seed in range(6):
        got = {r["number"]: [0, *r["bounds"]] for r in mixing.shard_quotas(quotas, 6, seed).collect()}
        each = {k: np.diff(v) for k, v in got.items()}
        assert {k: int(v.sum()) for k, v in each.items()} == {0: 900, 1: 90, 2: 7, 3: 0}
        assert all((v >= 0).all() for v in each.values())
        sizes = sum(each.values())
        assert sizes.max() - sizes.min() <= 2
        seen += each[1].tolist()
    # 90 of 997 drawn by sixths: mean 15, variance 90 / 6 * 5 / 6 * 907 / 996
    assert abs(np.mean(seen) - 15) < 1e-9 and 4 < np.var(seen) < 24


def test_drawn_documents_are_whole_but_for_the_cut_ones(spark):
    data = spark.createDataFrame(rows(), DOCS)
    taken = Counter()
    for r in mixing.mixed(data.withColumn("k", F.lit(1))).collect():
        taken[r["doc_id"], r["extra"]] += r["taken"]
    made = mixing.drawn_documents(data)
    assert made.columns == data.columns
    words = Counter()
    for r in made.collect():
        words[r["doc_id"], r["extra"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert +words == +taken


def test_mixing_nothing_and_no_words(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    empty = mixing.mixed(spark.createDataFrame([(1, "", "a", "", "", 1), (2, None, None, "", "", 1)], DOCS)).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def scalar_jump(key, n):
    key, b, j = int(key), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.RandomState(3).randint(0, 1 << 62, 3000).astype(np.uint64)
    for n in (1, 2, 16, 17, 100):
        assert jump.jump_hash(keys, n).tolist() == [scalar_jump(k, n) for k in keys]
    old, new = jump.jump_hash(keys, 16), jump.jump_hash(keys, 17)
    moved = old != new
    assert (new[moved] == 16).all() and 0.03 < moved.mean() < 0.09


def test_shards_and_slots(spark):
    data = [*rows(), *[(5, None, "a", "s", "t", 3)] * 20]
    made = jump.sharded(spark.createDataFrame(data, DOCS), 16, cells=8)
    assert made.columns == ["doc_id", "text", "source", "extra", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    slots, where = defaultdict(list), {}
    for r in made.collect():
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert where.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(data)
    assert jump.sharded(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_hashes_ids_once_in_a_task(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{tmp_path}/docs")
    made = jump.sharded(spark.read.parquet(f"{tmp_path}/docs"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # one for the rows, one for the counts of their cells, whose scans are stages of their own
    assert len(re.findall("ArrowEvalPython", plan)) == 2


def test_mixing_runs_no_python_on_executors(spark):
    text = mixing.mixed(spark.createDataFrame(rows(), DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)
