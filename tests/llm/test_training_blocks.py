from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.llm import attention, texthash
from tests.llm.test_quality_urls_lm_warc import counted

DOCS = "doc_id long, text string, lang string"


def test_runs_follow_from_the_texts_not_from_the_batches(monkeypatch):
    monkeypatch.setattr(attention, "LAID", 11)
    draw = random.Random(2)
    rows = [(block, bytes(draw.randrange(256) for _ in range(2 * draw.randrange(9)))) for block in (0, 1, 4) for _ in range(30)]
    rows.append((5, b""))
    made = []
    for size in (1, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]], pa.int32()), pa.array([r[1] for r in rows[i : i + size]], pa.binary())], ["block", "codes"]) for i in range(0, len(rows), size)]
        made.append([(block, codes.tolist(), n.tolist()) for block, codes, n in attention.block_runs(iter(batches))])
        assert [(b, c) for b, codes, n in made[-1] for c in np.split(np.array(codes, np.uint16).tolist(), np.cumsum(n)[:-1]) for c in [list(map(int, c))]] == [(b, np.frombuffer(x, np.uint16).tolist()) for b, x in rows]
    assert made[0] == made[1] == made[2] and len(made[0]) > 20


def test_scores_do_not_follow_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(attention, "BLOCK_IDS", 700)
    draw = random.Random(1)
    words = [f"word{i}" for i in range(80)] + ["harbour", "papers", "unusual"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 40))), "en") for i in range(140)] + [(200, None, "en"), (201, "", "en"), (3, "again", "en")]
    made = []
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, DOCS).repartition(parts)
        made.append(sorted((r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in attention.scored(frame).collect()))
    for a, b in zip(*made, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 * a[1] and abs(a[3] - b[3]) < 1e-4 * a[1]


def by_softmax(model, codes):
    """(log P of the classes of a text of at most a window, what multiplies `out`, chances less goals) in double precision, by the softmax as it is written."""
    context, goal, _ = model.stream(codes, np.array([len(codes)]))
    context, goal, w = context[:-1], goal[:-1], {k: v.astype(float) for k, v in model.layer.items()}
    x, here = w["embed"][model.last[context]], np.arange(len(context))
    scores = (x @ w["q"]) @ (x @ w["k"]).T + w["near"][np.maximum(here[:, None] - here[None, :], 0)]
    scores[here[:, None] < here[None, :]] = -np.inf
    weight = np.exp(scores - scores.max(1, keepdims=True))
    gated = weight @ (x @ w["v"]) / weight.sum(1, keepdims=True) * (1 + x @ w["gate"])
    logits = gated @ w["out"] + model.after[context]
    logs = logits - logits.max(1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(1, keepdims=True))
    off = np.exp(logs)
    off[here, goal] -= 1
    return logs[here, goal].sum(), gated, off


def test_classes_are_judged_by_a_true_softmax():
    # `wide` takes logits out of the range in which a float holds their exponentials
    for wide in (1.0, 400.0):
        _, model, ids, _ = counted()
        rng = np.random.RandomState(4)
        model.layer = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in model.layer.items()}
        model.layer["out"] *= np.float32(wide)
        codes = np.tile(model.symbol[ids], 4)[: attention.WINDOW - 1].astype(np.uint16)
        value, gated, off = by_softmax(model, codes)
        assert wide == 1 or np.abs(gated @ model.layer["out"]).max() > 100
        # the second half of a window sees all of it, the first half its own: together the text is one window
        assert abs(model.class_sums(codes, np.array([len(codes)]))[0] - value) < 2e-5 * abs(value)
        trainer, seen = attention.Trainer(model, 0.0), {}
        trainer._move = lambda name, d, seen=seen: seen.__setitem__(name, d)
        context, goal, _ = model.stream(codes, np.array([len(codes)]))
        trainer.step(context[None, :-1], goal[:-1])
        want = gated.T @ off / len(off)
        assert np.abs(seen["out"] - want).max() < 1e-4 * np.abs(want).max()


def test_distinct_hashes_are_those_of_unique():
    rng = np.random.RandomState(2)
    spread = rng.randint(0, 300, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # the last ones agree in all but the low bits, where places are kept
    for h in (spread, spread[:1], spread[:0], rng.randint(0, 40, 1000).astype(np.uint64)):
        for got, want in zip(attention._distinct(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)


def test_matrices_fall_together_as_each_would_alone():
    _, model, ids, _ = counted()
    rng = np.random.RandomState(4)
    # matrices at and beyond their bounds
    model.layer = {k: v if k == "embed" else (v + rng.standard_normal(v.shape) * 0.25).astype(np.float32) for k, v in model.layer.items()}
    model.layer["near"] += 3.99
    codes = np.tile(model.symbol[ids], 4)[: attention.WINDOW - 1].astype(np.uint16)
    context, goal, _ = model.stream(codes, np.array([len(codes)]))
    trainer, calls = attention.Trainer(model, 0.05), []
    fall = trainer._fall
    trainer._fall = lambda *a: (calls.append(len(a[0])), fall(*a))
    alone = {k: (v.astype(float), np.full(v.shape, 1e-6)) for k, v in model.layer.items() if k != "embed"}
    for _ in range(3):
        trainer.step(context[None, :-1], goal[:-1])
        for k, (value, size) in alone.items():
            d = trainer.gradient_of[k].astype(float)
            size[...] = 0.99 * size + 0.01 * d * d
            value -= 0.05 * d / (np.sqrt(size) + 1e-6)
            value[...] = value * min(1.0, attention._MOST / np.linalg.norm(value)) if k in ("q", "k", "v", "gate") else value.clip(-4, 4)
            assert np.abs(trainer.layer[k] - value).max() < 1e-3, k
    assert len(calls) == 3 and (trainer.layer["embed"] == model.layer["embed"]).all()
    trainer.move_vectors()
    assert len(calls) == 4 and (trainer.layer["embed"] != model.layer["embed"]).any()
    assert all((model.layer[k] != trainer.layer[k]).any() for k in attention._LAYER)


def test_hashes_of_a_slice_take_no_new_memory_by_the_byte():
    data = np.frombuffer(b"some words of a text " * 20_000, np.uint8)
    starts, ends, _ = texthash.word_spans(data, np.array([0, len(data)]))
    starts, ends = starts[:100], ends[:100]
    first = texthash.span_hashes(data, starts, ends)
    tracemalloc.start()
    again = texthash.span_hashes(data, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(data) and (first == again).all()
    # a smaller slice after a larger one, and the larger one after it
    assert (texthash.span_hashes(data[:2100], starts, ends) == first).all() and (texthash.span_hashes(data, starts, ends) == first).all()


def test_words_among_all_bytes():
    data = bytes(b for a in range(256) for b in (a, 97, a, a, 98))
    starts, ends, upto = texthash.word_spans(np.frombuffer(data, np.uint8), np.array([0, 640, 1280]))
    want = [(m.start() + at, m.end() + at) for at in (0, 640) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data[at : at + 640])]
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want and upto[-1] == len(want)
