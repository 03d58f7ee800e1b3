from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jump, mixing, queries
from lodestone.llm.texthash import mix
from tests.llm.test_decontamination_chat import brute as leaking
from tests.llm.test_near_dedup import brute as near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    vocabulary = [f"term{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(4)]
    docs, labels = [], []
    for i in range(260):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        kind = i % 13
        if kind == 1:
            words[3:3] = ["horrid", "horrid"]
        if kind == 2:
            words = [w.upper() + "!!" for w in words]
        if kind == 3 and i > 30:
            words = docs[i - 6][1].split()  # a clean document again
        if kind == 4:
            words += items[i % 4][1].split() + ["end"]
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text)))
        if i < 200 and kind != 3:
            labels.append((i, int(kind != 2), int(kind == 1)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "no id at all but many fine words here", "en", "s1", 37), docs[5], docs[5]]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, items


def test_stages_one_by_one(spark, corpus, tmp_path):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns, name
        before = docs.collect()
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((name, before, docs.collect()))
    names, before, after = zip(*kept, strict=True)
    assert names == ("quality", "near_dedup", "decontaminate", "mix", "shard")
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    gone = set(ids(before[0])) - set(ids(after[0]))
    bad = {i for i in range(260) if i % 13 in (1, 2)}
    # a fitted model on 185 labels: held-out accuracy, not certainty
    assert len(bad - gone) <= 0.1 * len(bad) and len(gone - bad) <= 0.05 * (len(ids(before[0])) - len(bad))
    groups = near([(r["doc_id"], r["text"]) for r in before[1]], 5, 80)
    assert ids(after[1]) == Counter({i: 1 if i is not None else n for i, n in Counter(i for i, _, _, k in groups if k or i is None).items()})
    flagged = {d for d, _ in leaking([(r["doc_id"], r["text"], "") for r in before[2]], [(*i, "") for i in items])}
    assert flagged and ids(after[2]) == Counter(r["doc_id"] for r in before[2] if r["doc_id"] not in flagged)
    blocks = Counter()
    for r in mixing.mixed(spark.read.parquet(f"{tmp_path}/2")).collect():
        blocks[r["doc_id"]] += len(r["blocks"])
    assert ids(after[3]) == +blocks
    keys = mix(np.array([r["doc_id"] if r["doc_id"] is not None else -1 for r in after[4]], np.int64).astype(np.uint64))
    assert [r["shard"] for r in after[4]] == jump.jump_hash(keys, 16).tolist()


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    long = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [
        (5, long, "en", "s", 1), (5, other, "en", "s", 2), (5, other, "en", "s", 2), (9, long + " end", "en", "s", 3), (None, long, "en", "s", 4),
        (7, None, "en", "s", 5), (7, None, "en", "s", 6), (8, "", "en", "s", 7), (None, other + " x", "en", "s", 8), (11, "alone " * 30_000, "en", "s", 9),
    ]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "n_chars AS __group", "lang AS component_id")
    made = corpus_pipeline.near_dedup(spark, docs, "")
    assert made.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] and r["text"][:5], r["n_chars"]) for r in made.collect())
    assert got == sorted([("5", "word0", 1), ("5", "other", 2), ("7", None, 5), ("7", None, 6), ("8", "", 7), ("11", "alone", 9)])


def test_an_empty_corpus_passes_all_stages(spark, corpus, tmp_path):
    folder, items = corpus
    docs = spark.createDataFrame([], DOCS + ", shard string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_quality_stage_drops_few_clean_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    gone = {r["doc_id"] for r in docs.collect() if r["doc_id"] not in kept and (r["doc_id"] is None or r["doc_id"] % 13 not in (1, 2) or r["doc_id"] >= 260)}
    # a null, an empty and a foreign text, and one more: the measured count, in README
    assert {900, 901, None} <= gone and len(gone) <= 4


def test_long_texts_in_the_last_stages(spark, corpus):
    folder, _ = corpus
    rows = [(1, "word " * 200_000, "en", "a", 1_000_000), (2, None, "en", "a", None), (3, "few words", "en", None, 9), (3, "few words", "en", None, 9)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = corpus_pipeline.mix(spark, docs, folder)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 3}
    made = corpus_pipeline.shard(spark, docs, folder).collect()
    assert len(made) == 4 and sorted(r["size"] for r in made) == [1, 10, 10, 1_000_001]


def test_run_is_the_query_and_repeats(spark, corpus):
    folder, _ = corpus
    key = lambda df: sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(queries.QUERIES["pipeline"](spark, folder))


def test_columns_of_any_name_come_back_from_every_stage(spark, corpus, tmp_path):
    folder, _ = corpus
    names = ("size", "target", "taken", "blocks", "number", "full", "rest", "row", "order", "cell", "part", "rows", "bounds", "n", "item_id", "component_id", "grade", "a.b", "x y")
    held = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("no")), F.lit(" "))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *[F.concat(held, F.lit(name)).alias(name) for name in names])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert rows, name
        for row in rows:
            start = "no" if row["doc_id"] is None else row["doc_id"]
            assert all(row[c] == f"{start} {c}" for c in names if name != "shard" or c != "size"), name
