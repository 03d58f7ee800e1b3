from __future__ import annotations

import hashlib
import io
import random
import resource
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import latency, rationales, sampling, statistics, training, validation
from lodestone.sources import files, readers, writers

ANNOTATIONS = "claim_id long, evidence map<long, array<array<int>>>"
CORPUS = "doc_id long, title string, sentences array<string>"


def test_files_beyond_two_gigabytes_in_bounded_memory(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert files.digest_of(str(tmp_path / "large.bin"))[0] == size
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert found["small.bin"] == (3, hashlib.sha256(b"abc").hexdigest()) and found["large.bin"][0] == size and len(found) == 2


def test_a_member_of_an_archive_beyond_two_gigabytes(spark, tmp_path):
    skipped = tarfile.TarInfo("zeros.bin")
    skipped.size = 2 << 30
    lines = tarfile.TarInfo("data/corpus.jsonl")
    content = "\n".join(f"line {i}" for i in range(25_000)).encode() + b"\n\n \nend"
    lines.size = len(content)
    with open(tmp_path / "large.tar", "wb") as file:
        file.write(skipped.tobuf())
        file.seek(skipped.size, io.SEEK_CUR)
        file.write(lines.tobuf() + content + b"\0" * (-len(content) % 512) + b"\0" * 1024)
    rows = readers.read_archive_lines(spark, str(tmp_path / "large.tar"), "corpus.jsonl")
    assert rows.count() == 25_001 and rows.where("line = 'end'").count() == 1


def test_archives_are_read_a_partition_each_and_small_ones_together(spark, tmp_path):
    for i in range(4):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            archive.writestr("a/corpus.jsonl", f"one {i}\n\ntwo {i}\r\n")
            archive.writestr("other.txt", "x")
    rows = files.archive_lines(spark, str(tmp_path), "corpus.jsonl")
    assert sorted(r["line"] for r in rows.collect()) == sorted(f"{w} {i}" for i in range(4) for w in ("one", "two"))
    assert rows.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="2 members end in t"):
        with zipfile.ZipFile(tmp_path / "0.zip", "a") as archive:
            archive.writestr("more.txt", "x")
        files.archive_lines(spark, str(tmp_path / "0.zip"), "t").collect()


def test_rationales_as_annotated(spark):
    corpus = spark.createDataFrame([(9, "B", ["b0", "b1"]), (10, "A", ["a0", "a1", "a2"])], CORPUS)
    good = spark.createDataFrame([(1, {10: [[1, 2]], 9: [[1]]}), (2, {}), (3, None), (4, {9: [[1, 0], [0, 1]], 10: [[2, 1]]}), (5, {10: [[2], [0]]})], ANNOTATIONS)
    assert {tuple(r) for r in rationales.rationale_pairs(good).where("claim_id = 1").collect()} == {(1, 10, 1), (1, 10, 2), (1, 9, 1)}
    assert rationales.rationale_problems(good, corpus).count() == 0
    chosen = sorted(map(tuple, rationales.gold_rationales(good, corpus).collect()), key=lambda r: (r[0], r[3]))
    assert chosen == [(1, 9, "B", 0, 1, "b1"), (4, 9, "B", 0, 0, "b0"), (4, 9, "B", 1, 1, "b1"), (5, 10, "A", 0, 0, "a0")]
    for wrong, problem in (({8: [[0]]}, "no document"), ({9: [[]]}, "empty"), ({9: [[0, 0]]}, "malformed"), ({9: [[None]]}, "malformed"), ({9: [[0], [2]]}, "out of range"), ({9: [[-1]]}, "out of range")):
        bad = spark.createDataFrame([(7, wrong), (1, {9: [[1]]})], ANNOTATIONS)
        assert [r["problem"] for r in rationales.rationale_problems(bad, corpus).collect()] == [problem]
        with pytest.raises(Exception, match=f"rationale of claim 7: {problem}"):
            rationales.gold_rationales(bad, corpus).collect()
    assert rationales.gold_rationales(good.limit(0), corpus).count() == 0


def test_coverage_by_overlap(spark):
    rows = spark.createDataFrame([([1, 2], [2]), ([1], [3]), ([], [3]), (None, [1]), ([1], None)], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(training.overlap(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_digests_count_rows_and_no_order(spark):
    rows = [(1, "a", 0.0), (2, None, -0.0), (2, None, 0.0), (None, "", float("nan"))]
    frame = lambda r, names="a long, b string, c double": spark.createDataFrame(r, names)
    digest = lambda f: tuple(validation.multiset_digest(f).first())
    assert digest(frame(rows)) == digest(frame(rows[::-1]).repartition(3)) == digest(frame(rows, "x long, y string, z double"))
    assert len({digest(frame(r)) for r in (rows, rows[:3], rows[:2], [*rows, rows[0]], [(1, "a", 0.1), *rows[1:]], [(1, None, 0.0), *rows[1:]], [])}) == 7
    a, b = frame(rows[:1] * 3 + rows[1:2]), frame(rows[:1] + rows[1:2] * 3)
    assert not validation.same_rows(a, b) and validation.same_rows(a, a.repartition(4))


def test_frozen_tables_hold_their_digest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "a long, b string")
    path = str(tmp_path / "frozen")
    assert writers.freeze(rows, path) and not writers.freeze(rows.repartition(2), path)
    assert spark.read.parquet(path).count() == 3
    for other in (rows.distinct(), rows.union(rows.limit(1)), rows.where("a = 1")):
        with pytest.raises(ValueError, match="other rows"):
            writers.freeze(other, path)
    old = str(tmp_path / "old")
    rows.write.parquet(old)
    assert not writers.freeze(rows, old)


def test_checks_publish_or_delete(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "a long, b string")
    checks = {"no a": F.col("a").isNull(), "low": F.col("a") < 2, "never": F.col("a") > 9}
    found = validation.checks_in_one_scan(rows, str(tmp_path / "good"), checks, {"no a": 1, "low": 1})
    assert found == {"rows": 3, "no a": 1, "low": 1, "never": 0} and spark.read.parquet(str(tmp_path / "good")).count() == 3
    with pytest.raises(ValueError, match="'low': 1"):
        validation.checks_in_one_scan(rows, str(tmp_path / "bad"), checks, {"no a": 1})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]
    with pytest.raises(ValueError, match="exists"):
        validation.checks_in_one_scan(rows, str(tmp_path / "good"), {})


def test_null_groups_and_labels_are_groups_and_labels(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0), (None, None), ("b", None)], "k string, v double")
    found = {r["k"]: (r["n"], r["mean"], r["p50"], r["p95_low"]) for r in latency.percentiles(rows, "k", "v").collect()}
    assert found == {"a": (2, 2.0, 2.0, 1.0), None: (2, 3.0, 3.0, 2.0), "b": (0, None, None, None)}
    groups = spark.createDataFrame([(g, None if g % 3 == 0 else "x", 1 + g % 2) for g in range(30)], "group_id long, label string, n long")
    folds = Counter((r["fold"], r["group_id"] % 3 == 0) for r in sampling.label_folds(groups, 5).collect())
    assert set(folds.values()) == {2, 4} and sum(folds.values()) == 30
    with pytest.raises(ValueError, match="several labels"):
        sampling.label_folds(spark.createDataFrame([(1, None, 1), (1, "x", 1)], "group_id long, label string, n long"), 2)


def test_intervals_of_nothing(spark):
    empty = spark.createDataFrame([(0, 0)], "k int, n int")
    assert tuple(empty.select(*statistics.wilson(F.col("k"), F.col("n"))).first()) == (None, None)
    with pytest.raises(Exception, match="an interval of no rows"):
        empty.select(*statistics.wilson(F.col("k"), F.col("n"), strict=True)).collect()


def dealt(groups: dict, k: int, seed: object) -> dict:
    """The rule of shared folds, group by group."""
    features = sorted({f for counts in groups.values() for f in counts})
    totals = {f: sum(counts.get(f, 0) for counts in groups.values()) for f in features}
    order = sorted(groups, key=lambda g: (-sum(groups[g].values()), hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g))
    loads, held, out = [Counter() for _ in range(k)], [0] * k, {}
    for g in order:
        cost = lambda i, g=g: sum(((loads[i][f] + groups[g].get(f, 0)) / (totals[f] / k)) ** 2 for f in features) + 0.05 * ((held[i] + 1) / (len(groups) / k)) ** 2
        out[g] = min(range(k), key=lambda i: (round(cost(i), 9), held[i], i))
        loads[out[g]].update(groups[g])
        held[out[g]] += 1
    return out


@pytest.mark.parametrize("case", range(4))
def test_shared_folds_as_the_sequential_rule(spark, case):
    draw = random.Random(case)
    kinds = [{}, {"a": 1}, {"a": 1, "b": 2}, {"b": 3}, {"c": 1, "a": 2}]
    groups = {g: draw.choice(kinds) if case < 3 else {f: draw.randint(1, 9) for f in "abcd" if draw.random() < 0.6} for g in range(300)}
    rows = [(g, f, n) for g, counts in groups.items() for f, n in counts.items()]
    frame = spark.createDataFrame(rows, "group_id long, feature string, n long").repartition(5)
    ids = spark.createDataFrame([(g,) for g in groups], "group_id long")
    made = {r["group_id"]: r["fold"] for r in sampling.shared_folds(frame, 5, seed=case, ids=ids).collect()}
    assert made == dealt(groups, 5, case)


def test_walked_negatives_as_by_hand(spark):
    draw = random.Random(2)
    labels = {d: draw.choice(["x", "x", "x", "y", None]) for d in range(300)}
    queries = {q: draw.choice(["x", "y", None]) for q in range(0, 300, 10)}
    excluded = {(q, d) for q in queries for d in labels if draw.random() < (0.99 if q % 20 else 0.1)} | {(0, d) for d in labels}
    place = lambda *ids: hashlib.md5("|".join(map(str, (5, *ids))).encode()).hexdigest()
    circle = sorted(labels, key=place)
    wanted = {}
    for q, own in queries.items():
        enters = sum(place(d) < place("q", q) for d in labels)
        open_ = [d for d in circle[enters:] + circle[:enters] if labels[d] != own and (q, d) not in excluded]
        if open_:
            wanted[q] = open_[0]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    made = sampling.walked_negatives(frame(queries.items(), "query_id long, label string"), frame(labels.items(), "doc_id long, label string"), frame(excluded, "query_id long, doc_id long"), 5, ahead=3)
    assert {r["query_id"]: r["doc_id"] for r in made.collect()} == wanted and 0 not in wanted and len(wanted) > 20
    assert sampling.walked_negatives(frame(queries.items(), "query_id long, label string"), frame([], "doc_id long, label string"), frame([], "query_id long, doc_id long")).count() == 0
