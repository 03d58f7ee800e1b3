from __future__ import annotations

import io
import json
import random
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing
from lodestone.functions import text as T
from lodestone.operators import sampling, training, validation
from lodestone.operators.graph import connected_components
from lodestone.sources import readers, writers
from lodestone.streaming import requests


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(100, 180)] + [(7, 7), (500, 500), (None, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    low = {}
    for x in parent:
        low[root(x)] = min(low.get(root(x), x), x)
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: low[root(x)] for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_similar_sets_as_brute_force(spark):
    rng = random.Random(3)
    sets = [(i, [f"t{rng.randrange(14)}" for _ in range(rng.choice([0, 1, 4, 9, 20]))]) for i in range(90)]
    sets += [(100, ["a", "b", "c", "d", "e"]), (101, ["a", "b", "c", "d"]), (102, ["e", "d", "c", "b", "a", "a"]), (103, None)]
    got = connected_components(sampling.similar_sets(spark.createDataFrame(sets, "id long, items array<string>")), "a", "b").collect()
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))]
    low = {i: i for e in links for i in e}
    for _ in range(len(low)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert {r["id"]: r["component_id"] for r in got} == low


def greedy(sizes, fraction):
    goal, taken, dev = round(sum(n for _, n in sizes) * fraction), 0, set()
    for g, n in sizes:
        if abs(taken + n - goal) < abs(taken - goal):
            taken += n
            dev.add(g)
    return dev


def test_group_split_as_the_sequential_rule(spark, monkeypatch):
    import hashlib

    rng = random.Random(5)
    for case, most in enumerate((1, 4, 90)):
        sizes = {g: rng.randint(1, most) for g in range(150)}
        rows = [(10_000 * g + i, g) for g, n in sizes.items() for i in range(n)]
        order = sorted(sizes, key=lambda g: (hashlib.md5(f"{case}|{g}".encode()).hexdigest(), g))
        for limit in (5_000, 1):
            monkeypatch.setattr(sampling, "SPLIT_ROWS", limit)
            out = sampling.group_split(spark.createDataFrame(rows, "id long, group_id long"), 0.2, case).collect()
            assert {r["group_id"] for r in out if r["side"] == "dev"} == greedy([(g, sizes[g]) for g in order], 0.2)


def test_published_mixtures(spark):
    pools = {"A": 456, "B": 86, "C": 5716, "D": 647}
    for shares, quota in (((0.45, 0.2, 0.2, 0.15), (194, 86, 86, 64)), ((0.6, 0.15, 0.15, 0.1), (344, 86, 86, 57))):
        rows = spark.createDataFrame([(p, s, n) for (p, n), s in zip(pools.items(), shares, strict=True)], "pool string, share double, available long")
        assert tuple(r["quota"] for r in sampling.hamilton(rows).orderBy("pool").collect()) == quota


def test_mixture_takes_the_first_in_md5_order(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(500)], "id long, pool string")
    quotas = spark.createDataFrame([("a", 40), ("b", 0)], "pool string, quota long")
    got = {r["id"] for r in sampling.mixture(rows, quotas, 9).collect()}
    all_a = rows.where("pool = 'a'").orderBy(T.seeded_order(9, F.col("pool"), F.col("id"))).limit(40).collect()
    assert got == {r["id"] for r in all_a}


def by_md5(groups, seed):
    import hashlib

    return sorted(groups, key=lambda g: (hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g))


def test_label_folds_as_the_sequential_rule(spark):
    rng = random.Random(1)
    for case, most in enumerate((1, 3, 40)):
        groups = {g: (rng.choice("xyz"), rng.randint(1, most)) for g in range(200)}
        got = {r["group_id"]: r["fold"] for r in sampling.label_folds(spark.createDataFrame([(g, *v) for g, v in groups.items()], "group_id long, label string, n long"), 5, case).collect()}
        totals, wanted = [0] * 5, {}
        for label in "xyz":
            rows = [0] * 5
            for g in sorted(by_md5([g for g, v in groups.items() if v[0] == label], case), key=lambda g: -groups[g][1]):
                fold = min(range(5), key=lambda i: (rows[i], totals[i], i))
                wanted[g] = fold
                rows[fold] += groups[g][1]
                totals[fold] += groups[g][1]
        assert got == wanted
    with pytest.raises(ValueError, match="several labels"):
        sampling.label_folds(spark.createDataFrame([(1, "x", 1), (1, "y", 1)], "group_id long, label string, n long"), 2)
    assert sampling.label_folds(spark.createDataFrame([], "group_id long, label string, n long"), 2).count() == 0


def test_shared_folds_keep_groups_whole_and_features_even(spark):
    rng = random.Random(1)
    groups = [(g, f, rng.randint(1, 3)) for g in range(300) for f in ("a:x", "a:y", "b:x") if rng.random() < 0.7]
    frame = spark.createDataFrame(groups, "group_id long, feature string, n long")
    folds = {r["group_id"]: r["fold"] for r in sampling.shared_folds(frame, 4).collect()}
    assert set(folds) == {g for g, *_ in groups} and folds == {r["group_id"]: r["fold"] for r in sampling.shared_folds(frame.repartition(5), 4).collect()}
    loads, sizes = Counter(), Counter(folds.values())
    for g, f, n in groups:
        loads[f, folds[g]] += n
    assert all(max(loads[x, f] for f in range(4)) < 1.15 * min(loads[x, f] for f in range(4)) for x in ("a:x", "a:y", "b:x"))
    assert max(sizes.values()) - min(sizes.values()) <= 8
    # few groups of every kind: the cost decides them one by one, by hand
    few = [(1, "p", 4), (2, "p", 3), (3, "q", 3), (4, "q", 1)]
    got = {r["group_id"]: r["fold"] for r in sampling.shared_folds(spark.createDataFrame(few, "group_id long, feature string, n long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_fold_parts_and_restricted_groups(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, group_id long")
    folds = spark.createDataFrame([(10, 0), (11, 1)], "group_id long, fold int")
    parts = {(r["id"], r["fold"]): r["part"] for r in training.fold_rows(rows, folds, 2).collect()}
    assert parts == {(1, 0): "valid", (2, 0): "valid", (3, 0): "train", (1, 1): "train", (2, 1): "train", (3, 1): "valid"}
    with pytest.raises(Exception, match="without a fold"):
        training.fold_rows(rows, folds.where("fold = 0"), 2).collect()
    assert {tuple(r) for r in sampling.restricted_groups(rows, spark.createDataFrame([(3,)], "id long")).collect()} == {(3, 11)}


def test_samples_that_come_out_short_raise(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert sampling.seeded_sample(rows, 5, "x", "id").count() == 2
    with pytest.raises(ValueError, match="fewer"):
        sampling.seeded_sample(rows, 5, "x", "id", strict=True)
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, pool string")
    quotas = spark.createDataFrame([("a", 1), ("b", 1)], "pool string, quota long")
    with pytest.raises(ValueError, match="twice"):
        sampling.mixture(twice, quotas, 1, unique=True)


def test_pool_rules(spark):
    fields = "claim_id long, doc_id long, condition string, source_split string, claim_gold_label string, pair_annotation string, context_label string, rationale_sentences array<int>, retrieval_score double, filter_version string, filter_status string"
    good = {
        "A": (1, 1, "A", "TRAIN", "SUPPORT", "SUPPORT", "SUPPORT", [0], None, None, None), "B": (1, 2, "B", "TRAIN", "SUPPORT", None, "INSUFFICIENT", [], 0.3, "v1", "approved"),
        "D": (1, 3, "D", "TRAIN", "SUPPORT", None, "INSUFFICIENT", None, None, None, None),
    }
    names = [f.split()[0] for f in fields.split(", ")]
    change = lambda c, **k: tuple((dict(zip(names, good[c], strict=True)) | k).values())
    wrong = [(change("A", rationale_sentences=[]), "gold"), (change("A", context_label="CONTRADICT"), "gold"), (change("B", pair_annotation="SUPPORT"), "negative"), (change("B", filter_status=None), "filter")]
    wrong += [(change("B", retrieval_score=0.9), "score"), (change("D", claim_gold_label="MIXED"), "mixed"), (change("D", source_split="DEV"), "split"), (change("D", condition="E"), "condition")]
    check = lambda rows: [(r["problem"]) for r in validation.pool_problems(spark.createDataFrame(rows, fields), {"B": "v1"}, {"B": 0.5}).collect()]
    assert check(list(good.values())) == []
    for row, problem in wrong:
        assert check([row]) == [problem]
    with pytest.raises(ValueError, match="missing columns"):
        validation.pool_problems(spark.range(1), {}, {})
    with pytest.raises(ValueError, match="unknown filter"):
        validation.filter_rule(F.col("s"), "other")
    scores = spark.createDataFrame([(0.5,), (0.6,), (None,)], "s double")
    assert [scores.where(validation.filter_rule(F.col("s"), *r)).count() for r in (("absolute_score_max", 0.5), ("drop_all",), ("no_filter",))] == [1, 0, 3]


def test_integrity_of_clusters_sentences_products_and_pins(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    clusters = spark.createDataFrame([([1, 2],), ([2, 9],)], "members array<long>")
    assert {tuple(r) for r in validation.cluster_problems(ids, clusters, "id").collect()} == {(3, "missing"), (9, "extra"), (2, "repeated")}
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d"])], "doc_id long, sentences array<string>")
    passages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (3, 0, "d"), (3, 0, "d")], "doc_id long, sentence_index int, text string")
    assert sorted(r["doc_id"] for r in validation.sentence_problems(docs, passages).collect()) == [2, 3]
    times = spark.createDataFrame([(1, 6.0, 2.0, 3.0), (2, 7.0, 2.0, 3.0), (3, None, 2.0, 3.0)], "k long, p double, a double, b double")
    assert {tuple(r) for r in validation.derived_problems(times, "k", "p", ("a", "b")).collect()} == {(2, "differs"), (3, "missing")}
    made, pins = (spark.createDataFrame(r, "path string, sha256 string") for r in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {tuple(r) for r in validation.pin_differences(made, pins).collect()} == {("b", "changed"), ("c", "not pinned"), ("d", "missing")}
    labels = spark.createDataFrame([(1, "SUPPORT"), (1, "CONTRADICT"), (2, "SUPPORT"), (2, "INSUFFICIENT"), (3, "INSUFFICIENT")], "k long, l string")
    assert {tuple(r) for r in validation.resolved_labels(labels, "k", "l").collect()} == {(1, "MIXED"), (2, "SUPPORT"), (3, "INSUFFICIENT")}
    with pytest.raises(Exception, match="conflicting labels of 1"):
        validation.resolved_labels(labels, "k", "l", strict=True).collect()
    assert [tuple(r) for r in validation.pair_conflicts(labels, "k", label="l").collect()] == [(1, ["CONTRADICT", "SUPPORT"])]


def test_training_rows_and_requests(spark):
    claim = spark.createDataFrame([(" ok ", 1), (" \n", 1), ("x" * 20_001, 1), (None, 1), ("a", 0), ("a", 11), ("a", None)], "c string, k int")
    assert [r[0] for r in claim.select(training.claim_problem(F.col("c"), F.col("k"))).collect()] == [None, "empty", "length", "length", "k", "k", "k"]
    shots = spark.createDataFrame([(1, "SUPPORT"), (2, "CONTRADICT"), (3, "INSUFFICIENT")], "claim_id long, decision string")
    assert training.few_shot_problems(shots, shots, shots.limit(0)).count() == 0
    assert {r[0] for r in training.few_shot_problems(shots.where("claim_id < 3"), shots, shots.where("claim_id = 1")).collect()} == {"count", "not of the training split", "labels"}
    left, right = (spark.createDataFrame(r, "q long, p long") for r in ([(1, 2), (1, 3)], [(1, 2), (1, 2)]))
    assert {tuple(r) for r in training.unpaired(left, right, "q", "p").collect()} == {(1, 2), (1, 3)}
    listed = spark.sql("SELECT map('a', 0.5, 'b', 0.9, 'c', 0.5) AS m").select(training.listed_ranking(F.col("m")).alias("l")).first()["l"]
    assert listed == ["b", "a", "c"]
    classes = spark.createDataFrame([([1.0, 2.0], 0.5), ([0.1], 0.5), ([0.5, 0.5], 0.5), ([0.4, 0.6], 0.5)], "v array<double>, r double").select(training.seed_class(F.col("v"), F.col("r")).alias("c"))
    assert [r["c"] for r in classes.collect()] == ["all_improve", "all_degrade", "all_tie", "mixed"]
    systems = spark.createDataFrame([("a", 0.700), ("b", 0.704), ("c", 0.708)], "name string, f1 double")
    assert {r["name"]: r["place"] for r in training.margin_ranking(systems, "f1", "name").collect()} == {"b": 1, "a": 3, "c": 2}
    steps = spark.range(1).select(training.schedule(F.lit(17), 8, 3, 0.1).alias("s")).first()["s"]
    assert tuple(steps) == (3, 9, 1)


def test_quota_picks_do_not_repeat(spark):
    rows = spark.createDataFrame([(i, i, i % 2) for i in range(10)], "id int, rank int, odd int")
    out = sampling.quota_picks(rows, [("odd", F.col("odd") == 1, 2), ("any", F.lit(True), 3)]).collect()
    assert [(r["id"], r["stratum"]) for r in sorted(out, key=lambda r: (r["stratum"] != "odd", r["id"]))] == [(1, "odd"), (3, "odd"), (0, "any"), (2, "any"), (4, "any")]


def test_strict_verdicts():
    good = {"label": "SUPPORT", "evidence_ids": ["1"], "explanation": "it says so"}
    assert parsing.verdict(json.dumps(good), ["1", "2"]) == ("SUPPORT", ["1"], "it says so", [])
    assert parsing.verdict(" " + json.dumps(good | {"evidence_ids": []}) + "\n", []) == ("SUPPORT", [], "it says so", [])
    wrong = [(None, "invalid_json:TypeError"), ("nope", "invalid_json:JSONDecodeError"), ("[1]", "output_not_object"), (good | {"x": 1}, "schema_keys"), (good | {"label": "MAYBE"}, "invalid_label"), (good | {"evidence_ids": [1]}, "invalid_evidence_ids_type")]
    wrong += [(good | {"evidence_ids": ["1", "1"]}, "duplicate_evidence_ids"), (good | {"evidence_ids": ["3"]}, "invented_evidence_id"), (good | {"label": "INSUFFICIENT"}, "insufficient_with_citations"), (good | {"explanation": " "}, "invalid_explanation")]
    for raw, error in wrong:
        out = parsing.verdict(raw if raw is None or isinstance(raw, str) else json.dumps(raw), ["1", "2"])
        assert out == (None, None, None, [error])
    assert parsing.verdict("{}", [])[3] == ["schema_keys", "invalid_label", "invalid_evidence_ids_type", "invalid_explanation"]
    assert parsing.cites_shown('{"evidence_ids": ["1"], "label": 4}', ["1"]) and not parsing.cites_shown('{"evidence_ids": ["9"]}', ["1"])
    assert not parsing.cites_shown('{"evidence_ids": ["1", "1"]}', ["1"]) and not parsing.cites_shown("[]", []) and not parsing.cites_shown(None, [])


def test_strict_decisions(spark):
    # (flags, decision, errors)
    whole, spots = (True, True, True, True), (True, True, True, False)
    cases = [
        ('{"decision": "SUPPORT", "rationale_sentences": [0, 2]}', whole, "SUPPORT", []),
        ('{"decision": "SUPPORT", "rationale_sentences": [true]}', spots, "SUPPORT", ["invalid_rationale_type"]),
        ('{"decision": "SUPPORT", "rationale_sentences": [0.0]}', spots, "SUPPORT", ["invalid_rationale_type"]),
        ('{"decision": "SUPPORT", "rationale_sentences": [3]}', spots, "SUPPORT", ["invalid_rationale_indices"]),
        ('{"decision": "CONTRADICT", "rationale_sentences": []}', spots, "CONTRADICT", ["invalid_rationale_indices"]),
        ('{"decision": "SUPPORT", "rationale_sentences": [1, 1]}', spots, "SUPPORT", ["invalid_rationale_indices"]),
        ('{"decision": "INSUFFICIENT", "rationale_sentences": []}', whole, "INSUFFICIENT", []),
        ('{"decision": "INSUFFICIENT", "rationale_sentences": [0]}', spots, "INSUFFICIENT", ["invalid_rationale_indices"]),
        ('{"decision": "X", "rationale_sentences": []}', (True, True, False, False), None, ["invalid_decision", "invalid_rationale_indices"]),
        ('{"decision": "SUPPORT", "rationale_sentences": "0"}', spots, "SUPPORT", ["invalid_rationale_type"]),
        ('{"decision": "SUPPORT", "rationale_sentences": [0], "x": 1}', (True, False, True, True), "SUPPORT", ["schema_keys"]),
        ("{}", (True, False, False, False), None, ["schema_keys", "invalid_decision", "invalid_rationale_type"]),
        ("[]", (True, False, False, False), None, ["output_not_object"]),
        ("{", (False, False, False, False), None, ["invalid_json"]),
        (None, (False, False, False, False), None, ["invalid_json"]),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string").select("i", parsing.parse_decision(F.col("raw"), F.lit(3)).alias("p"))
    for r in rows.collect():
        p = r["p"]
        assert ((p["json_ok"], p["schema_ok"], p["decision_ok"], p["rationale_ok"]), p["decision"], p["errors"]) == cases[r["i"]][1:], cases[r["i"]]


def test_evidence_within_a_budget():
    documents = [("7", "a title", ["one two", "three four five"]), ("8", "other", ["six"])]
    whole = "[EVIDENCE_ID: 7] Title: a title\n[EVIDENCE_ID: 7; SENTENCE: 0] one two\n[EVIDENCE_ID: 7; SENTENCE: 1] three four five\n\n[EVIDENCE_ID: 8] Title: other\n[EVIDENCE_ID: 8; SENTENCE: 0] six"
    assert parsing.budgeted(documents, 100) == (whole, 27, 27, False)
    cut, before, after, truncated = parsing.budgeted(documents, 17)
    assert cut == "[EVIDENCE_ID: 7] Title: a title\n[EVIDENCE_ID: 7; SENTENCE: 0] one two\n[EVIDENCE_ID: 7; SENTENCE: 1] three [TRUNCATED]" and (before, after, truncated) == (27, 17, True)
    assert parsing.budgeted([("7", " ".join("abcdefgh"), ["x"])], 3) == ("", 16, 0, True)
    marker = parsing.budgeted([("7", "t " * 30, ["x"])], 11)
    assert marker[0] == "[EVIDENCE_ID: 7] [TRUNCATED: no text fit within evidence budget]" and marker[2] == 9
    assert parsing.budgeted([], 9) == ("[NO EVIDENCE DOCUMENTS PROVIDED]", 4, 4, False)
    for budget in range(1, 30):
        assert parsing.budgeted(documents, budget)[2] <= budget
    with pytest.raises(ValueError, match="positive"):
        parsing.budgeted(documents, 0)


def test_text_functions(spark):
    row = spark.createDataFrame([("Straße,  ÇA_va 3!", ["a", "b"])], "t string, s array<string>")
    out = row.select(T.tokens(F.col("t")).alias("k"), T.normalized(F.col("t")).alias("n"), T.numbered_lines(F.col("s")).alias("l"), T.article(F.lit("T"), F.col("s")).alias("a")).first()
    assert tuple(out) == (["straße", "ça_va", "3"], "strasse ça_va 3", "[0] a\n[1] b", "T a b")
    ids = spark.createDataFrame([([1, 2], [1, 2, 3], 5)], "p array<int>, f array<int>, w int")
    out = ids.select(T.masked_labels(F.col("p"), F.col("f")).alias("m"), T.right_padded(F.col("f"), F.col("w"), 0).alias("r"), T.jaccard(F.col("p"), F.col("f")).alias("j"), T.fingerprint(F.lit("A  b"), F.lit(None)).alias("x")).first()
    assert (out["m"], out["r"], out["j"]) == ([-100, -100, 3], [1, 2, 3, 0, 0], pytest.approx(2 / 3)) and len(out["x"]) == 64


def test_violations(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (2,), (3,)], "k long")
    assert {tuple(r) for r in validation.id_differences(a, b, "k").collect()} == {(1, "missing"), (3, "extra"), (2, "repeated")}
    assert validation.repeated_keys(b, "k").count() == 1 and validation.dangling(b, a, "k").count() == 1
    assert validation.same_rows(a, a) and not validation.same_rows(b, b.distinct())
    parts = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k long, part string")
    assert [tuple(r) for r in validation.overlaps(parts, "k").collect()] == [(1, ["x", "y"])]
    assert validation.outside(parts, "part", ("x",)).count() == 1
    spots = spark.createDataFrame([([0, 1], 2), ([2], 2), ([-1], 2)], "i array<int>, n int")
    assert validation.bad_indices(spots, "i", F.col("n")).count() == 2
    left, right = (spark.createDataFrame(r, "k long, text string") for r in ([(1, "a  b"), (2, "c")], [(1, " a b "), (2, "d")]))
    assert [r["k"] for r in validation.text_differences(left, right, "k").collect()] == [2]
    assert tuple(validation.label_gate(spark.createDataFrame([("x",), (None,)], "l string"), "l").first()) == (False, "labels incomplete")
    assert validation.reordered(parts, parts.where("part = 'x'"), "k", "part").count() == 1
    assert validation.drifted(spark.createDataFrame([(1, 1.0)], "k int, v double"), spark.createDataFrame([(1, 1.0 + 1e-9)], "k int, v double"), "k", "v").count() == 1


def test_sources_and_sinks(spark, tmp_path):
    lines = '{"id": 1, "claim": "c", "cited_doc_ids": [4], "evidence": {"4": [{"sentences": [0], "label": "SUPPORT"}]}}\n\n{"id": 2, "claim": "d", "cited_doc_ids": [], "evidence": {}}\n'
    (tmp_path / "claims.jsonl").write_text(lines)
    claims = readers.read_jsonl(spark, str(tmp_path / "claims.jsonl"), readers.CLAIMS, "id")
    assert claims.count() == 2 and claims.orderBy("id").first()["evidence"]["4"][0]["label"] == "SUPPORT"
    (tmp_path / "twice.jsonl").write_text(lines + '{"id": 2, "claim": "last"}\n')
    with pytest.raises(ValueError, match="repeated"):
        readers.read_jsonl(spark, str(tmp_path / "twice.jsonl"), readers.CLAIMS, "id")
    last = readers.read_jsonl(spark, str(tmp_path / "twice.jsonl"), readers.CLAIMS, "id", "last")
    assert {r["id"]: r["claim"] for r in last.collect()} == {1: "c", 2: "last"}
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\n1\t4\t1\n1\t5\t0\n")
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "qrels.tsv")).collect()] == [(1, 4, 1)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/corpus.jsonl", "one\n\ntwo\n")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y/corpus.jsonl")
        info.size = 4
        t.addfile(info, io.BytesIO(b"six\n"))
    for name, wanted in (("a.zip", ["one", "two"]), ("b.tar.gz", ["six"])):
        assert [r["line"] for r in readers.read_archive_lines(spark, str(tmp_path / name), "corpus.jsonl").collect()] == wanted
    assert len(readers.file_hashes(spark, str(tmp_path / "a.zip")).first()["sha256"]) == 64
    rows = spark.createDataFrame([(1, 0.5, None)], "b int, a double, c string")
    writers.write_jsonl(rows, str(tmp_path / "out"))
    assert '{"a":0.5,"b":1,"c":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_jsonl(rows, str(tmp_path / "out"))
    writers.write_audit(rows, str(tmp_path / "audit"), ["b", "a"])
    assert "1,0.500000000" in "".join(p.read_text() for p in (tmp_path / "audit").glob("part-*"))
    assert writers.freeze(rows, str(tmp_path / "frozen")) and not writers.freeze(rows, str(tmp_path / "frozen"))
    with pytest.raises(ValueError, match="other rows"):
        writers.freeze(rows.withColumn("b", F.lit(2)), str(tmp_path / "frozen"))
    built = []
    for _ in range(2):
        writers.cached(spark, str(tmp_path / "cache"), {"model": "m"}, lambda: built.append(1) or rows).collect()
    assert len(built) == 1
    kept = next((tmp_path / "cache").iterdir())
    spark.createDataFrame([("{}",)], "settings string").write.mode("overwrite").parquet(str(kept / "settings"))
    with pytest.raises(ValueError, match="other settings"):
        writers.cached(spark, str(tmp_path / "cache"), {"model": "m"}, lambda: rows)
    writers.write_summary(rows, str(tmp_path / "summary"))
    with pytest.raises(ValueError, match="one row"):
        writers.write_summary(rows.union(rows), str(tmp_path / "summaries"))
    (tmp_path / "audit.csv").write_text("claim_id,human_label\n1,SUPPORT\n2,\n")
    assert readers.read_audit(spark, str(tmp_path / "audit.csv"), ("SUPPORT",)).count() == 2
    with pytest.raises(ValueError, match="unknown label"):
        readers.read_audit(spark, str(tmp_path / "audit.csv"), ("SUPPORT",), require_labels=True)
    many = "".join(json.dumps({"id": i % 3, "claim": str(i)}) + "\n" for i in range(3000))
    (tmp_path / "many.jsonl").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = readers.read_jsonl(spark, str(tmp_path / "many.jsonl"), readers.CLAIMS, "id", "last")
        assert {r["id"]: r["claim"] for r in split.collect()} == {0: "2997", 1: "2998", 2: "2999"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_latency_windows_as_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, f"2024-01-01 {i % 10:02d}:30:00", 1, "view", float(i), "{}") for i in range(40)] + [(99, "2024-01-03 00:00:00", 1, "view", 0.0, "{}")]
    frame = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    query = requests.write_windows(requests.request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = {(r["window_start"], r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = {(r["window_start"], r["n"], r["mean"]) for r in requests.windowed_latency(frame).collect()}
    assert streamed < table and len(table) - len(streamed) == 1  # the last window is still open


def test_sketches_bound_the_difference(spark):
    draw = random.Random(2)
    sets = {i: {draw.randrange(-(1 << 63), 1 << 63) for _ in range(draw.choice([1, 30, 400]))} for i in range(12)} | {50: set(range(300)), 51: set(range(20, 310))}
    made = sampling._sketches(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rep long, keys array<long>"))
    bits = {r["rep"]: [x & (1 << 64) - 1 for x in list(r)[1:]] for r in made.collect()}
    apart = {(i, j): sum((a ^ b).bit_count() for a, b in zip(bits[i], bits[j], strict=True)) for i in sets for j in sets}
    assert all(n <= len(sets[i] ^ sets[j]) for (i, j), n in apart.items()) and 0 < apart[50, 51] <= 30
