from __future__ import annotations

import random
import re

import numpy as np

from lodestone.llm import covertree, minhash, texthash

DOCS = "doc_id long, text string, bucket string, rep string"


def closed(ids, links):
    low = {i: i for i in ids if i is not None}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


def shingle_set(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width, percent):
    links = []
    sets = [(r[0], shingle_set(r[1], width)) for r in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    low = closed([r[0] for r in rows], links)
    return sorted(((r[0], len(x), low.get(r[0]), r[0] == low.get(r[0])) for r, (_, x) in zip(rows, sets, strict=True)), key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 9, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in text).replace("É", "é"), "x", "y"))
            n += 1
    hub = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(40):  # a family whose members differ from each other more than from the hub
        text = list(hub)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((n, " ".join(text), "x", "y"))
        n += 1
    return [*rows, (n, None, "x", "y"), (n + 1, "", "x", "y"), (n + 2, " \n\t ", "x", "y"), (3, rows[3][1], "x", "y"), (n + 3, "long " * 5000 + "end", "x", "y")]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_near_duplicates_as_brute_force(spark):
    rows = corpus()
    for width in (4, 5):
        made = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width, 80)
        assert got(made, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, width, 80)


def test_near_duplicates_of_null_ids_and_of_nothing(spark):
    rows = [(None, "a b c d e f", "x", "y"), (None, "a b c d e f", "x", "y"), (7, "a b c d e f", "x", "y"), (9, "A B c d E f", "x", "y")]
    made = got(minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4), "doc_id", "component_id", "kept")
    assert made == sorted([(None, None, True), (None, None, True), (7, 7, True), (9, 7, False)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), 4).count() == 0


def test_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = corpus()
    made = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80)
    assert got(made, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 4, 80)


def test_word_hashes_do_not_depend_on_the_place():
    import pyarrow as pa

    texts = ["the cat  sat", None, "", "THE Cat\tsat\x0b", "on the cat sat", "é" * 40]
    per_text = []
    for first, last, data, offsets in texthash.text_slices(pa.array(texts), 8):
        starts, ends, upto = texthash.word_spans(data, offsets)
        h = texthash.span_hashes(data, starts, ends)
        per_text += [h[upto[i] : upto[i + 1]].tolist() for i in range(last - first)]
    assert [len(x) for x in per_text] == [3, 0, 0, 3, 4, 1]
    assert per_text[0] == per_text[3] == per_text[4][1:]


def test_densified_bins_hold_members_and_agree_for_equal_sets():
    rng = np.random.RandomState(0)
    for n in (1, 2, 5, 300, 5000):
        s = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(4))
        signature = minhash.densified(s)
        assert len(signature) == minhash.BINS and set(signature) <= set(s)


VECTORS = "vec_id long, embedding array<float>, label int, cell string"


def test_vectors_as_brute_force(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(220):
        v = rng.standard_normal(8) if i % 3 else np.eye(8)[i % 8] + 0.12 * rng.standard_normal(8)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], int(i % 2), "c"))
    rows += [(300, rows[0][1], 0, "c"), (301, rows[0][1], 0, "c"), (302, None, 0, "c"), (303, [], 0, "c"), (304, [0.0] * 8, 0, "c"), (305, [float("nan")] + [1.0] * 7, 0, "c"), (306, [None] + [1.0] * 7, 0, "c")]
    rows += [(307, rows[0][1], None, "c"), (308, rows[0][1][:4], 0, "c"), (None, rows[0][1], 0, "c"), (309, [float("inf")] * 8, 0, "c")]
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(sound):
        for b in sound[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y >= 0.93 * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((a[0], b[0]))
    low = closed([r[0] for r in rows], links)
    count = {i: sum(i in pair for pair in links) for i in low}
    expected = sorted(((r[0], count.get(r[0], 0), low.get(r[0]), r[0] == low.get(r[0])) for r in rows), key=str)
    for block in (1500, 20):
        made = covertree.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), 0.93, block)
        assert got(made, "vec_id", "n_links", "component_id", "kept") == expected
    assert covertree.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_cover_tree_levels_halve_and_nest():
    points = np.random.RandomState(2).standard_normal((200, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[50:60] = points[50]
    tree = covertree.CoverTree(points)
    assert sorted(tree.order) == list(range(200))
    top = tree.levels[0][1][0]
    for depth, (centre, reach, low, high, _) in enumerate(tree.levels):
        assert (high - low).sum() == 200
        for c, r, lo, hi in zip(centre, reach, low, high, strict=True):
            members = tree.order[lo:hi]
            assert c in members and np.linalg.norm(points[members] - points[c], axis=1).max() <= r + 1e-12
            assert r <= top / 2**depth + 1e-12


def test_traversal_descends_and_prunes_below_the_roots():
    rng = np.random.RandomState(3)
    centres = rng.standard_normal((30, 64))
    clustered = centres[rng.randint(0, 30, 900)] + 0.1 * rng.standard_normal((900, 64))
    flat = rng.standard_normal((700, 2))
    for raw, least in ((clustered, 3), (flat, 8)):
        one, two = covertree.tree_of(raw[: len(raw) // 2]), covertree.tree_of(raw[len(raw) // 2 :])
        tally = []
        taken, p, q = covertree.linked(one, two, raw[: len(raw) // 2], raw[len(raw) // 2 :], 0.93, tally)
        assert len(tally) >= least, tally
        assert sum(compared - left for compared, left in tally[1:]) > 0 and len(taken) > 0
        # far fewer pairs are compared than there are, and they are the pairs of the whole product
        assert sum(compared for compared, _ in tally) < len(raw) ** 2 / 8
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        wanted = unit[: len(raw) // 2] @ unit[len(raw) // 2 :].T >= 0.93
        made = np.zeros_like(wanted)
        made[p, q] = True
        for lo, hi, lo2, hi2 in taken:
            made[np.ix_(one.order[lo:hi], two.order[lo2:hi2])] = True
        assert (made == wanted).all()


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    made = covertree.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in made.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_plan_has_no_cross_join(spark):
    made = minhash.near_duplicates(spark.createDataFrame(corpus(), DOCS), 4)
    assert "Cartesian" not in made._jdf.queryExecution().toString()
