from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, multiset, phrases
from lodestone.llm.automaton import Automaton

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hexed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# Merkle manifest


def manifest(rows: list[tuple]) -> list[tuple]:
    """Every row's proof by plain lists: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row: tuple, text: str | None) -> str:
        doc_id, _, lang, source, n = row
        return hexed("".join(map(said, (doc_id, source, lang, n, text))))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hexed("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by: dict = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    trees = {s: levels([leaf(r, r[1]) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, row in enumerate(groups[s]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
            node, seen = leaf(row, row[1].replace("\n", "") if tampered else row[1]), ""
            for tree, at in ((trees[s], i), (top, place)):
                for nodes in tree[:-1]:
                    run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
                    seen += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    node = hexed("".join(run[: at % 3] + [node] + run[at % 3 + 1 :]))
                    at //= 3
            out.append((row[0], trees[s][0][i], trees[s][-1][0], top[-1][0], hexed(seen), node, node == top[-1][0]))
    return out


def some_documents(n: int, sources: list) -> list[tuple]:
    draw = random.Random(5)
    return [(i if draw.random() > 0.02 else None, draw.choice([None, "", "a\nb", "\n", "ünï\ncode", f"text {i}\nline"]), draw.choice(["en", None]), draw.choice(sources), draw.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("block", [3, 27, 729])
def test_manifest_as_by_plain_lists(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "HEIGHT", {3: 1, 27: 3, 729: 6}[block])
    monkeypatch.setattr(merkle, "BLOCK", block)
    if block != 729:  # tasks import the module anew, so small blocks are tried through its plain functions
        nodes = [hexed(str(i)) for i in range(100)]
        whole = merkle.lifted(nodes, merkle.heights(100))
        for positions in ([0], [99], [3, 4, 5], [0, 50, 99], list(range(block))):
            lacking = merkle.missing(positions, 100)
            assert len(lacking) == len(set(lacking))
            held = {(level, p // 3**level) for p in positions for level in range(len(whole))}
            assert not held & set(lacking)
            for p in positions:  # every sibling is fetched, or stands above or among the positions
                for level, row in enumerate(whole[:-1]):
                    at = p // 3**level
                    beside = {(level, i) for i in range(at - at % 3, min(len(row), at - at % 3 + 3))}
                    assert beside <= held | set(lacking)
        return
    rows = some_documents(2000, ["a", "a", "a", "b", "", None, "ä", *[f"s{i}" for i in range(20)]])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("tree", F.lit("x")).withColumn("node", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("leaf", F.lit(3))
    assert sorted(map(str, map(tuple, merkle.proved(frame).collect()))) == sorted(map(str, manifest(rows)))


def test_manifest_of_lone_and_repeated_rows(spark):
    for rows in ([(1, "x", None, None, None)], [(2, "y\n", "en", "s", 2)] * 5 + [(None, None, None, "s", None)] * 3):
        made = merkle.proved(spark.createDataFrame(rows, SCHEMA)).collect()
        assert Counter(map(tuple, made)) == Counter(manifest(rows))
    assert merkle.proved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_changed_leaves_and_siblings_are_told():
    nodes = [hexed(str(i)) for i in range(20)]
    whole = merkle.lifted(nodes, merkle.heights(20))
    fetched = {(level, i): node for level, row in enumerate(whole) for i, node in enumerate(row)}
    assert merkle.folded(nodes[7], 7, 20, 0, fetched)[0] == whole[-1][0]
    assert merkle.folded(hexed("x"), 7, 20, 0, fetched)[0] != whole[-1][0]
    assert merkle.folded(nodes[7], 7, 20, 0, fetched | {(1, 0): hexed("x")})[0] != whole[-1][0]


# Fingerprints


def lanes(text: str) -> list[int]:
    import re

    out = [0] * multiset.LANES
    for paragraph in text.split("\n"):
        h = hexed(paragraph)
        h += hexed(h)
        for j in range(16):
            out[j] = (out[j] + int(h[8 * j : 8 * j + 8], 16)) % 2**32
    for clause in re.split(r"[.,;:!?\n]+", text):
        if clause.strip(" "):
            out[16] += 1
            m = md5(clause.strip(" ").encode()).hexdigest()
            for j in range(64):
                out[17 + j] += int(m[8 * (j // 32) : 8 * (j // 32) + 8], 16) >> (j % 32) & 1
    return out


TEXTS = ["", "one", "one\ntwo", "two\none", "a. b, c.\nd e f!\n\nd e f!", "é\nü?!", "same line\n" * 50, "x" * 30_000 + "\n" + "word. " * 4_000]


def test_fingerprints_by_plain_sums(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").select("text", multiset.vector("text").alias("v")).collect()
    for row in rows:
        assert row["v"] == lanes(row["text"] or "")
    by = {row["text"]: row["v"] for row in rows}
    assert by["one\ntwo"] == by["two\none"] and by["one"] != by["one\ntwo"] and by[None] == by[""]


def test_paragraphs_are_inserted_and_deleted_without_the_rest(spark):
    frame = spark.createDataFrame([("a\nb\nc", "b", "d\ne")], "whole string, less string, more string")
    v = {c: multiset.vector(c) for c in frame.columns}
    made = frame.select(multiset.inserted(multiset.deleted(v["whole"], v["less"]), v["more"]).alias("f"), multiset.vector("'e\nc\na\nd'").alias("again")).first()
    assert made["f"] == made["again"]


def test_likeness_follows_what_texts_share(spark):
    line = lambda i: f"sentence number {i} of this text."
    rows = [(k, "\n".join(map(line, range(100))), "\n".join(map(line, range(100 - k, 200 - k)))) for k in (0, 25, 50, 75, 100)]
    near = dict(spark.createDataFrame(rows, "k int, a string, b string").select("k", multiset.likeness(multiset.vector("a"), multiset.vector("b")).alias("s")).collect())
    assert near[100] == 1.0 and all(abs(near[k] - k / 100) < 0.3 for k in near) and near[0] < near[50] < near[100]


def edits(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint) by a sorted list."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hexed(r[1])))
    out, text = [], lambda v: "".join(f"{x:08x}" for x in lanes(v))
    for k, (doc_id, t) in enumerate(order):
        cut = len(t) // 2
        new = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        out.append((doc_id, len(t), hexed(new), text(t), text(new)))
    return out


def test_edits_by_a_sorted_list(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, *TEXTS[:6], "".join(draw.choice("ab c.\né𝄞") for _ in range(draw.randrange(60)))])) for _ in range(120)]
    rows += [(50, "twice\nthe same")] * 4 + [(None, None)] * 3 + [(51, TEXTS[-1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("rank", F.lit("x")).withColumn("n_chars", F.lit(-1)).withColumn("digest", F.lit(0))
    made = multiset.edited(frame)
    assert Counter(tuple(r)[:5] for r in made.collect()) == Counter(edits(rows))
    assert all(0 <= r[k] <= 1 for r in made.collect() for k in ("near_edited", "near_next"))


def test_edits_of_one_or_no_documents(spark):
    made = multiset.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in made] == [(hexed("abab"), 1.0)]
    assert multiset.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_run_no_python(spark):
    plan = multiset.edited(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Automata and collocations


def random_sequences(draw: np.random.Generator, n: int) -> np.ndarray:
    rows = draw.integers(1, 6, (n, 5)).astype(np.uint64)
    rows[np.arange(5) >= draw.integers(1, 6, n)[:, None]] = 0
    return rows


def prefixes(rows: np.ndarray, counts: np.ndarray) -> Counter:
    out: Counter = Counter()
    for row, n in zip(rows, counts, strict=True):
        row = [int(x) for x in row if x]
        for d in range(1, len(row) + 1):
            out[tuple(row[:d])] += int(n)
    return out


def read(automaton: Automaton) -> dict:
    return {tuple(int(x) for x in row if x): int(w) for rows, weights in automaton.sequences(5) for row, w in zip(rows, weights, strict=True)}


def test_automata_count_unite_prune_and_compose():
    draw = np.random.default_rng(1)
    for _ in range(40):
        parts, truth = [], Counter()
        for _ in range(3):
            rows, counts = random_sequences(draw, int(draw.integers(1, 80))), None
            counts = draw.integers(1, 4, len(rows))
            parts.append(Automaton.unpacked(Automaton.counted(rows, counts).packed()))
            assert read(parts[-1]) == dict(prefixes(rows, counts))
            truth += prefixes(rows, counts)
        united = Automaton.united(parts, 5)
        assert read(united) == dict(truth)
        assert read(united.pruned(4)) == {k: v for k, v in truth.items() if v >= 4}
        assert read(united.pruned(4, 3)) == {k: v for k, v in truth.items() if len(k) < 3 or v >= 4}
        asked = random_sequences(draw, 100)
        assert list(united.composed(asked)) == [truth[tuple(int(x) for x in row if x)] for row in asked]


def test_states_that_go_on_alike_are_stored_once():
    rows = np.array([[a, b, 9] for a in range(1, 101) for b in range(1, 6)], np.uint64)
    assert len(Automaton.counted(rows, np.ones(len(rows), np.int64))) == 100 + 5 + 1


def collocated(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """The contract by dictionaries."""
    import re

    counts: dict = {}
    total: Counter = Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            f.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= f[q[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def made_up_texts() -> list[tuple]:
    draw = random.Random(9)
    words = ["the", "of", "The", "ab", "Cd", "é", "É", "x y", "-", "long" * 30, *[f"w{i}" for i in range(30)]]
    runs = [["one", "two", "three", "four", "five", "six"], ["of", "the", "of", "the"], ["a"] * 9]
    rows = []
    for i in range(400):
        text = []
        for _ in range(draw.randrange(40)):
            text += draw.choice(runs) if draw.random() < 0.15 else [draw.choice(words)]
            text += [draw.choice([".", ",", "\n", "\t", "  ", "\x0b", "\x0c", "!"])] if draw.random() < 0.2 else []
        rows.append((" ".join(text), draw.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), *[("two words", "fr")] * 40]


def test_collocations_by_dictionaries(spark, monkeypatch):
    rows = made_up_texts()
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(7).withColumn("gram", F.lit("x")).withColumn("n", F.lit(-1)).withColumn("range", F.lit(0)).withColumn("hash", F.lit(1))
    for least, top in ((30, 2000), (12, 7)):
        made = [tuple(r) for r in phrases.collocations(frame, least=least, top=top).collect()]
        assert sorted(made) == sorted(collocated(rows, least, top)) and len(made) > 10
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_counts_past_64_bits_stay_exact(spark):
    a, n = 9_000_000_000_000, 99_999_999_999_999
    made = spark.createDataFrame([(a, a + 1, a + 7, n)], "a long, l long, r long, n long").select(*[F.col(c).cast("decimal(19,0)").alias(f"_{c}") for c in "alrn"]).select(F.expr("(_a * _n * 1000BD) div (_l * _r)")).first()[0]
    assert made == 1000 * a * n // ((a + 1) * (a + 7))


def test_full_tables_of_bits_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_bits", lambda keys: np.full(phrases.FILTER_BITS // 8, 255, np.uint8))
    rows = made_up_texts()
    made = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=30).collect()]
    assert sorted(made) == sorted(collocated(rows, 30, 2000))


def test_words_that_share_a_hash_get_other_hashes(spark, monkeypatch):
    real = phrases._counted

    def same_first(seed: int):
        if seed:
            return real(seed)

        def count(batches):
            import pyarrow as pa

            for batch in real(0)(batches):
                yield batch.set_column(0, "hash", pa.array([7] * len(batch), pa.int64()))

        return count

    monkeypatch.setattr(phrases, "_counted", same_first)
    words, seed = phrases.word_counts(spark.createDataFrame([("a b a", "en"), ("a", "de")], "text string, lang string").select("lang", "text"))
    assert seed == 1 and sorted((r["lang"], r["word"], r["n"]) for r in words.collect()) == [("de", "a", 1), ("en", "a", 2), ("en", "b", 1)]
