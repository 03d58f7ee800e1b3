from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import attention, ordinal, urlmodel, warc

DOCS = "doc_id long, text string, kept string"


def rated():
    rng = np.random.RandomState(0)
    words = [f"word{i}" for i in range(80)]
    docs, ratings = [], []
    for i in range(600):
        grade = int(rng.choice([0, 1, 2], p=[0.2, 0.2, 0.6]))
        text = [words[k] for k in rng.randint(0, 80, rng.randint(15, 60))]
        if grade == 0:
            text[rng.randint(len(text))] = str(rng.choice(["nasty", "vile"]))
        if grade == 1:
            text = [w + "!!" for w in text]
        docs.append((i, " ".join(text), "x"))
        if i < 400:
            ratings.append((i, grade))
        else:
            docs[-1] = (*docs[-1], grade)
    return docs, ratings


def test_ordinal_model_on_held_out_documents(spark):
    docs, ratings = rated()
    frame = spark.createDataFrame([d[:3] for d in docs], DOCS)
    model = ordinal.fit_on(frame, spark.createDataFrame([*ratings, (None, 1), (3, None)], "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in ordinal.graded(frame, model).collect()}
    right = [out[d[0]]["kept"] == (d[3] == 2) for d in docs if len(d) == 4]
    assert np.mean(right) > 0.95
    assert all(0 <= r["tail_probability"] <= r["expected_grade"] <= 2 and r["kept"] == (r["tail_probability"] >= 0.6) for r in out.values())
    kept = ordinal.kept_documents(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in out.items() if r["kept"]}


def test_grading_of_odd_rows(spark):
    docs, ratings = rated()
    model = ordinal.fit_on(spark.createDataFrame([d[:3] for d in docs], DOCS), spark.createDataFrame(ratings, "doc_id long, grade int"))
    odd = [(1, None, "x"), (2, "", "x"), (None, docs[0][1], "x"), (1, None, "x"), (5, "word1 " * 60_000, "x"), (6, " \n!!", "x")]
    out = ordinal.graded(spark.createDataFrame(odd, DOCS), model).collect()
    assert len(out) == 6 and len({r["expected_grade"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert ordinal.graded(spark.createDataFrame([], DOCS), model).count() == 0
    none = ordinal.fit_on(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, grade int"))
    assert ordinal.graded(spark.createDataFrame(odd, DOCS), none).count() == 6


PAGES = "page_id long, url string, html string, host string"


def urls():
    rng = np.random.RandomState(1)
    rows = []
    for i in range(400):
        top, lang = str(rng.choice(["com", "net", "org"])), str(rng.choice(["en", "de", "es", "fr"]))
        rows.append((i, f"http{'s' * int(i % 2)}://Site{i % 7}.Example.{top}/{lang}/{rng.randint(1, 9999)}{'?q=1' if i % 5 == 0 else ''}", "h", "x"))
    odd = ["https://example.com/en/7#x", "https://notexample.com/en/71", "//no/scheme", None, "", "http://net/de/8", "ftp://EXAMPLE.net/de/8?x", "http://example.net?de/8", "a://b://c/d", "http://x.org/es/", "http://É.org/es", "http://com\n/en/"]
    return rows + [(1000 + k, u, "h", "x") for k, u in enumerate(odd)] + [(None, odd[0], "h", "x"), rows[0]]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_hosts_paths_and_rules(spark):
    for r in urlmodel.filtered(spark.createDataFrame(urls(), PAGES)).join(spark.createDataFrame(urls(), PAGES).select("page_id", "url"), "page_id").collect():
        host, path = parts(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        best = None
        for rule, verdict in urlmodel.RULES:
            domain, _, rest = rule.partition("/")
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        assert r["rule"] == (best[0] if best else None)
        assert r["verdict"] == (best[1] if best else ("allow" if r["ratio"] >= r["cut"] else "block"))


def test_ratio_tells_rejected_urls(spark):
    pages = spark.createDataFrame(urls(), PAGES)
    judge = urlmodel.learned(pages)
    tried = pa.array([f"http://site{k}.example.{t}" for k in range(7) for t in ("com/en/31", "org/es/44", "net/de/12")])
    verdicts = judge.ratio(tried) >= judge.cut
    assert verdicts.reshape(7, 3).mean(0).tolist() == [0.0, 0.0, 1.0]
    empty = urlmodel.filtered(spark.createDataFrame([], PAGES))
    assert empty.count() == 0


def test_long_urls(spark):
    rows = [*urls(), (5000, "http://example.com/en/" + "a/" * 100_000, "h", "x"), (5001, "http://" + "b" * 150_000 + ".org/es/x", "h", "x"), (5002, "c" * 120_000, "h", "x")]
    made = {r["page_id"]: r for r in urlmodel.filtered(spark.createDataFrame(rows, PAGES)).collect()}
    assert (made[5000]["rule"], len(made[5000]["path"])) == ("com/en/", 200_004) and made[5001]["rule"] == "org/es/" and len(made[5001]["host"]) == 150_004
    assert made[5002]["host"] == made[5002]["path"] == "" and all(math.isfinite(made[k]["ratio"]) for k in (5000, 5001, 5002))


def test_model_is_a_distribution():
    symbols = urlmodel.PLAIN + urlmodel.OTHER + urlmodel.END
    text = "^" * urlmodel.ORDER + "abcabcabd$"
    runs = [text[i : i + urlmodel.ORDER + 1] for i in range(len(text) - urlmodel.ORDER)]
    for at in runs:
        every = pa.array(runs + [at[:-1] + c for c in symbols])
        counts = np.zeros((len(every), urlmodel.EQUAL[1].shape[1]))
        counts[: len(runs)] = 1
        codes = urlmodel._codes(every, urlmodel.ORDER + 1)
        known, p = urlmodel.chances(codes, counts, range(1, urlmodel.ORDER + 2), urlmodel.EQUAL)
        each = p[np.searchsorted(known, codes[len(runs) :])]
        assert np.abs(each.sum(0) - 1).max() < 1e-6


def plain_ratio(decided, url):
    """The ratio by dictionaries of counts, context by context."""
    table = {"allow": {}, "block": {}}
    spell = lambda u: "^" * urlmodel.ORDER + "".join(c.lower() if "A" <= c <= "Z" else c if c in urlmodel.PLAIN else "*" for c in u or "") + "$"
    for verdict, text in decided:
        text = spell(text)
        for i in range(urlmodel.ORDER, len(text)):
            for k in range(urlmodel.ORDER + 1):
                after = table[verdict].setdefault(text[i - k : i], {})
                after[text[i]] = after.get(text[i], 0) + 1
    text, sums = spell(url), {"allow": 0.0, "block": 0.0}
    for verdict, known in table.items():
        for i in range(urlmodel.ORDER, len(text)):
            p = 1 / urlmodel.SYMBOLS
            for k in range(urlmodel.ORDER + 1):
                after = known.get(text[i - k : i])
                if after:
                    p = (after.get(text[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
            sums[verdict] += math.log(p)
    return (sums["allow"] - sums["block"]) / (len(text) - urlmodel.ORDER)


def test_ratio_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(urlmodel, "_ROWS", 50)  # many parts of a task's rows
    rows = urls()
    made = [r for r in urlmodel.filtered(spark.createDataFrame(rows, PAGES)).collect() if r["page_id"] is not None]
    verdict_of = {r["page_id"]: r["verdict"] for r in made if r["rule"]}
    decided = [(verdict_of[r[0]], r[1]) for r in rows if r[0] in verdict_of]
    decided += [("allow", r[1]) for r in rows if r[0] is None]  # https://example.com/en/7#x, which the rules allow
    url_of = {r[0]: r[1] for r in rows}
    assert len(made) == len(rows) - 1
    for r in made[::3] + [r for r in made if r["page_id"] >= 1000]:
        assert abs(r["ratio"] - plain_ratio(decided, url_of[r["page_id"]])) < 1e-9


def texts():
    rng = np.random.RandomState(2)
    words = ["the", "of", "harbour", "Lichtung", "été", "zorblig", "and", "papers,", "blue."] + [f"unit{i}" for i in range(40)]
    docs = [(i, " ".join(words[k] for k in rng.randint(0, len(words) if i % 3 else 12, rng.randint(1, 120))), "x") for i in range(120)]
    return [*docs, (200, None, "x"), (201, "", "x"), (202, "unseenword " * 3, "x"), (None, "the of", "x"), docs[4], (203, "the " * 4000, "x")]


def test_runs_of_many_urls_stay_off_the_driver(spark, monkeypatch):
    draw = random.Random(5)
    urls = [f"http://{'x.com/en' if i % 2 else 'example.com/en/7'}/" + "".join(draw.choices(urlmodel.PLAIN, k=60)) for i in range(2500)]
    rows = spark.createDataFrame([(i, i % urlmodel.HELD_OUT, "block" if i % 2 else "allow", u) for i, u in enumerate(urls)], "id long, fold int, verdict string, url string")
    taken = []
    arrow = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: taken.append((df.columns, (table := arrow(df)).num_rows)) or table)
    differences = urlmodel.store(urlmodel._differences(urlmodel._counted(rows)))
    assert differences.count() > 130_000  # 10 MB as counted
    assert "strategy=broadcast" not in urlmodel._scored(rows, differences)._jdf.queryExecution().optimizedPlan().toString()
    assert [columns for columns, n in taken if n > urlmodel.SYMBOLS * urlmodel.HELD_OUT] == [["run", "p"]]  # a row a short run, not one a short run and part
    assert urlmodel._scored(rows, differences).count() == len(urls)


def test_base_scores_as_brute_force(spark):
    rows = texts()
    table = {}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [w.decode() for w in lower(t).encode().split()] + [None]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        w = tokens(t)
        table[i] = (held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    for common in (1 << 16, 5):
        attention_common, attention.COMMON = attention.COMMON, common
        try:
            out = attention.scored(spark.createDataFrame(rows, DOCS)).collect()
        finally:
            attention.COMMON = attention_common
        assert len(out) == len(rows)
        for r in out:
            e = table[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
            assert abs(r["base_score"] - e[4]) < 1e-6 * max(1, abs(e[4])) and r["score"] < 0 and math.isfinite(r["score"])
    assert attention.scored(spark.createDataFrame([], DOCS)).count() == 0


def test_each_training_text_is_in_one_round(spark):
    rows = [(k, k % 7 == 2, bytes([k, 0] * (k % 5))) for k in range(200)]
    frame = spark.createDataFrame(rows, "row long, held_out boolean, codes binary")
    read = [bytes(r["codes"]) for k in range(attention.ROUNDS) for r in attention.training_part(frame, k).collect()]
    assert Counter(read) == Counter(codes for _, held, codes in rows if not held)


def test_each_encoded_text_is_laid_out_once(monkeypatch):
    monkeypatch.setattr(attention, "LAID", 7)
    runs = [np.arange(n, dtype=np.uint16) + 300 * n for n in (0, 3, 5, 0, 20, 1, 1, 0)]
    column = pa.array([r.tobytes() for r in runs], pa.binary())
    for part in (column, column.slice(2), column.slice(3, 2), column.slice(0, 0)):
        got = [c for codes, n in attention.laid(part) for c in np.split(codes, np.cumsum(n)[:-1])]
        assert [g.tolist() for g in got] == [np.frombuffer(x, np.uint16).tolist() for x in part.to_pylist()]


def test_runs_of_three_beyond_the_table_count_as_well(spark, monkeypatch):
    frame = spark.createDataFrame([*texts(), (204, "unit1unit unseenword harbourpapers", "x")], DOCS)
    made = []
    for triples, common in ((1 << 18, 1 << 16), (3, 1 << 16), (3, 5)):
        monkeypatch.setattr(attention, "TRIPLES", triples)
        monkeypatch.setattr(attention, "COMMON", common)
        made.append(sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 4)) for r in attention.scored(frame).collect()))
    for other in made[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(made[0], other, strict=True))


def counted(kept_all=True):
    pieces = attention.Pieces(attention.TOKENIZER)
    ids, bounds = pieces.encode(["the", "thing", "harbour", "of"] * 3)
    singles = np.bincount(ids, minlength=pieces.size).astype(float)
    kept = np.flatnonzero(singles)
    n = len(kept)
    symbol = {k: s for s, k in enumerate(kept)}
    first, last, follow = np.zeros(attention.KEPT + 1), np.zeros(attention.KEPT + 1), np.zeros((attention.KEPT + 1,) * 2)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        run = [symbol[i] for i in ids[lo:hi]]
        first[run[0]] += 1
        last[run[-1]] += 1
        for a, b in zip(run[:-1], run[1:], strict=True):
            follow[a, b] += 1
    assert n
    return pieces, attention.counted_model(pieces, singles, first, follow, last, kept, 2.0), ids, bounds


def by_hand(model, codes):
    """log P of the classes of one text, position by position, each by the window that scores it."""
    context, goals = [attention.START, *codes], [*model.goal[codes], 0]
    w, half, total = model.layer, attention.WINDOW // 2, 0.0
    scale = lambda x: attention._exp(np.asarray(x * attention._UNIT + attention._ZERO, np.float32)).astype(float)
    vectors = w["embed"].astype(float)[model.last[context]]
    for at, goal in enumerate(goals):
        first = max(0, (at // half - 1) * half)
        q = vectors[at] @ w["q"]
        weight = np.array([scale(q @ (vectors[j] @ w["k"]) + w["near"][at - j]) for j in range(first, at + 1)])
        mixed = sum(a * (vectors[j] @ w["v"]) for a, j in zip(weight, range(first, at + 1), strict=True)) / weight.sum()
        chance = scale((mixed * (1 + vectors[at] @ w["gate"])) @ w["out"] + model.after[context[at]])
        assert abs((chance / chance.sum()).sum() - 1) < 1e-9
        total += math.log(chance[goal] / chance.sum())
    return total


def test_class_scores_by_hand():
    pieces, model, ids, _ = counted()
    rng = np.random.RandomState(4)
    model.layer = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in model.layer.items()}
    codes = np.tile(model.symbol[ids], 12).astype(np.uint16)
    codes[5] = attention.OTHER
    codes[9] = attention.BEGUN
    for lengths in ([len(codes)], [0, 1, 15, 16, 17, len(codes) - 49, 0], [31, 32, 33]):
        lengths = np.array(lengths)
        fast = model.class_sums(codes[: lengths.sum()], lengths)
        slow = [by_hand(model, part) for part in np.split(codes[: lengths.sum()], np.cumsum(lengths)[:-1])]
        assert np.abs(fast - slow).max() < 1e-2 * max(1, np.abs(slow).max() / 100)
    assert abs(np.exp(model.after).sum(1) - 1).max() < 1e-4


def test_gradients_are_slopes():
    pieces, model, ids, _ = counted()
    rng = np.random.RandomState(4)
    model.layer = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in model.layer.items()}
    codes = np.tile(model.symbol[ids], 12)[:31].astype(np.uint16)
    context, goal, _ = model.stream(codes, np.array([31]))

    def loss():
        w = model.layer
        x = w["embed"][model.last[context[:32]]].astype(float)
        scores = (x @ w["q"]) @ (x @ w["k"]).T + w["near"][attention._APART]
        weight = np.exp(scores) * attention._CAUSAL
        mixed = weight @ (x @ w["v"]) / weight.sum(1, keepdims=True)
        logits = (mixed * (1 + x @ w["gate"])) @ w["out"] + model.after[context[:32]]
        return float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(32), goal[:32]]))

    trainer, seen = attention.Trainer(model, 0.0), {}
    trainer._move = lambda name, d: seen.__setitem__(name, d)
    trainer.step(context[None, :32], goal[:32])
    trainer.move_vectors()
    for name in attention._LAYER:
        direction = rng.standard_normal(seen[name].shape)
        kept = model.layer[name]
        sides = []
        for step in (-1e-2, 1e-2):
            model.layer[name] = (kept + step * direction).astype(np.float32)
            sides.append(loss())
        model.layer[name] = kept
        slope = (sides[1] - sides[0]) / 2e-2
        assert abs(slope - float((seen[name] * direction).sum())) < 0.05 * max(0.2, abs(slope)), name


def test_ids_within_a_class_are_a_distribution():
    pieces, model, ids, bounds = counted()
    for before in (0, attention.KEPT, attention.KEPT + 1):
        for c in range(attention.CLASSES):
            members = np.flatnonzero(model.class_of == c)
            if not len(members):
                continue
            s = model.symbol[members]
            p = np.where(s < attention.KEPT, model.within[before, np.minimum(s, attention.KEPT - 1)].astype(float), model.own[members] + model.within_other[before, c])
            assert abs(np.exp(p).sum() - 1) < 1e-3


def test_training_lowers_the_loss():
    pieces, model, _, _ = counted()
    ids, cuts = pieces.encode((["the", "thing"] * 8 + ["of", "harbour"] * 8) * 40)
    codes, n = model.contexts(ids, cuts), np.array([len(ids)])
    before = model.class_sums(codes, n)[0]
    trainer = attention.Trainer(model, 0.01)
    for k in range(8):
        trainer.learn(codes, n, k)
    model.layer = trainer.layer
    assert model.class_sums(codes, n)[0] > before + 1 and trainer.seen == 8 * (len(ids) + 1)


def pages():
    big = "".join(chr(97 + k % 26) * 50 + "é\r\n\r\nWARC/1.1\r\n" for k in range(3000))
    rows = [(1, "http://a/1", "same", "x"), (2, "http://a/2", "same", "x"), (0, "http://a/0", "other", "x"), (3, None, None, "x"), (4, "http://b\r\nX: y", "", "x"), (5, "http://c", big, "x"), (6, "http://c", big + "z", "x"), (7, "u", big, "x")]
    return [*rows, (1, "http://a/1", "same", "x"), (None, "n", "same", "x"), (None, "n", "nulls only", "x"), (None, "n", "nulls only", "x")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_through_archives(spark):
    rows = pages()
    made = warc.archived(spark.createDataFrame(rows, PAGES)).collect()
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html, _ in rows:
        low = first.get(html or "")
        alone = sum((r[2] or "") == (html or "") for r in rows) == 1
        revisit = low is not None and not alone and i != low
        expected.append((i, len((html or "").encode()), b32(html), "revisit" if revisit else "response", low if revisit else None))
    assert sorted(map(tuple, made), key=str) == sorted(expected, key=str)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_and_files_hold_segments(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", least=10)
    packed = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    raw = gzip.decompress(packed)  # other readers take the members as well
    heads = list(warc._parsed(iter([raw])))
    assert packed.count(b"\x1f\x8b\x08\x00") >= len(heads) > len(rows)
    assert any(h["warc-type"] == "continuation" and int(h["warc-segment-number"]) > 1 for h, _ in heads)
    assert any("warc-segment-total-length" in h for h, _ in heads)
    out = warc.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()
    wanted = Counter((r[0], r[2] or "") for r in rows if (r[0], len(r[2] or "") > 1000) != (7, True))
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in out if r["page_id"] is not None) == Counter({k: v for k, v in wanted.items() if k[0] is not None})


def test_broken_framing_is_noticed():
    assert warc.dechunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000 and warc.dechunked(b"0\r\n\r\n") == b""
    for wrong in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(wrong)


def test_files_of_other_writers_and_broken_files(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"text {k} " * 50, "x") for k in range(20)]
    kinds = [b"".join(warc.records(k, url, html.encode(), warc.digest(html.encode()), None, False, k)) for k, url, html, _ in rows]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in kinds[:7]) + gzip.compress(b"".join(kinds[7:12])))
    (tmp_path / "w" / "part-1.warc.gz").write_bytes(gzip.compress(b"".join(kinds[12:])[:900]) + gzip.compress(b"".join(kinds[12:])[900:]))
    read = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert read == {k: html for k, _, html, _ in rows}
    whole = gzip.compress(kinds[0])
    for broken in (whole + b"garbage", whole[:-3], b"plain", whole + whole[:5]):
        with pytest.raises(ValueError):
            b"".join(warc.unpacked(broken))
    assert list(warc.unpacked(b"")) == [] and b"".join(warc.unpacked(whole * 3)) == kinds[0] * 3
    for broken in (kinds[0][:-2], kinds[0] + b"x", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab"):
        with pytest.raises(ValueError):
            list(warc._parsed(iter([broken[:10], broken[10:]])))
    large = b"x" * 20_000_000
    assert gzip.decompress(b"".join(m + b"\0" for m in warc.member(large))) == large
