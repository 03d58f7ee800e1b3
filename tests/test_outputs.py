from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing

TOKENIZERS = "/opt/tokenizers"


def generated(draw: random.Random, keys: tuple[str, ...], good: list, bad: list) -> str | None:
    """An output: mostly an object of about these keys, now and then something else."""
    if draw.random() < 0.1:
        return draw.choice([None, "", " ", "no JSON", "[]", "[1]", "1", '"x"', "null", "true", "{", "{} {}", "{}, 1", "{} ] [ {}", '{}\x0b', " {} ", "\x1c{}\x85", "[{}", "{}]", "/* c */ {}", "{'a': 1}", "01", "nul", "{}x"])
    members = [(k, draw.choice(good if draw.random() < 0.7 else bad)) for k in keys]
    if draw.random() < 0.15:
        members.append(("more", 1))
    if draw.random() < 0.15:
        members.pop(draw.randrange(len(members)))
    if draw.random() < 0.1:
        members.append(draw.choice([(k, draw.choice(good)) for k in keys]))  # a key again
    draw.shuffle(members)
    body = ", ".join(f"{json.dumps(k)}: {v}" for k, v in members)
    return draw.choice(["", " ", "\n\t"]) + "{" + body + "}" + draw.choice(["", " ", "\n", " x", ",", "}"] if draw.random() < 0.1 else ["", "\n"])


def test_outputs_are_parsed_as_by_python(spark):
    draw = random.Random(4)
    labels = ['"SUPPORT"', '"CONTRADICT"', '"INSUFFICIENT"']
    cases = []
    for _ in range(1500):
        good = [*labels, "[]", '["a"]', '["a", "b"]', '["a", "a"]', '["z"]', '"so it is"']
        bad = ["1", "1.0", "true", "null", '" "', '"\\u00a0"', '""', "{}", '[1, "a"]', "[null]", '"support"', '"\\u0053UPPORT"', '[["a"]]', '"1"']
        picked = {"label": [*labels, *bad], "evidence_ids": ["[]", '["a"]', '["b", "a"]', '["a", "a"]', '["z"]', *bad], "explanation": ['"so"', *bad]}
        raw = generated(draw, ("label", "evidence_ids", "explanation"), good, bad)
        if draw.random() < 0.6:
            raw = json.dumps({}) if raw is None else "{" + ", ".join(f'"{k}": {draw.choice(v[: 4 + 3 * (draw.random() < 0.4)])}' for k, v in picked.items()) + "}"
        cases.append(raw)
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, raw string").repartition(3)
    shown = F.array(F.lit("a"), F.lit("b"))
    made = rows.select("i", parsing.parse_verdict(F.col("raw"), shown).alias("p"), parsing.citations_hold(F.col("raw"), shown).alias("holds"))
    assert "Python" not in made._jdf.queryExecution().toString()
    seen = set()
    for row in made.collect():
        wanted = parsing.verdict(cases[row["i"]], ["a", "b"])
        assert tuple(row["p"]) == wanted, cases[row["i"]]
        assert row["holds"] == parsing.cites_shown(cases[row["i"]], ["a", "b"]), cases[row["i"]]
        seen |= set(wanted[3]) or {"fine"}
    assert len(seen) >= 10


def test_decisions_are_parsed_as_by_python(spark):
    draw = random.Random(5)
    good = ['"SUPPORT"', '"INSUFFICIENT"', "[]", "[0]", "[0, 2]", "[2, 1]"]
    bad = ["[3]", "[-1]", "[0, 0]", "[1.0]", "[true]", '["1"]', "[1e0]", "[-0]", "[12345678901234567890123]", "null", "{}", '"MAYBE"', "7", "[null]"]
    cases = []
    for _ in range(1500):
        raw = generated(draw, ("decision", "rationale_sentences"), good, bad)
        if draw.random() < 0.6:
            raw = f'{{"decision": {draw.choice(good[:2] + bad[11:13])}, "rationale_sentences": {draw.choice(good[2:] + bad[:10])}}}'
        cases.append(raw)
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, raw string").repartition(3)
    made = rows.select("i", parsing.parse_decision(F.col("raw"), F.lit(3)).alias("p"))
    assert "Python" not in made._jdf.queryExecution().toString()
    for row in made.collect():
        assert tuple(row["p"]) == parsing.decision(cases[row["i"]], 3), cases[row["i"]]
    few = spark.createDataFrame([('{"decision": "SUPPORT", "rationale_sentences": [0]}', None)], "raw string, n int").select(parsing.parse_decision(F.col("raw"), F.col("n")).alias("p")).first()
    assert few["p"]["errors"] == ["invalid_rationale_indices"]


def test_target_json_is_compact_and_in_order(spark):
    rows = [("SUPPORT", [2, 0]), ("INSUFFICIENT", []), ("INSUFFICIENT", None), (None, [1])]
    made = [r[0] for r in spark.createDataFrame(rows, "d string, r array<int>").select(parsing.target_json(F.col("d"), F.col("r"))).collect()]
    assert made[:3] == [json.dumps({"decision": d, "rationale_sentences": r or []}, separators=(",", ":")) for d, r in rows[:3]]
    assert parsing.decision(made[0], 3)[:2] == ("SUPPORT", [2, 0])


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")
@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_evidence_within_a_budget_of_subwords(spark, name):
    with open(f"{TOKENIZERS}/{name}", "rb") as file:
        words = parsing.Subwords(file.read())
    draw = random.Random(6)
    syllables = ["the", "tion", "Ña", "é", "漢字", "𝄞", "ing", "  ", "\t", "x" * 30, "é", "]", "[TRUNCATED]", "‍"]
    text = lambda n: "".join(draw.choice(syllables) + draw.choice(["", " "]) for _ in range(draw.randrange(n)))
    rows = [(i, [(str(d), text(8), [text(40) for _ in range(draw.randrange(6))]) for d in range(draw.randrange(5))]) for i in range(120)]
    frame = spark.createDataFrame(rows, "i int, docs array<struct<id string, title string, sentences array<string>>>").repartition(3)
    for budget in (1, 9, 40, 200):
        made = {r["i"]: r["e"] for r in frame.select("i", parsing.budget_evidence(F.col("docs"), budget, words).alias("e")).collect()}
        for i, docs in rows:
            assert len(words.encode(made[i]["text"])) == made[i]["after"] <= budget
            assert made[i]["truncated"] == (made[i]["before"] > budget)
            assert tuple(made[i]) == parsing.budgeted(docs, budget, words.encode, words.decode)
