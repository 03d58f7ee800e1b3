from __future__ import annotations

import random
import re
from collections import Counter

from lodestone.llm import chat, spaced

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id string"


def toks(text):
    return [t for t in re.split(r"[^\w]+|_", (text or "").lower()) if t]


def brute(docs, items):
    """Every diagonal of every document and item, without seeds."""
    out = {}
    for d, text, _ in docs:
        h = toks(text)
        for i, item, _ in items:
            t = toks(item)
            if d is None or i is None or not t:
                continue
            w = min(20, len(t))
            for shift in range(-len(t), len(h) + 1):
                agree = [int(0 <= j + shift < len(h) and h[j + shift] == t[j]) for j in range(len(t))]
                best = max(sum(agree[s : s + w]) for s in range(len(t) - w + 1))
                if best * 100 >= w * 80:
                    old = out.get((d, i), (0, 0))
                    out[d, i] = (max(best, old[0]), max(w, old[1]))
    return out


def case():
    rng = random.Random(1)
    vocabulary = [f"tok{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 25, 40]))), "x") for i in range(8)]
    items += [(20, items[2][1].upper(), "x"), (21, None, "x"), (22, "", "x"), (23, "too short", "x"), (24, "tok3", "x"), (25, "tok1 tok2 tok3 tok4", "x"), (26, "tok5 tok6 tok7 tok8 tok9", "x"), (None, items[0][1], "x")]
    docs = []
    for i in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30]))]
        source = (items[rng.randrange(8)][1] or "").split()
        for _ in range(rng.choice([0, 1, 3, 8])):
            source[rng.randrange(len(source))] = "other"
        if i % 2:
            body += source[: rng.choice([len(source), len(source), max(5, len(source) // 2)])] + [rng.choice(vocabulary) for _ in range(5)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body), "x"))
    return [*docs, (None, items[3][1], "x"), (50, None, "x"), (51, "", "x"), (1, items[3][1], "x"), (52, ("pad " * 3000) + items[4][1], "x")], items


def test_leaks_as_brute_force(spark):
    docs, items = case()
    made = spaced.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["window"]) for r in made} == brute(docs, items)
    assert len(made) > 10


def test_clean_keeps_the_rest_and_its_columns(spark):
    docs, items = case()
    items = [r for r in items if r[0] not in (23, 24)]  # a single token leaks nearly everywhere
    flagged = lambda row: any(brute([row], items))  # noqa: E731  by its own text
    made = spaced.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert made.columns == ["doc_id", "text", "item_id"]
    assert sorted((r["doc_id"] for r in made.collect()), key=str) == sorted((r[0] for r in docs if not flagged(r)), key=str)


def test_recall_of_the_seeds_at_every_length(spark):
    rng = random.Random(9)
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 17, 20):
        for copy in range(40):
            own = [f"i{n}x{copy}x{k}" for k in range(n)]
            items.append((n * 100 + copy, " ".join(own), "x"))
            for k in rng.sample(range(n), n - -(-n * 80 // 100)):
                own[k] = "other"
            docs.append((n * 100 + copy, " ".join(["before", *own, "after"]), "x"))
    found = {(r["doc_id"], r["item_id"]) for r in spaced.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert all(d == i for d, i in found)
    recall = {n: sum((i, i) in found for i in range(n * 100, n * 100 + 40)) / 40 for n in {i // 100 for i, _, _ in items}}
    assert min(recall.values()) >= 0.9 and all(recall[n] == 1 for n in range(1, 8)), recall


def test_clean_keeps_other_texts_of_a_leaking_id(spark):
    docs, items = case()
    leaking = next(r for r in docs if (r[0], 3) in brute([r], [items[3]]))
    rows = [leaking, (leaking[0], "nothing of the kind", "x"), (leaking[0], None, "x")]
    made = spaced.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame([items[3]], ITEMS))
    assert sorted((r["text"] for r in made.collect()), key=str) == [None, "nothing of the kind"]


def test_common_words_name_many_diagonals(spark):
    rng = random.Random(11)
    common = " ".join(rng.choice(["the", "the", "of", "oak", "and"]) for _ in range(3000))
    close = common + " one the two the three the four " + common
    items = [(1, "the", "x"), (2, "the oak", "x"), (3, "the of the of the oak", "x"), (4, "one the two the three the four five", "x"), (5, "elm", "x"), (6, "the the the the the the the", "x")]
    docs = [(1, common, "a"), (2, close, "a"), (2, close, "b"), (3, "oak of", "a")]
    made = {(r["doc_id"], r["item_id"]): (r["matched"], r["window"]) for r in spaced.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert made == brute(docs, items) and made[1, 1] == (1, 1) and (2, 4) in made and (3, 2) not in made


def test_leaks_of_nothing(spark):
    docs, items = case()
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert spaced.leaks(none_d, spark.createDataFrame(items, ITEMS)).count() == 0
    assert spaced.leaks(spark.createDataFrame(docs, DOCS), none_i).count() == 0


def test_leaks_with_more_seeds_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spaced, "small", lambda df: df)
    docs, items = case()
    made = spaced.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in made} == set(brute(docs, items))


MESSAGES = "conv_id long, turn long, role string, text string, body string, hash int"


def talk():
    a = "The harbour opens at noon on Sundays.\nBring the blue papers with you."
    b = "Thank you, that is what I had hoped for."
    return [
        (1, 0, "user", a, "x", 0),
        (1, 1, "assistant", f"> {a.splitlines()[0]}\n> {a.splitlines()[1]}\n\n{b}", "x", 0),
        (1, 2, "user", "On Monday Ann wrote:\r\n>> THE HARBOUR opens at noon on sundays\r\n> thank you that is what I had hoped for\r\nWhich papers are the blue ones?", "x", 0),
        (1, 3, "assistant", "> Bring the blue papers with you!\nThose of the port office.", "x", 0),
        (2, 0, "user", ">thank you, that is what i had hoped for\nFrom another conversation I quote.", "x", 0),
        (2, 1, "assistant", "> never said anywhere in here at all\nNothing to link to.", "x", 0),
        (2, 2, None, None, "x", 0),
        (2, 2, "user", "", "x", 0),
        (3, 0, "user", ">", "x", 0),
        (None, 0, "user", f"> {b}\nno conversation", "x", 0),
        (4, None, "user", "no turn at all here", "x", 0),
    ]


def test_links_levels_and_order(spark):
    made = {(r["conv_id"], r["turn"], r["role"]): r for r in chat.linked(spark.createDataFrame(talk(), MESSAGES)).collect()}
    assert len(made) == len(talk())
    reply = made[1, 1, "assistant"]
    assert (reply["parent_conv"], reply["parent_turn"], reply["depth"], reply["body"]) == (1, 0, 1, "Thank you, that is what I had hoped for.")
    second = made[1, 2, "user"]
    assert (second["n_quotes"], second["n_linked"], second["parent_turn"], second["root_turn"], second["depth"]) == (2, 2, 1, 0, 2)
    assert second["body"] == "Which papers are the blue ones?"
    line = made[1, 3, "assistant"]
    assert (line["parent_turn"], line["depth"], line["position"]) == (0, 1, 3)
    assert [made[1, t, r]["position"] for t, r in ((0, "user"), (1, "assistant"), (2, "user"))] == [1, 2, 4]
    far = made[2, 0, "user"]
    assert (far["parent_conv"], far["parent_turn"], far["depth"], far["root_turn"]) == (1, 1, 0, 0)
    lost = made[2, 1, "assistant"]
    assert (lost["n_quotes"], lost["n_linked"], lost["parent_conv"]) == (1, 0, None)
    assert made[2, 2, None]["body"] is None and made[3, 0, "user"]["body"] == ""
    assert made[None, 0, "user"]["parent_conv"] is None


def test_short_passages_and_runs_of_lines(spark, monkeypatch):
    lines = ["First we load the cart.", "Then we feed the mule.", "--", "Last we lock the gate.", "Anything else to do today?"]
    rows = [
        (1, 0, "user", "Shall we?\nYes, I do", "x", 0),
        (1, 1, "assistant", "> Yes, I do\nFine.", "x", 0),
        (1, 2, "user", "\n".join(lines), "x", 0),
        (1, 3, "assistant", f"> {lines[1]}\n> {lines[3]}\nIt is locked.", "x", 0),
        (1, 4, "assistant", f"> {lines[0]}\n> {lines[3]}\nThese do not follow each other.", "x", 0),
        (1, 5, "user", "One paragraph of mine.\n\nAnother paragraph.\n\nA third one.", "x", 0),
        (1, 6, "assistant", "> One paragraph of mine.\n>\n> Another paragraph.\nBoth read.", "x", 0),
        (1, 7, "user", "> ...\n> yes i do\nStill?", "x", 0),
        (1, 8, "user", "> :-)\nNothing to find.", "x", 0),
        (2, 0, "user", "> Yes, I do\nNobody said so here.", "x", 0),
        (2, 1, "user", f"> {lines[0]}\n> {lines[1]}\nFrom elsewhere.", "x", 0),
        (2, 2, "user", "Yes, I do", "x", 0),
    ]
    for part in (chat.PART, 2):
        monkeypatch.setattr(chat, "PART", part)
        made = {(r["conv_id"], r["turn"]): r for r in chat.linked(spark.createDataFrame(rows, MESSAGES)).collect()}
        parents = {k: (r["parent_conv"], r["parent_turn"]) for k, r in made.items() if r["n_linked"]}
        assert parents == {(1, 1): (1, 0), (1, 3): (1, 2), (1, 6): (1, 5), (1, 7): (1, 0), (2, 1): (1, 2)}
        assert (made[1, 7]["root_turn"], made[1, 7]["depth"], made[1, 7]["position"]) == (0, 1, 3)


def test_rendered_parts_hold_every_message(spark):
    rows = [(1, t, "user", f"message number {t} of a long talk", "x", 0) for t in range(7)] + [(None, 0, "user", "alone", "x", 0)]
    made = sorted(((str(r["conv_id"]), r["part"], r["n_messages"], r["chat"]) for r in chat.rendered(spark.createDataFrame(rows, MESSAGES), 3).collect()))
    assert [r[:3] for r in made] == [("1", 0, 3), ("1", 1, 3), ("1", 2, 1), ("None", 0, 1)]
    assert "\n".join(r[3] for r in made[:3]) == "\n".join(f"<|user|>\n{r[3]}" for r in rows[:7])


def test_positions_are_whole_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 2)
    rows = [(1, t, "user", f"message number {t} of a long talk", "x", 0) for t in range(9)] * 2
    made = chat.linked(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted(r["position"] for r in made) == list(range(1, 19))
    assert all(r["position"] in (2 * r["turn"] + 1, 2 * r["turn"] + 2) for r in made)


def test_rendered_conversations(spark):
    made = {r["conv_id"]: r["chat"] for r in chat.rendered(spark.createDataFrame(talk(), MESSAGES)).collect()}
    assert made[1].split("<|")[1].startswith("user|>\nThe harbour") and ">" not in re.sub(r"\|>", "", made[1])
    assert chat.linked(spark.createDataFrame([], MESSAGES)).count() == 0


def test_long_reply_chains(spark):
    first = "The very first message of the chain is here."
    rows = [(1, 0, "user", first, "x", 0)]
    for t in range(1, 40):
        rows.append((1, t, "user", f"> {rows[-1][3].splitlines()[-1]}\nAnswer number {t} in this chain of replies", "x", 0))
    made = chat.linked(spark.createDataFrame(rows, MESSAGES)).collect()
    assert all(r["depth"] == r["turn"] == r["position"] - 1 and r["root_turn"] == 0 for r in made)


def test_native_plans(spark):
    docs, items = case()
    for made in (spaced.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)), chat.linked(spark.createDataFrame(talk(), MESSAGES))):
        assert not re.search("Python|Pandas|Arrow|Cartesian", made._jdf.queryExecution().executedPlan().toString())


def test_long_messages(spark):
    body = "\n".join(f"sentence number {k} of a very long message" for k in range(6000))
    rows = [(1, 0, "user", body, "x", 0), (1, 1, "user", "> sentence number 5999 of a very long message\nthat one", "x", 0), (1, 2, "user", "\n".join("> " + x for x in body.split("\n")) + "\nall", "x", 0)]
    made = {r["turn"]: r for r in chat.linked(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [made[k]["parent_turn"] for k in range(3)] == [None, 0, 0] and made[0]["body"] == body and made[2]["body"] == "all"


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def parsed_by_hand(text):
    """(body, passages as (level, text)) of a message."""
    if text is None:
        return None, []
    lines = text.split("\n")
    split = []
    for line in lines:
        mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
        split.append((mark.group(0).count(">") if mark else 0, line[mark.end() :] if mark else line, line))
    passages, own = [], []
    for k, (level, line, raw) in enumerate(split):
        if level:
            if k and split[k - 1][0] == level:
                passages[-1] = (level, passages[-1][1] + "\n" + line)
            else:
                passages.append((level, line))
        elif not (line.strip(" ").endswith("wrote:") and k + 1 < len(split) and split[k + 1][0]):
            own.append(raw)
    return ("\n".join(own).strip(" \t\n") if passages else text), passages


def holds(body, passage):
    """Whether a body, a paragraph, a line or some lines in a row of it are the passage."""
    wanted = normal(passage)
    if wanted in {normal(u) for u in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]}:
        return True
    lines, sought = ([n for n in map(normal, x.split("\n")) if n] for x in (body, passage))
    return len(sought) > 1 and any(lines[k : k + len(sought)] == sought for k in range(len(lines)))


def linked_by_hand(rows):
    read = [(conv, turn, role, *parsed_by_hand(text)) for conv, turn, role, text, *_ in rows]
    parents, linked = {}, Counter()
    for conv, turn, _, _, passages in read:
        best = None
        for at, (level, text) in enumerate(passages):
            if not normal(text) or conv is None or turn is None:
                continue
            near = [t for c, t, _, body, _ in read if c == conv and t is not None and t < turn and body and holds(body, text)]
            far = [(c, t) for c, t, _, body, _ in read if c is not None and c != conv and t is not None and body and len(normal(text)) >= chat.LEAST_LETTERS and holds(body, text)]
            place = (conv, max(near)) if near else min(far) if far else None
            if place:
                linked[conv, turn] += 1
                best = min(best or (level, at, place), (level, at, place))
        if best:
            parents[conv, turn] = best[2]
    out = []
    for conv, turn, role, body, passages in read:
        root, depth = turn, 0
        while (conv, root) in parents and parents[conv, root][0] == conv:
            root, depth = parents[conv, root][1], depth + 1
        out.append((conv, turn, role, body, len(passages), linked[conv, turn], *parents.get((conv, turn), (None, None)), root, depth))
    return out


def threads(seed):
    rng = random.Random(seed)
    words = [f"wort{k}" for k in range(40)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 6, 9]))) + rng.choice([".", "!", ""])
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(2, 9)):
            text = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                source = rng.choice(rows)[3] if rows and rng.random() < 0.2 else None
                earlier = [r for r in rows if r[0] == conv]
                if source is None and earlier:
                    source = rng.choice(earlier)[3]
                source = (source or line()).split("\n")
                lo = rng.randrange(len(source))
                cut = source[lo : lo + rng.choice([1, 2, len(source)])]
                mark = rng.choice(["> ", ">", "> > ", ">>"])
                if rng.random() < 0.3:
                    text.append("On Monday they wrote:")
                text += [mark + (x.upper() if rng.random() < 0.3 else x) for x in cut]
                if rng.random() < 0.5:
                    text.append(line())
            for _ in range(rng.randint(1, 4)):
                text.append(line())
                if rng.random() < 0.3:
                    text.append("")
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(text), "x", 0))
    return rows


def test_generated_threads_as_by_hand(spark):
    for seed in (1, 2):
        rows = threads(seed)
        made = chat.linked(spark.createDataFrame(rows, MESSAGES)).drop("position").collect()
        wanted = linked_by_hand(rows)
        assert sorted(map(tuple, made), key=str) == sorted(wanted, key=str)
        assert sum(r[5] for r in wanted) > 20 and max(r[9] for r in wanted) > 1 and any(r[6] not in (None, r[0]) for r in wanted)
        order = {}
        for r in chat.linked(spark.createDataFrame(rows, MESSAGES)).collect():
            order.setdefault(r["conv_id"], []).append((r["position"], r["root_turn"], r["depth"], r["turn"]))
        assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: x[1:]) for v in order.values())
