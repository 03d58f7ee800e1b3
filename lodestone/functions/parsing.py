"""Strict parsing of model outputs, and evidence cut to a token budget.

JSON here must be told apart to the type (true is not 1, 1.0 no index), and keys
exactly.  Columns of outputs are parsed as VARIANT, by expressions alone; `verdict`, `cites_shown` and
`decision` do the same to single outputs.  Where the two differ: a column has no NaN or Infinity, takes integers of more than 38 digits
for floating numbers, and calls every failure to parse a JSONDecodeError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LABELS = ("SUPPORT", "CONTRADICT", "INSUFFICIENT")
VERDICT = "label string, evidence_ids array<string>, explanation string, errors array<string>"
DECISION = "decision string, rationale array<bigint>, json_ok boolean, schema_ok boolean, decision_ok boolean, rationale_ok boolean, errors array<string>"
EVIDENCE = "text string, before int, after int, truncated boolean"

# Error codes and texts that consumers of the outputs know by name.
NOT_JSON, NOT_OBJECT, KEYS = "invalid_json", "output_not_object", "schema_keys"
LABEL, IDS_TYPE, IDS_TWICE, IDS_UNKNOWN, IDS_IDLE, WHY = "invalid_label", "invalid_evidence_ids_type", "duplicate_evidence_ids", "invented_evidence_id", "insufficient_with_citations", "invalid_explanation"
CHOICE, SPOTS_TYPE, SPOTS = "invalid_decision", "invalid_rationale_type", "invalid_rationale_indices"
NO_EVIDENCE, CUT, NOTHING_FITS = "[NO EVIDENCE DOCUMENTS PROVIDED]", "[TRUNCATED]", "[TRUNCATED: no text fit within evidence budget]"


def _json(raw: str | None) -> tuple[object, str | None]:
    """(value, name of what went wrong)."""
    if not isinstance(raw, str):
        return None, "TypeError"
    try:
        return json.loads(raw.strip()), None
    except (ValueError, RecursionError) as wrong:
        return None, type(wrong).__name__


def _strings(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def verdict(raw: str | None, allowed: list[str]) -> tuple:
    """(label, evidence_ids, explanation, errors) of an output with exactly these keys; the values are null on any error.

    `allowed` are the ids of the documents that were shown; another id is invented.
    """
    value, wrong = _json(raw)
    if wrong:
        return None, None, None, [f"{NOT_JSON}:{wrong}"]
    if not isinstance(value, dict):
        return None, None, None, [NOT_OBJECT]
    label, ids, why = (value.get(k) for k in ("label", "evidence_ids", "explanation"))
    listed = _strings(ids)
    found = {
        KEYS: value.keys() != {"label", "evidence_ids", "explanation"},
        LABEL: label not in LABELS,
        IDS_TYPE: not listed,
        IDS_TWICE: listed and len(ids) > len(set(ids)),
        IDS_UNKNOWN: listed and not set(ids).issubset(allowed),
        IDS_IDLE: listed and bool(ids) and label == "INSUFFICIENT",
        WHY: not (isinstance(why, str) and why.strip()),
    }
    errors = [code for code, is_so in found.items() if is_so]
    return (None, None, None, errors) if errors else (label, ids, why, [])


def cites_shown(raw: str | None, allowed: list[str]) -> bool:
    """Whether an output lists distinct ids of shown documents, whatever else is wrong with it."""
    value, _ = _json(raw)
    ids = value.get("evidence_ids") if isinstance(value, dict) else None
    return _strings(ids) and len(ids) == len(set(ids)) and set(ids).issubset(allowed)


def decision(raw: str | None, sentences: int) -> tuple:
    """(decision, rationale, four flags, errors) of an output with the keys decision and rationale_sentences.

    The decision stands wherever it is one of the labels, also beside a wrong rationale, which is then null.  Indices are whole
    numbers (no booleans, no floats), distinct, in 0..sentences-1, none for INSUFFICIENT and some for the other labels.
    """
    value, wrong = _json(raw)
    if wrong or not isinstance(value, dict):
        return None, None, not wrong, False, False, False, [NOT_JSON if wrong else NOT_OBJECT]
    label, spots = value.get("decision"), value.get("rationale_sentences")
    schema, known = value.keys() == {"decision", "rationale_sentences"}, label in LABELS
    whole = isinstance(spots, list) and all(type(i) is int for i in spots)
    fits = whole and known and len(spots) == len(set(spots)) and all(i in range(sentences) for i in spots) and bool(spots) == (label != "INSUFFICIENT")
    found = {KEYS: not schema, CHOICE: not known, SPOTS_TYPE: not whole, SPOTS: whole and not fits}
    return label if known else None, spots if fits else None, True, schema, known, fits, [code for code, is_so in found.items() if is_so]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype(object)


#: What Python strips from both ends of a text.
_STRIPPED = r"[\s\p{Z}\x1c-\x1f\x85]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_STRIPPED}|{_STRIPPED}$", "")


def _kind(value: Column) -> Column:
    """The type of a VARIANT as SQL names it; empty for none."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(value: Column) -> Column:
    """The string of a VARIANT that is one."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _items(value: Column) -> Column:
    """The elements of a VARIANT that is an array."""
    return F.when(F.startswith(_kind(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))


def _whole(value: Column) -> Column:
    """Whether a VARIANT is an integer; those beyond 64 bits are decimals without a fraction, of 19 digits and more."""
    digits = F.regexp_extract(_kind(value), r"^DECIMAL\((\d+),0\)$", 1)
    return (_kind(value) == "BIGINT") | (F.when(digits != "", digits.cast("int")).otherwise(0) > 18)


def _parsed(raw: Column) -> Column:
    """struct<json boolean, fields map<string, variant>> of an output: whether it is JSON, and the members of an object, the last of repeated keys.

    The output is read as the first of two elements, before its own md5: a parser stops at the end of a value, and what is left over would go unseen.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    seal = F.md5(raw)
    value = F.try_parse_json(F.concat(F.lit("["), _stripped(raw), F.lit(',"'), seal, F.lit('"]')))
    alone = lambda both: (F.size(both) == 2) & (_text(F.get(both, F.lit(1))) == seal)
    return _let(_items(value), lambda both: F.struct(F.coalesce(alone(both), F.lit(False)).alias("json"), F.when(alone(both), F.when(F.startswith(_kind(F.get(both, F.lit(0))), F.lit("OBJECT")), F.try_variant_get(F.get(both, F.lit(0)), "$", "map<string,variant>"))).alias("fields")))


def _listed_errors(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(is_so, F.lit(False)), F.lit(code)) for code, is_so in found.items()]))


def _ids(value: Column) -> Column:
    """The strings of an array of nothing else; null for any other value."""
    return _let(_items(value), lambda items: F.when(F.coalesce(F.forall(items, lambda x: _kind(x) == "STRING"), F.lit(False)), F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))))


def _other_keys(fields: Column, *keys: str) -> Column:
    return F.array_sort(F.map_keys(fields)) != F.array(*[F.lit(k) for k in sorted(keys)])


def parse_verdict(raw: Column, allowed: Column) -> Column:
    """struct<VERDICT> of each output, given the ids of the documents shown (array<string>; null: none)."""
    shown = F.coalesce(allowed.cast("array<string>"), F.array().cast("array<string>"))

    def judged(p: Column) -> Column:
        value = lambda key: F.try_element_at(p["fields"], F.lit(key))
        return _let(F.struct(_text(value("label")).alias("label"), _ids(value("evidence_ids")).alias("ids"), _text(value("explanation")).alias("why")), lambda v: ruled(p, v))

    def ruled(p: Column, v: Column) -> Column:
        label, ids, why = v["label"], v["ids"], v["why"]
        found = _listed_errors({
            KEYS: _other_keys(p["fields"], "label", "evidence_ids", "explanation"),
            LABEL: ~F.coalesce(label.isin(*LABELS), F.lit(False)),
            IDS_TYPE: ids.isNull(),
            IDS_TWICE: F.size(ids) > F.size(F.array_distinct(ids)),
            IDS_UNKNOWN: F.size(F.array_except(ids, shown)) > 0,
            IDS_IDLE: (F.size(ids) > 0) & (label == "INSUFFICIENT"),
            WHY: F.coalesce(_stripped(why) == "", F.lit(True)),
        })
        wrong = F.when(raw.isNull(), F.array(F.lit(f"{NOT_JSON}:TypeError"))).when(~p["json"], F.array(F.lit(f"{NOT_JSON}:JSONDecodeError"))).when(p["fields"].isNull(), F.array(F.lit(NOT_OBJECT))).otherwise(found)
        return _let(wrong, lambda errors: F.struct(F.when(F.size(errors) == 0, label).alias("label"), F.when(F.size(errors) == 0, ids).alias("evidence_ids"), F.when(F.size(errors) == 0, why).alias("explanation"), errors.alias("errors")))

    return _let(_parsed(raw), judged).cast(f"struct<{VERDICT}>")


def citations_hold(raw: Column, allowed: Column) -> Column:
    """`cites_shown` of each output."""
    shown = F.coalesce(allowed.cast("array<string>"), F.array().cast("array<string>"))
    held = lambda ids: (F.size(ids) == F.size(F.array_distinct(ids))) & (F.size(F.array_except(ids, shown)) == 0)
    return F.coalesce(_let(_parsed(raw), lambda p: _let(_ids(F.try_element_at(p["fields"], F.lit("evidence_ids"))), held)), F.lit(False))


def parse_decision(raw: Column, sentences: Column) -> Column:
    """struct<DECISION> of each output, given the number of sentences shown (null: none)."""
    shown = F.coalesce(sentences.cast("bigint"), F.lit(0))

    def read(p: Column) -> Column:
        value = lambda key: F.try_element_at(p["fields"], F.lit(key))
        spots = _let(_items(value("rationale_sentences")), lambda items: F.when(F.coalesce(F.forall(items, _whole), F.lit(False)), F.transform(items, lambda x: F.try_variant_get(x, "$", "bigint"))))
        return _let(F.struct(_text(value("decision")).alias("label"), spots.alias("spots")), lambda v: ruled(p, v))

    def ruled(p: Column, v: Column) -> Column:
        label, spots = v["label"], v["spots"]
        is_object, whole = p["fields"].isNotNull(), v["spots"].isNotNull()
        schema = F.coalesce(~_other_keys(p["fields"], "decision", "rationale_sentences"), F.lit(False))
        known = is_object & F.coalesce(label.isin(*LABELS), F.lit(False))
        inside = F.forall(spots, lambda x: F.coalesce((x >= 0) & (x < shown), F.lit(False)))
        fits = whole & known & F.coalesce((F.size(spots) == F.size(F.array_distinct(spots))) & inside & ((F.size(spots) > 0) == (label != "INSUFFICIENT")), F.lit(False))
        found = _listed_errors({KEYS: ~schema, CHOICE: ~known, SPOTS_TYPE: ~whole, SPOTS: whole & ~fits})
        errors = F.when(~p["json"], F.array(F.lit(NOT_JSON))).when(~is_object, F.array(F.lit(NOT_OBJECT))).otherwise(found)
        return F.struct(F.when(known, label).alias("decision"), F.when(fits, spots).alias("rationale"), p["json"].alias("json_ok"), schema.alias("schema_ok"), known.alias("decision_ok"), fits.alias("rationale_ok"), errors.alias("errors"))

    return _let(_parsed(F.coalesce(raw, F.lit(""))), read).cast(f"struct<{DECISION}>")


def target_json(decision: Column, rationale: Column) -> Column:
    """The compact JSON that a model is trained to answer with: the decision, then the rationale's sentence numbers (null: none)."""
    return F.to_json(F.struct(decision.alias("decision"), F.coalesce(rationale.cast("array<bigint>"), F.array().cast("array<bigint>")).alias("rationale_sentences")))


def white_space(text: str) -> list[str]:
    """The runs of characters other than space and \\x09-\\x0D."""
    return re.findall(r"[^\x20\x09-\x0d]+", text)


class Subwords:
    """A subword tokenizer from the bytes of its file, a sentencepiece model or a tokenizers JSON, which go to the tasks with it."""

    def __init__(self, data: bytes) -> None:
        self.data, self._made = data, None

    def __getstate__(self) -> dict:
        return {"data": self.data, "_made": None}

    def _tokenizer(self):
        if self._made is None:
            if self.data.lstrip()[:1] == b"{":
                from tokenizers import Tokenizer

                made = Tokenizer.from_str(self.data.decode())
                made.encode_special_tokens = True
                self._made = (lambda text: made.encode(text, add_special_tokens=False).ids, made.decode)
            else:
                from sentencepiece import SentencePieceProcessor

                model = SentencePieceProcessor(model_proto=self.data)
                self._made = (model.encode, model.decode)
        return self._made

    def encode(self, text: str) -> list[int]:
        return list(self._tokenizer()[0](text))

    def decode(self, ids: list[int]) -> str:
        return self._tokenizer()[1](list(ids))


class _Room:
    """The tokens that are left of a budget."""

    def __init__(self, tokens: int, count: Callable[[str], int]) -> None:
        self.left, self.count = tokens, count

    def takes(self, text: str) -> bool:
        """Whether a text fits; if so, its tokens are gone."""
        fits = self.count(text) <= self.left
        self.left -= self.count(text) if fits else 0
        return fits


def budgeted(documents: list[tuple[str, str, list[str]]], budget: int, tokenize: Callable[[str], list] = white_space, join: Callable[[list], str] = " ".join) -> tuple[str, int, int, bool]:
    """(text, tokens of all evidence, tokens of the text, whether it was cut) of (id, title, sentences) documents.

    Evidence that fits stays whole.  Else every document has its header and as many whole sentences
    as fit, then the marked beginning of the next; one whose header leaves no room is named with a marker where
    that fits.  The text never exceeds the budget: what its parts' joints add is cut off at the end, again and again where the
    beginning of a text has other tokens than the text.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    count = lambda text: len(tokenize(text))
    heads = [f"[EVIDENCE_ID: {name}] Title: {title}" for name, title, _ in documents]
    place = lambda name, k: f"[EVIDENCE_ID: {name}; SENTENCE: {k}] "
    whole = "\n\n".join("\n".join([head, *(place(name, k) + s for k, s in enumerate(sentences))]) for head, (name, _, sentences) in zip(heads, documents, strict=True)) or NO_EVIDENCE
    before = count(whole)
    if before <= budget:
        return whole, before, before, False
    room, parts = _Room(budget, count), []
    for head, (name, _, sentences) in zip(heads, documents, strict=True):
        if room.left - count(head) <= 2:
            marker = f"[EVIDENCE_ID: {name}] {NOTHING_FITS}"
            parts += [marker] if room.takes(marker) else []
            continue
        room.takes(head)
        shown = next((k for k, s in enumerate(sentences) if not room.takes(place(name, k) + s)), len(sentences))
        lines = [head, *(place(name, k) + s for k, s in enumerate(sentences[:shown]))]
        if shown < len(sentences):
            left = room.left - count(place(name, shown)) - count(" " + CUT)
            if left > 0:
                lines.append(f"{place(name, shown)}{join(tokenize(sentences[shown])[:left])} {CUT}")
                room.left = 0
        parts.append("\n".join(lines))
    text = "\n\n".join(parts)
    tokens, keep = tokenize(text), budget
    while len(tokens) > budget and keep > 0:
        text, keep = join(tokens[:keep]), keep - 1
        tokens = tokenize(text)
    return text, before, len(tokens), True


def budget_evidence(documents: Column, budget: int, tokenizer: Subwords | None = None) -> Column:
    """struct<EVIDENCE> per row: `budgeted` documents, array<struct<id string, title string, sentences array<string>>>, counted in tokens of the tokenizer, or white-space tokens without one; nulls are left out."""
    ways = (white_space, " ".join) if tokenizer is None else (tokenizer.encode, tokenizer.decode)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            rows = []
            for listed in column:
                shown = [(d["id"], d["title"] or "", [s for s in (d["sentences"] if d["sentences"] is not None else []) if s is not None]) for d in (listed if listed is not None else []) if d is not None]
                rows.append(budgeted(shown, budget, *ways))
            yield _frame(rows, EVIDENCE)

    return F.pandas_udf(run, EVIDENCE)(documents)


def messages(system: str, claim: Column, evidence: Column) -> Column:
    """The chat of a verification request: array<struct<role, content>> of the instructions, then claim and evidence."""
    asked = F.concat(F.lit("CLAIM:\n"), claim, F.lit("\n\nEVIDENCE:\n"), evidence)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), asked.alias("content")))


__all__ = ["DECISION", "EVIDENCE", "Subwords", "VERDICT", "budget_evidence", "budgeted", "citations_hold", "cites_shown", "decision", "messages", "parse_decision", "parse_verdict", "target_json", "verdict", "white_space"]
