"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a run that are hashed; the others may
differ.  The hashes of all runs of test items are joined with those of all
runs of training texts, and around every hit the two texts are compared
token by token on the hit's diagonal, so overlaps with substituted tokens are found.

Everything is DataFrame expressions.  A document's token hashes stay in its row
while its runs are enumerated and probed: only the diagonals that a run names leave it, gathered for each
item, and only documents with such a diagonal are read again to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import small, store

#: Hashed positions of a run, the first and last included, as many in every mask.  Any run of 12 tokens with one
#: substitution, and nearly all with two, holds one of the masks unharmed.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (0, 1, 4, 6, 8))
#: Tokens in a row that are hashed for items of fewer than 8 tokens, by their number: up to 4 tokens must all agree, and of
#: 5, 6 or 7 one may differ, which leaves as many in a row unharmed.
SHORT = {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 3, 7: 3}
#: Items of up to this many tokens are their own seed.
WHOLE = 4
#: An item leaks where a stretch of this many of its tokens (all, if it has fewer) agrees in this percentage.
WINDOW, PERCENT = 20, 80


def tokens(text: Column) -> Column:
    """The lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row per mask and start that fits: `at`, `which` mask and the seed's hash, beside the columns of `rows` with array `h`."""
    # explode_outer, and no filter before it: a filter would be pushed below the hashing and do it twice.
    starts = rows.withColumn("run", F.explode_outer(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") * len(masks) - 1))))
    at, which = F.expr(f"run div {len(masks)}").cast("int"), F.expr(f"run % {len(masks)}").cast("int")
    # The masks' offsets are looked up in constant arrays: an expression per mask would make code too long to be compiled.
    # A mask of fewer positions has nulls for the rest, which a hash passes over.
    looked_up = lambda values: F.get(F.array(*[F.lit(v).cast("int") for v in values]), which)
    offset = [looked_up([m[k] if k < len(m) else None for m in masks]) for k in range(max(map(len, masks)))]
    seed = F.xxhash64(which, *[F.get("h", at + o) for o in offset])
    return starts.where(at + looked_up([m[-1] for m in masks]) < F.size("h")).withColumns({"at": at, "which": which, "seed": seed}).drop("run")


def _diagonals(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...], window: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, number, window, matched) of texts that hold items, (number, item_id))."""
    named = store(items.where("item_id IS NOT NULL").select("item_id", _hashes(F.col("text")).alias("h")).where("size(h) > 0").withColumn("number", F.xxhash64("h")))
    tests = store(named.select("number", "h").dropDuplicates(["number"]))
    short = sorted({SHORT[r[0]] for r in tests.select(F.size("h")).where(F.size("h") <= max(SHORT)).distinct().collect()})  # a few lengths
    used = [*masks, *(tuple(range(k)) for k in short)]
    own = F.get(F.array(F.lit(-1), *[F.lit(len(masks) + short.index(k) if k in short else -1) for _, k in sorted(SHORT.items())]), F.size("h"))
    seeds = _seeds(tests, used).where((F.col("which") < len(masks)) & own.isNull() | (F.col("which") == own)).select("seed", "number", F.col("at").alias("item_at")).distinct()

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), _hashes(F.col("text")).alias("h"))
    hits = _seeds(texts, used).select("doc_id", "text_hash", "seed", "at").join(small(store(seeds)), "seed")
    # A row per text and item, with its diagonals: a text's tokens stand beside each of its items once, however often a common word of it occurs.
    hits = store(hits.groupBy("doc_id", "text_hash", "number").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts")))
    again = docs.where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text")).join(small(hits.select("doc_id", "text_hash").distinct()), ["doc_id", "text_hash"], "left_semi")
    again = again.select("doc_id", "text_hash", _hashes(F.col("text")).alias("h"))
    beside = again.join(small(hits), ["doc_id", "text_hash"]).join(small(tests.withColumnRenamed("h", "item")), "number")
    # An item whose seed is the whole of it agrees on every diagonal, and one will do.
    beside = beside.withColumn("shifts", F.when(F.size("item") <= F.lit(WHOLE), F.slice("shifts", 1, 1)).otherwise(F.col("shifts")))
    # Of every diagonal the flags of agreeing tokens, and their largest sum over a stretch; the best of all.
    best = """array_max(transform(shifts, shift -> transform(array(transform(item, (t, j) -> if(get(h, j + shift) = t, 1, 0))), agree ->
        aggregate(sequence(0, size(agree) - 1), named_struct('sum', 0, 'best', 0), (s, j) -> transform(
            array(s.sum + agree[j] - if(j < window, 0, agree[greatest(j - window, 0)])), n -> named_struct('sum', n, 'best', greatest(s.best, n)))[0], s -> s.best))[0]))"""
    flagged = beside.withColumn("window", F.least(F.lit(window), F.size("item"))).select("doc_id", "text_hash", "number", "window", F.expr(best).alias("matched"))
    found = flagged.where(F.col("matched") * 100 >= F.col("window") * percent).distinct()  # rows that repeat an id with its text
    return found, named.select("number", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, window): the documents that hold test items, with the tokens that agree in the best stretch.

    Tokens are lower-cased runs of letters and digits of whole texts.  A
    document and an item are compared on every diagonal on which they share a
    seed.  On it the item leaks where `window` consecutive tokens of the
    item (or all, if it has fewer) agree with the document's in at least `percent`.
    Items of fewer than 8 tokens have seeds of their own that miss nothing; down to one
    token, an item leaks into every document that holds it.

    Null or empty texts and items leak nothing; null ids likewise.  A text of any length is
    compared whole.  Rows that repeat an id are taken
    together, the best stretch of their texts counting.  Equal items leak together.  Empty tables give an
    empty one.  Extra columns are ignored.
    """
    found, named = _diagonals(docs, items, masks, window, percent)
    return found.join(named, "number").groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without those that hold test items, all columns kept; rows with a null id stay, and of rows that repeat an id those whose own text holds none."""
    found, _ = _diagonals(docs, items, MASKS, WINDOW, PERCENT)
    gone = store(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(small(gone), (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")
