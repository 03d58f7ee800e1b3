"""Text expressions: tokens, normal forms, fingerprints, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def normalized(text: Column) -> Column:
    """Tokens joined by one space, sharp s as ss, so texts that differ in case and marks agree."""
    return F.array_join(tokens(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), " ")


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the lower-cased, white-space-collapsed parts joined by spaces; nulls are skipped."""
    return F.sha2(collapsed(F.lower(F.concat_ws(" ", *parts))), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two token arrays; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def numbered_lines(sentences: Column) -> Column:
    """'[i] sentence' lines, numbered from 0."""
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def article(title: Column, sentences: Column) -> Column:
    """Title and sentences as one text."""
    return F.trim(F.concat_ws(" ", title, F.array_join(sentences, " ")))


def seeded_order(seed: object, *ids: Column) -> Column:
    """A reproducible random order: md5 of the seed and the ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def right_padded(ids: Column, width: Column, pad: int) -> Column:
    """An id array filled up on the right to `width`."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), width - F.size(ids)).cast("int")))


def masked_labels(prompt_ids: Column, full_ids: Column, ignore: int = -100) -> Column:
    """Labels of a training row: the prompt's places ignored, the target's kept; null where the prompt is no prefix."""
    n = F.size(prompt_ids)
    fits = F.slice(full_ids, 1, n) == prompt_ids
    return F.when(fits, F.transform(full_ids, lambda x, i: F.when(i < n, F.lit(ignore)).otherwise(x)))


def excerpt(text: Column, most: int = 1600) -> Column:
    """The first `most` characters."""
    return F.substring(text, 1, most)


def first_seen(values: Column) -> Column:
    """The distinct values of an array in the order in which they come first."""
    return F.array_distinct(values)
