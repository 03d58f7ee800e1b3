"""Vectorised hashing of whole texts, used inside Arrow tasks.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
bytes other than space and \\x09-\\x0D; A-Z counts as a-z.  Every word gets a
64-bit hash from one prefix sum over the buffer, so the cost is a few numpy
passes per byte and no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so temporaries stay near 50 MB.
SLICE_BYTES = 750_000
#: Bytes that are looked up together; their places take eight bytes each.
_PART = 1 << 14

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    byte_value = np.random.RandomState(20240607).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    byte_value[65:91] = byte_value[97:123]
    return byte_value


BYTE_VALUE = _byte_values()
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: The running sums of a slice, in memory that is used again: large arrays made anew cost as much as the sums.
_SUMS: list[np.ndarray] = [np.zeros(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POW[i] = np.multiply.accumulate(factors)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of about `most` bytes; a null text has no bytes."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words up to each text) of all words of a slice; a word never crosses a text's end."""
    word = data != 32
    word &= data - np.uint8(9) > 4  # below 9 wraps round
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z, the same wherever the span stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    if len(_SUMS[0]) <= len(data):
        _SUMS[0] = np.zeros(len(data) + 1, np.uint64)
    sums = _SUMS[0][: len(data) + 1]  # the first stays 0
    for at in range(0, len(data), _PART):
        part = sums[at + 1 : at + _PART + 1]
        BYTE_VALUE.take(data[at : at + _PART], out=part, mode="clip")
        part *= power[at : at + len(part)]
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MUL)


def shingles(words: np.ndarray, upto: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words, and how many come up to each text.

    A text of fewer words, but one at least, has its whole sequence as its only run.
    """
    counts = np.diff(upto)
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = np.zeros(len(upto), np.int64)
    np.cumsum(per_text, out=total[1:])
    out = np.zeros(int(total[-1]), np.uint64)
    if len(words) >= width:
        runs = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            runs = mix(runs * _MUL + words[k : len(words) - width + 1 + k])
        long = np.flatnonzero(counts >= width)
        n = per_text[long]
        begin = np.repeat(upto[:-1][long] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        target = np.repeat(total[:-1][long] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out[target] = runs[begin]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.array([np.uint64(counts[i])])
        for w in words[upto[i] : upto[i + 1]]:
            h = mix(h * _MUL + w)
        out[total[i]] = h[0]
    return out, total
