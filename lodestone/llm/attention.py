"""LM scoring by a causal self-attention model on subword ids, trained and run in numpy.

A text is its lower-cased words; each word is a run of subword ids of a public
tokenizer, whose file is a parameter.  The next id is predicted in two
steps.  Its class (one of a few dozen groups of ids) comes from a
self-attention layer over the last ids, added to the classes that follow the last two
ids of the word in the corpus.  The id within the class comes from corpus counts of
ids given the two before in the word.  Counts are taken from all training texts, and the layer is trained in
parallel in one pass over all of them, the tasks' weights being averaged after every round.

Texts are encoded once, to two bytes an id, in a table that training and scoring read.  They are
scored in windows of `WINDOW` ids that overlap by half; each id is
scored once, by the window in which at least half a window (or the whole text) precedes it.

Beside the model's score stands the smoothed word-unigram score of the same
texts; counts and spellings of the commonest words go to every task, in a table of fixed size, and those of all
others come by a join.  So do counts of three ids beyond the commonest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import texthash
from lodestone.runtime import bounded_batches, store

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Ids seen by attention; half of them are scored by a window.
WINDOW = 32
#: Ids with symbols of their own; classes; an id's vector; queries, keys, values and gates.
KEPT, CLASSES, EMBED, DIM = 2048, 32, 16, 8
#: The symbols after the kept ids: another id, the start of a text, padding; as a context, another id that begins a word.
OTHER, START, PAD, BEGUN = KEPT, KEPT + 1, KEPT + 2, KEPT + 3
#: Words whose counts and ids every task holds.
COMMON = 1 << 18
#: Runs of three ids whose values every task holds, the commonest; those of others come by a join.
TRIPLES = 1 << 18
#: Pairs of ids, the commonest, whose following classes every task holds; others are judged by their last id.
PAIRS = 1 << 15
#: Parts of the training texts, one after the other in training; the tasks' weights are averaged after each.
ROUNDS = 2
#: Ids of a training block: the layer is trained on each block by itself, whose texts follow from the texts alone, and the blocks' layers are averaged.
BLOCK_IDS = 6_000_000
#: Windows of a training step, steps to a change of the ids' vectors, and ids whose windows are laid out together.
STEP, LATER, LAID = 64, 4, 1 << 19
#: Windows that are scored together; scores do not depend on it.
SIDE_BY_SIDE = 256
#: Bytes of text that are read together: larger slices tokenize a rare word less often.
SLICE_BYTES = 1_500_000
#: Weight of the estimate from the last two ids beside counts of three.
BACK = 10.0
#: Bounds of the layer's matrices and of an id's vector, by which no exponent of a score leaves the range of floats.
_MOST, _LENGTH = 3.0, 2.8
_FOLDS, _HELD_OUT = 7, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % _FOLDS) == _HELD_OUT


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased bytes of spans, as strings."""
    n = ends - starts
    offsets = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], n)
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[data[at]])])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique gives of hashes (sorted, where each stands first, each one's number): places are sorted along in the low bits, and hashes that agree in all others are noticed."""
    bits = np.uint64(len(h).bit_length())
    places = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    order = places.astype(np.int64)
    ordered = h[order]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(h, return_index=True, return_inverse=True)
    new = np.ones(len(h), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, word, n) over all texts: how often in training texts, 0 for words that only others hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, words = [], [], []
            learnt = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in texthash.text_slices(batch.column(0), SLICE_BYTES):
                starts, ends, upto = texthash.word_spans(data, offsets)
                h, first, which = _distinct(texthash.span_hashes(data, starts, ends))
                hashes.append(h)
                counts.append(np.bincount(which, np.repeat(learnt[lo:hi], np.diff(upto)), len(h)))
                words.append(_gather(data, starts[first], ends[first]))
            if hashes:
                h, first, which = _distinct(np.concatenate(hashes))
                n = np.bincount(which, np.concatenate(counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.concat_arrays(words).take(pa.array(first)), pa.array(n)], ["hash", "word", "n"])

    return docs.select("text", (~held_out(F.col("doc_id"))).alias("learnt")).mapInArrow(run, "hash long, word string, n long").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _commonest(rows: DataFrame, most: int) -> DataFrame:
    """The rows (..., n) of the largest n, at most `most`: whole classes of 64 to a doubling, from the top down."""
    grade = F.floor(F.log2("n") * 64)
    left, least = most, None
    for row in sorted(rows.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["g"]):  # a few thousand classes
        if row["k"] > left:
            break
        left, least = left - row["k"], row["g"]
    return rows.where(grade >= least) if least is not None else rows.limit(0)


class Pieces:
    """A tokenizer, from its file or the file's content: words to runs of ids; `starts` tells which ids begin a word."""

    def __init__(self, source: str | bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=source) if isinstance(source, str) else sentencepiece.SentencePieceProcessor(model_proto=source)
        self.size = self.model.vocab_size()
        self.starts = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(self.size)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's begin; a word without ids is the unknown id."""
        runs = [r or [0] for r in self.model.encode(words, num_threads=1)]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))))
        return np.fromiter(chain.from_iterable(runs), np.int32, int(bounds[-1])), bounds


#: Logits are natural logarithms: the exponential takes them as they are, without a unit or a zero of its own.
_UNIT, _ZERO = np.float32(1), np.float32(0)
_exp = np.exp
#: Exponentials of logits within this, and their sums, are in the range of floats.
_RANGE = 80.0
_APART = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)
_CAUSAL = np.tri(WINDOW, dtype=np.float32)
_ONES = np.ones(max(WINDOW, CLASSES, DIM), np.float32)
_UNSEEN = np.where(_CAUSAL > 0, np.float32(0), np.float32(-np.inf))


def _over(sums: np.ndarray, width: int) -> np.ndarray:
    """1 / sums in `width` columns: rows are scaled faster by a whole table than by one number each."""
    return np.dot((1 / sums)[:, None], _ONES[None, :width])


def _within_range(logits: np.ndarray, bound: float) -> None:
    """Lowers rows by their largest logit, which leaves their softmax as it is, where `bound` on any logit does not rule out that exponentials leave the range of floats."""
    if not bound < _RANGE and not (logits.max() < _RANGE and logits.min() > -_RANGE):
        logits -= logits.max(1, keepdims=True)


@dataclass
class Model:
    """Symbols are the kept ids and OTHER; contexts are the symbols, START, PAD, BEGUN and then the commonest pairs."""

    symbol: np.ndarray  # of each id
    class_of: np.ndarray  # of each id; class 0 is the end of a text
    within: np.ndarray  # log P(kept id | class, symbol before), start ids not depending on it
    within_other: np.ndarray  # log of what an other id's own share in its class is multiplied by
    own: np.ndarray  # log P(id | class) of each id
    after: np.ndarray  # log P(class | context), from counts
    layer: dict[str, np.ndarray]
    last: np.ndarray  # symbol of each context
    goal: np.ndarray  # class of each context's last id
    pairs: np.ndarray | None = None  # sorted keys of the commonest pairs
    triples: tuple[np.ndarray, ...] = ()  # sorted keys of the commonest runs of three ids, and log P of their last

    def spelling(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(log P of each word's ids given their classes, words and keys of the runs of three that it leaves out); of the ids before, those of the word count."""
        s, c = self.symbol[ids], self.class_of[ids]
        n = np.diff(bounds)
        nth = np.arange(len(ids)) - np.repeat(bounds[:-1], n)
        one = np.where(nth >= 1, np.concatenate(([0], s[:-1]))[: len(s)], START)
        two = np.where(nth >= 2, np.concatenate(([0, 0], s[:-2]))[: len(s)], START)
        value = np.where(s < KEPT, self.within[one, np.minimum(s, KEPT - 1)].astype(np.float64), self.own[ids] + self.within_other[one, c])
        inner = np.flatnonzero((nth >= 1) & (s < KEPT))
        key = _triple(two[inner], one[inner], s[inner])
        known = np.zeros(len(key), bool)
        value[inner] = 0
        if self.triples and len(self.triples[0]):
            at = np.minimum(np.searchsorted(self.triples[0], key), len(self.triples[0]) - 1)
            known = self.triples[0][at] == key
            value[inner[known]] = self.triples[1][at[known]]
        sums = np.concatenate(([0.0], np.cumsum(value)))
        return sums[bounds[1:]] - sums[bounds[:-1]], np.repeat(np.arange(len(n)), n)[inner[~known]], key[~known]

    def of_three(self, key: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        """log P of the last of three ids given its class, by the run's count and that of all runs of the same two ids and class."""
        before = np.exp(self.within[key // (KEPT + 3) % (KEPT + 3), key % (KEPT + 3)].astype(np.float64))
        return np.log((n + BACK * before) / (total + BACK))

    def contexts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The context after each id of words: it and the id before it in the word, where common, else it alone."""
        s = self.symbol[ids]
        first = np.zeros(len(s), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        alone = np.where(first & (s == OTHER), BEGUN, s)
        if self.pairs is None or not len(self.pairs) or not len(s):
            return alone.astype(np.uint16)
        key = np.where(first, START, np.concatenate(([0], s[:-1]))) * (KEPT + 3) + s
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, BEGUN + 1 + at, alone).astype(np.uint16)

    def stream(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, class that each predicts, first prediction of each text) of texts of `n` ids each: START and the ids, then one place of padding."""
        base = np.cumsum(n + 1) - (n + 1)
        context = np.empty(int((n + 1).sum()) + 1, np.int32)
        inside = np.ones(len(context), bool)
        inside[base] = inside[-1] = False
        context[base], context[-1] = START, PAD
        context[inside] = codes
        goal = np.zeros(len(context), np.int32)  # 0: the end, and padding
        inside[:] = True
        inside[base + n] = inside[-1] = False
        goal[inside] = self.goal[codes]
        return context, goal, base

    def logits(self) -> np.ndarray:
        """`after`, padding sure of class 0."""
        table = self.after.astype(np.float32)
        table[PAD] = -30
        table[PAD, 0] = 0
        return table

    def class_sums(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P of the classes of each text's ids and of its end."""
        if not len(n):
            return np.zeros(0)
        w = self.layer
        context, goal, base = self.stream(codes, n)
        half, pad = WINDOW // 2, len(context) - 1
        query, key, valued, gate = (w["embed"] @ w[name] for name in _INWARD)
        gate += 1
        out, after = np.ascontiguousarray(w["out"]), self.logits()
        reach, highest = np.abs(out).sum(0).max(), np.abs(after).max()
        bias = w["near"][_APART] + _UNSEEN
        value = np.zeros(len(context))
        sums, product = np.empty((2, SIDE_BY_SIDE * half, CLASSES), np.float32)
        per_text = -(-(n + 1) // half)
        text = np.repeat(np.arange(len(n)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        # A text's first window has no earlier half; in all others every id up to a goal is real.
        for opening, length in ((True, half), (False, WINDOW)):
            which = np.flatnonzero((nth == 0) == opening)
            place = ((nth[which] - (not opening)) * half)[:, None] + np.arange(length)[None, :]
            flat = np.where(place < (n[text[which]] + 1)[:, None], base[text[which]][:, None] + place, pad)
            near = bias[length - half : length, :length]
            weights = np.empty((SIDE_BY_SIDE, half, length), np.float32)
            for at in range(0, len(flat), SIDE_BY_SIDE):
                part = flat[at : at + SIDE_BY_SIDE]
                goals = part[:, length - half :].ravel()
                seen = context.take(part)
                symbols = self.last.take(seen)
                ends = symbols[:, length - half :].ravel()
                k, v = (t.take(symbols.ravel(), 0).reshape(len(part), length, DIM) for t in (key, valued))
                weight = np.matmul(query.take(ends, 0).reshape(len(part), half, DIM), k.transpose(0, 2, 1), out=weights[: len(part)])
                weight += near
                np.exp(weight, out=weight)
                gated = np.matmul(weight, v).reshape(-1, DIM)
                gated *= gate.take(ends, 0)
                gated *= _over(weight.reshape(-1, length) @ _ONES[:length], DIM)
                logits = after.take(seen[:, length - half :].ravel(), 0, out=sums[: len(goals)], mode="clip")
                logits += np.matmul(gated, out, out=product[: len(goals)])
                _within_range(logits, max(gated.max(), -gated.min()) * reach + highest)
                chosen = logits.ravel().take(np.arange(0, logits.size, CLASSES) + goal.take(goals))
                np.exp(logits, out=logits)
                value[goals] = chosen - np.log(logits @ _ONES[:CLASSES])
        value[pad] = 0
        return np.add.reduceat(value[:-1], base)


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * (KEPT + 3) + b) * (KEPT + 3) + c


_INWARD = ("q", "k", "v", "gate")
_MATRICES = (*_INWARD, "out", "near")
_LAYER = ("embed", *_MATRICES)


class Trainer:
    """The layer under training, by steps of falling gradients scaled by their running size; buffers are used again in every step."""

    def __init__(self, model: Model, rate: float) -> None:
        self.model, self.rate, self.after, self.seen = model, np.float32(rate), model.logits(), 0
        self.highest = np.abs(self.after).max()
        # the matrices are parts of one run of numbers, and so are their gradients
        self.matrices = np.concatenate([model.layer[k].ravel() for k in _MATRICES])
        self.gradients, self.matrix_sizes = np.zeros_like(self.matrices), np.full_like(self.matrices, 1e-6)
        self.layer, self.gradient_of = ({k: p.reshape(model.layer[k].shape) for k, p in zip(_MATRICES, self._parts(run), strict=True)} for run in (self.matrices, self.gradients))
        self.layer["embed"] = model.layer["embed"].copy()
        self.vector_sizes = np.full_like(self.layer["embed"], 1e-10)
        self.buffers: dict[tuple, np.ndarray] = {}
        self.later: list[tuple[np.ndarray, np.ndarray]] = []

    def _parts(self, run: np.ndarray) -> list[np.ndarray]:
        return np.split(run, np.cumsum([self.model.layer[k].size for k in _MATRICES])[:-1])

    def _buffer(self, name: str, *shape: int) -> np.ndarray:
        key = (name, *shape)
        if key not in self.buffers:
            self.buffers[key] = np.empty(shape, np.float32)
        return self.buffers[key]

    def learn(self, codes: np.ndarray, n: np.ndarray, seed: int) -> None:
        """One pass over all ids of some texts, in windows side by side in a random order."""
        context, goal, base = self.model.stream(codes, n)
        per_text = -(-(n + 1) // WINDOW)
        text = np.repeat(np.arange(len(n)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        place = nth[:, None] * WINDOW + np.arange(WINDOW)[None, :]
        flat = np.where(place < (n[text] + 1)[:, None], base[text][:, None] + place, len(context) - 1)
        order = np.random.RandomState(seed).permutation(len(flat))
        for at in range(0, len(order), STEP):
            part = flat[order[at : at + STEP]]
            self.step(context.take(part), goal.take(part).ravel())
        if self.later:
            self.move_vectors()
        self.seen += len(context) - 1

    def step(self, context: np.ndarray, goal: np.ndarray) -> None:
        w, buffer, many = self.layer, self._buffer, len(context)
        total = many * WINDOW
        context = context.ravel()
        symbols = self.model.last.take(context)
        x = w["embed"].take(symbols, 0, out=buffer("x", total, EMBED), mode="clip")
        q, k, v, gate = (np.matmul(x, w[name], out=buffer(name, total, DIM)).reshape(many, WINDOW, DIM) for name in _INWARD)
        gate += 1
        weight = np.matmul(q, k.transpose(0, 2, 1), out=buffer("weight", many, WINDOW, WINDOW))
        weight += w["near"][_APART] + _UNSEEN
        np.exp(weight, out=weight)
        rows = weight.reshape(total, WINDOW)
        rows *= _over(rows @ _ONES[:WINDOW], WINDOW)
        mixed = np.matmul(weight, v, out=buffer("mixed", many, WINDOW, DIM))
        gated = np.multiply(mixed, gate, out=buffer("gated", many, WINDOW, DIM)).reshape(total, DIM)
        logits = self.after.take(context, 0, out=buffer("logits", total, CLASSES), mode="clip")
        logits += np.matmul(gated, w["out"], out=buffer("product", total, CLASSES))
        _within_range(logits, max(gated.max(), -gated.min()) * np.abs(w["out"]).sum(0).max() + self.highest)
        g = np.exp(logits, out=logits)  # chances, then their differences from the goals
        g *= _over(g @ _ONES[:CLASSES], CLASSES)
        g.ravel()[np.arange(0, total * CLASSES, CLASSES) + goal] -= 1
        self._move("out", (g.T @ gated).T / total)
        g_gated = np.matmul(g, np.ascontiguousarray(w["out"].T), out=buffer("g_gated", total, DIM)).reshape(many, WINDOW, DIM)
        g_parts = buffer("g_parts", many, WINDOW, 4 * DIM)
        np.multiply(g_gated, mixed, out=g_parts[..., 3 * DIM :])
        g_mixed = np.multiply(g_gated, gate, out=g_gated)
        g_weight = np.matmul(g_mixed, v.transpose(0, 2, 1), out=buffer("g_weight", many, WINDOW, WINDOW))
        np.matmul(weight.transpose(0, 2, 1), g_mixed, out=g_parts[..., 2 * DIM : 3 * DIM])
        g_weight -= (np.multiply(g_mixed, mixed, out=mixed) @ _ONES[:DIM])[..., None]  # weights of a position sum to 1
        g_weight *= weight
        np.matmul(g_weight, k, out=g_parts[..., :DIM])
        np.matmul(g_weight.transpose(0, 2, 1), q, out=g_parts[..., DIM : 2 * DIM])
        self._move("near", np.bincount(_APART.ravel(), (g_weight.sum(0) * _CAUSAL).ravel(), WINDOW) / total)
        flat = g_parts.reshape(total, 4 * DIM)
        inward = x.T @ flat / total
        for at, name in enumerate(_INWARD):
            self._move(name, inward[:, at * DIM : (at + 1) * DIM])
        self.later.append((symbols, np.hstack([w[name] for name in _INWARD]) @ flat.T))
        self.move_matrices()
        if len(self.later) == LATER:
            self.move_vectors()

    def move_matrices(self) -> None:
        """The step of all matrices by the gradients that `_move` has kept for them."""
        self._fall(self.matrices, self.matrix_sizes, self.gradients, 0.99, 1e-6)
        inward = self.matrices[: len(_INWARD) * EMBED * DIM].reshape(len(_INWARD), -1)
        inward *= np.minimum(1, _MOST / np.maximum(np.sqrt(np.einsum("md,md->m", inward, inward)), 1e-9)).astype(np.float32)[:, None]
        others = self.matrices[inward.size :]
        np.minimum(np.maximum(others, -4, out=others), 4, out=others)

    def move_vectors(self) -> None:
        symbols = np.concatenate([s for s, _ in self.later]).astype(np.int64)
        sums = np.stack([np.bincount(symbols, g, KEPT + 3) for g in np.concatenate([g for _, g in self.later], 1)], 1)
        self.later.clear()
        self._move("embed", sums / len(symbols))
        embed = self.layer["embed"]
        embed *= np.minimum(1, _LENGTH / np.maximum(np.sqrt(np.einsum("sd,sd->s", embed, embed)), 1e-9)).astype(np.float32)[:, None]

    def _move(self, name: str, gradient: np.ndarray) -> None:
        if name == "embed":
            self._fall(self.layer[name], self.vector_sizes, gradient.astype(np.float32), 0.97, 1e-7)
        else:
            self.gradient_of[name][...] = gradient

    def _fall(self, values: np.ndarray, sizes: np.ndarray, gradient: np.ndarray, keep: float, least: float) -> None:
        change = gradient * gradient
        change *= np.float32(1) - np.float32(keep)
        sizes *= np.float32(keep)
        sizes += change
        np.sqrt(sizes, out=change)
        change += np.float32(least)
        np.divide(gradient, change, out=change)
        change *= self.rate
        values -= change


def embedding(follow: np.ndarray) -> np.ndarray:
    """A vector of each symbol from what stands before and after it in words: leading directions of the scaled counts."""
    rng = np.random.RandomState(3)
    counts = follow[: KEPT + 1, : KEPT + 1].astype(np.float32)
    row, column = np.sqrt(counts.sum(1) + 1), np.sqrt(counts.sum(0) + 1)
    scaled = counts / row[:, None] / column[None, :]
    left = rng.standard_normal((KEPT + 1, EMBED // 2)).astype(np.float32)
    for _ in range(8):
        left = np.linalg.qr(scaled @ (scaled.T @ left))[0]
    right = np.linalg.qr(scaled.T @ left)[0]
    out = np.zeros((KEPT + 3, EMBED), np.float32)
    for part, side in ((left, slice(0, EMBED // 2)), (right, slice(EMBED // 2, EMBED))):
        out[: KEPT + 1, side] = 1.9 * part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    out[START] = rng.standard_normal(EMBED) * 0.5
    return out


def _classes(kept: np.ndarray, starts: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The class of each kept id: the commonest ids alone, the rest by k-means of what stands around them."""
    rng = np.random.RandomState(3)
    n = len(kept)
    ahead, behind = follow[:n, :n], follow[:n, :n].T
    sketch = np.hstack([np.sqrt(a / np.maximum(a.sum(1, keepdims=True), 1)) @ rng.standard_normal((n, EMBED // 2)) for a in (ahead, behind)]) if n else np.zeros((0, EMBED))
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    # 0 the end, 1 and 2 the other ids that begin a word or continue one
    alone = min(n, CLASSES // 3)
    out = np.zeros(n, np.int64)
    out[:alone] = 3 + np.arange(alone)
    free = CLASSES - 3 - alone
    for side, first, k in ((True, 3 + alone, free // 2), (False, 3 + alone + free // 2, free - free // 2)):
        at = np.flatnonzero(starts[kept] == side)
        at = at[at >= alone]
        if not len(at):
            continue
        centre = sketch[at[rng.permutation(len(at))[:k]]]
        for _ in range(15):
            near = (sketch[at] @ centre.T).argmax(1)
            centre = np.stack([sketch[at[near == c]].mean(0) if (near == c).any() else centre[c] for c in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        out[at] = first + near
    return out


def counted_model(pieces: Pieces, singles: np.ndarray, first: np.ndarray, follow: np.ndarray, last: np.ndarray, kept: np.ndarray, texts: float) -> Model:
    """The model from counts alone: of every id, and of kept ids (and all others as one) first in a word, after another, and last."""
    n = len(kept)
    symbol = np.full(pieces.size, KEPT)
    symbol[kept] = np.arange(n)
    class_of = np.where(pieces.starts, 1, 2)
    class_of[kept] = _classes(kept, pieces.starts, follow)
    prior = singles + 0.5
    size = np.bincount(class_of, prior, CLASSES)
    own = np.log(prior / size[class_of]).astype(np.float32)
    klass = np.full(KEPT, -1)
    klass[:n] = class_of[kept]
    one_hot = np.zeros((KEPT + 1, CLASSES), np.float32)
    one_hot[np.arange(n), klass[:n]] = 1
    to_class = follow @ one_hot
    to_class[:, 2] += follow[:, KEPT]  # other ids after another id continue a word
    share = np.zeros(KEPT)
    share[:n] = np.exp(own[kept])
    # within: add `heavy` times the id's own share to its counts
    heavy = 2.0
    within = np.full((KEPT + 3, KEPT), -30.0, np.float32)
    for c in range(CLASSES):
        members = np.flatnonzero(klass == c)
        if len(members):
            within[: KEPT + 1, members] = np.log((follow[:, members] + heavy * share[members]) / (to_class[:, [c]] + heavy))
            within[KEPT + 1 :, members] = np.log(share[members])
    begin = np.flatnonzero(np.concatenate([pieces.starts[kept], np.zeros(KEPT - n, bool)]))
    within[:, begin] = np.log(share[begin])
    within_other = np.zeros((KEPT + 3, CLASSES), np.float32)
    within_other[: KEPT + 1, 2] = np.log((follow[:, KEPT] + heavy * max(1 - share[klass == 2].sum(), 1e-6)) / (to_class[:, 2] + heavy)) - np.log(max(1 - share[klass == 2].sum(), 1e-6))
    words = max(first.sum(), 1.0)
    begins = first[:KEPT] @ one_hot[:KEPT]
    begins[1] += first[KEPT]
    begins = (begins + 0.1) / (words + 0.1 * CLASSES) * (words / (words + texts))
    begins[0] = max(texts, 1.0) / (words + max(texts, 1.0))
    after = to_class + last[:, None] * begins[None, :] + 0.5 * begins[None, :] + 1e-3
    after = np.vstack([after / after.sum(1, keepdims=True), begins[None, :] / begins.sum(), np.full((1, CLASSES), 1 / CLASSES)])
    after = np.vstack([after, after[[KEPT]]])  # another id that begins a word is judged as any other
    rng = np.random.RandomState(9)
    layer = {k: (rng.standard_normal((EMBED, DIM)) * 0.5 * EMBED**-0.5).astype(np.float32) for k in ("q", "k", "v", "gate")}
    layer |= {"embed": embedding(follow), "out": (rng.standard_normal((DIM, CLASSES)) * 0.02).astype(np.float32), "near": np.zeros(WINDOW, np.float32)}
    last = np.array([*range(KEPT + 3), OTHER], np.int16)
    goal = np.zeros(KEPT + 4, np.int32)
    goal[:n], goal[OTHER], goal[BEGUN] = class_of[kept], 2, 1
    return Model(symbol, class_of, within, within_other, own, np.log(after).astype(np.float32), layer, last, goal)


def _piece_counts(words: DataFrame, tokenizer: Broadcast, size: int) -> tuple:
    """(count of each id, kept ids, first, follow, last, words, triples): symbol counts weighted by the words' counts.

    words is (hash, ids, n) and triples (key, n); both have those of no training text too, with an n of 0.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer.value)
        for batch in batches:
            for at in range(0, len(batch), 100_000):
                part = batch.slice(at, 100_000)
                ids, bounds = pieces.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(2), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), part.column(1)], ["hash", "ids", "n"])

    coded = store(words.select("word", "n", "hash").mapInArrow(encode, "hash long, ids array<int>, n long"))
    rows = coded.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id of the tokenizer
    singles = np.zeros(size)
    for r in rows:
        singles[r["id"]] = r["n"]
    order = np.lexsort((np.arange(size), -singles))
    kept = order[: min(KEPT, int((singles > 0).sum()))]
    symbol = np.full(size, KEPT)
    symbol[kept] = np.arange(len(kept))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # -1 stands for the edge of a word
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            s = symbol[ids.flatten().to_numpy()]
            ends = np.cumsum(ids.value_lengths().to_numpy())
            starts = ends - ids.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(n)), ends - starts)
            inner = np.ones(len(s), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            left = np.concatenate([np.full(len(n), -1), s[at - 1], s[ends - 1]])
            right = np.concatenate([s[starts], s[at], np.full(len(n), -1)])
            key, which = np.unique((left + 1) * (KEPT + 2) + right + 1, return_inverse=True)
            total = np.bincount(which, np.concatenate([n, n[owner[at]], n]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total.astype(np.int64))], ["key", "n"])

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            s = symbol[ids.flatten().to_numpy()]
            ends = np.cumsum(ids.value_lengths().to_numpy())
            nth = np.arange(len(s)) - np.repeat(np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0))
            owner = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
            at = np.flatnonzero((nth >= 1) & (s < KEPT))
            two = np.where(nth[at] >= 2, s[np.maximum(at - 2, 0)], KEPT + 1)
            key, which = np.unique(_triple(two, s[at - 1], s[at]), return_inverse=True)
            total = np.bincount(which, n[owner[at]])
            # KEPT + 2 stands for the end of the word
            two = np.where(nth[ends - 1] >= 1, s[np.maximum(ends - 2, 0)], KEPT + 1)
            last, which = np.unique(_triple(two, s[ends - 1], np.full(len(ends), KEPT + 2)), return_inverse=True)
            total = np.concatenate([total, np.bincount(which, n)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, last])), pa.array(total)], ["key", "n"])

    symbols = coded.select("ids", "n")
    three = store(symbols.mapInArrow(triples, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    table = symbols.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # (KEPT + 2) ** 2 rows at most
    grid = np.zeros((KEPT + 2) ** 2)
    grid[table.column(0).to_numpy()] = table.column(1).to_numpy()
    grid = grid.reshape(KEPT + 2, KEPT + 2)
    return singles, kept, grid[0, 1:], grid[1:, 1:], grid[1:, 0], coded, three


def add_triples(model: Model, kept: np.ndarray, three: DataFrame) -> DataFrame:
    """(key, n, value) of all runs of three ids in words; the model gets the commonest, and classes after the commonest pairs."""
    klass = F.array(*[F.lit(int(c)) for c in model.class_of[kept]]) if len(kept) else F.array(F.lit(0))
    last, pair = F.col("key") % (KEPT + 3), F.floor(F.col("key") / (KEPT + 3))
    rows = three.select("key", "n", pair.alias("pair"), F.when(last < KEPT, F.get(klass, last.cast("int"))).otherwise(-1).alias("class"))  # -1: the end of the word
    sums = store(rows.groupBy("pair", "class").agg(F.sum("n").alias("total")))
    shared = three.sparkSession.sparkContext.broadcast(replace(model, layer={}, after=None, triples=()))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, total = (batch.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.of_three(key, n, total))], ["key", "n", "value"])

    values = store(rows.where("class >= 0").join(sums, ["pair", "class"]).select("key", "n", "total").mapInArrow(value, "key long, n long, value double"))
    top = _commonest(values.where("n > 0"), TRIPLES).toArrow()
    order = np.argsort(top.column(0).to_numpy())
    model.triples = (top.column(0).to_numpy()[order], top.column(2).to_numpy()[order])

    chosen = _commonest(store(sums.groupBy("pair").agg(F.sum("total").alias("n")).where("n > 0")), PAIRS).select("pair")
    found = sums.join(F.broadcast(chosen), "pair").toArrow()  # a row a class of each pair
    pairs, at = np.unique(found.column(0).to_numpy(), return_inverse=True)
    column, n = found.column(1).to_numpy(), found.column(2).to_numpy().astype(np.float64)
    table = np.zeros((len(pairs), CLASSES))
    inner = column >= 0
    np.add.at(table, (at[inner], column[inner]), n[inner])
    table += np.bincount(at[~inner], n[~inner], len(pairs))[:, None] * np.exp(model.after[KEPT + 1])[None, :]
    one = pairs % (KEPT + 3)
    table = (table + BACK * np.exp(model.after[one])) / (table.sum(1, keepdims=True) + BACK)
    of_other = np.where(pairs // (KEPT + 3) == START, 1, 2)
    model.goal = np.concatenate([model.goal, np.where(one == OTHER, of_other, model.goal[one])]).astype(np.int32)
    model.last = np.concatenate([model.last, one]).astype(np.int16)
    model.pairs, model.after = pairs, np.vstack([model.after, np.log(np.maximum(table, 1e-9))]).astype(np.float32)
    return values


def spelled(words: DataFrame, model: Model, values: DataFrame) -> DataFrame:
    """(hash, n, spelled) of `words` (hash, ids, n): log P of a word's ids given their classes, from the model's runs of three and `values` for all others."""
    shared = words.sparkSession.sparkContext.broadcast(replace(model, layer={}, after=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            bounds = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            settled, owner, key = shared.value.spelling(ids.flatten().to_numpy(), bounds)
            cuts = np.searchsorted(owner, np.arange(len(bounds))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(settled), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key))], ["hash", "n", "value", "open"])

    part = store(words.select("hash", "ids", "n").mapInArrow(run, "hash long, n long, value double, open array<long>"))
    rest = part.select("hash", F.explode("open").alias("key")).join(values.select("key", "value"), "key").select("hash", F.lit(0).cast("long").alias("n"), "value")
    return part.select("hash", "n", "value").unionByName(rest).groupBy("hash").agg(F.sum("n").alias("n"), F.sum("value").alias("spelled"))


class Reader:
    """Texts to word hashes and the contexts of their ids; common words by table, others by the tokenizer."""

    def __init__(self, tokenizer: bytes, hashes: np.ndarray, ids: np.ndarray, bounds: np.ndarray, model: Model) -> None:
        self.pieces, self.hashes, self.bounds, self.model = Pieces(tokenizer), hashes, bounds.astype(np.int32), model
        self.codes = model.contexts(ids, bounds)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(distinct words' hashes, their places in the table or -1, each word's distinct number, words up to each text, contexts after the ids, ids up to each text)."""
        starts, ends, upto = texthash.word_spans(data, offsets)
        h, first, which = _distinct(texthash.span_hashes(data, starts, ends))
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        rare = np.flatnonzero(~known)
        new_ids, new_bounds = self.pieces.encode(_gather(data, starts[first[rare]], ends[first[rare]]).to_pylist())
        begin, n = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        begin[known], n[known] = self.bounds[at[known]], self.bounds[at[known] + 1] - self.bounds[at[known]]
        begin[rare], n[rare] = len(self.codes) + new_bounds[:-1], np.diff(new_bounds)
        per_word = n[which]
        total = np.zeros(len(which) + 1, np.int32)
        np.cumsum(per_word, out=total[1:])
        take = np.repeat(begin[which] - total[:-1], per_word)
        take += np.arange(total[-1], dtype=np.int32)
        codes = np.concatenate([self.codes, self.model.contexts(new_ids, new_bounds)])
        return h, np.where(known, at, -1), which, upto, codes.take(take), total[upto]


def laid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, number of each text) of runs of encoded texts of about LAID ids."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)).astype(np.int64) // 2 if len(column) else np.zeros(0, np.int64)
    upto, at = np.concatenate(([0], np.cumsum(sizes))), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + LAID, "right")) - 1)
        part = column.slice(at, end - at)
        begin = int(np.frombuffer(part.buffers()[1], np.int32, 1, part.offset * 4)[0])
        data = part.buffers()[2]
        codes = np.frombuffer(data, np.uint8)[begin : begin + 2 * int(upto[end] - upto[at])].view(np.uint16) if data is not None and data.size else np.zeros(0, np.uint16)
        yield codes, sizes[at:end]
        at = end


def training_part(encoded: DataFrame, round_: int) -> DataFrame:
    """The codes of the training texts of a round; each text is in one of the ROUNDS, that of its codes."""
    return encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("codes"), F.lit(ROUNDS)) == round_)).select("codes")


def training_blocks(part: DataFrame, blocks: int) -> DataFrame:
    """(block, codes): the texts of a part dealt to blocks by their codes, each block in one task and in the order of another hash, however the input is partitioned."""
    key = F.xxhash64("codes", F.lit(7))
    dealt = part.select(F.pmod(F.xxhash64("codes", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), key.alias("key"), "codes")
    return dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "key", "codes").select("block", "codes")


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, codes, number of each text) of runs of about LAID ids of (block, codes), sorted by block: a text's run follows from the ids before it in its block, not from the batches."""
    held, at, block, before = [], None, None, 0
    for batch in batches:
        if not len(batch):
            continue
        blocks, column = batch.column(0).to_numpy(), batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets) // 2
        so_far = np.cumsum(sizes) - sizes
        begins = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        first = np.repeat(begins, np.diff(np.append(begins, len(blocks))))
        so_far = so_far - so_far[first] + np.where(blocks == block, before, 0)
        runs = so_far // LAID
        edges = np.flatnonzero((np.diff(blocks, prepend=blocks[0] - 1) != 0) | (np.diff(runs, prepend=-1) != 0))
        for a, b in zip(edges, np.append(edges[1:], len(blocks)), strict=True):
            key = (int(blocks[a]), int(runs[a]))
            if held and key != at:
                yield at[0], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            at = key
            held.append((data[offsets[a] : offsets[b]].view(np.uint16).copy(), sizes[a:b]))
        block, before = blocks[-1], int(so_far[-1] + sizes[-1])
    if held:
        yield at[0], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def scored(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    Scores are log10 probabilities of whole texts.  Tokens are the words, A-Z
    lower-cased, and one end a text; n_known counts those seen in training.  base_score
    adds one to every training count; score is the attention model's, over the words' subword ids
    and the end.  A null or empty text is its end alone; a text of any length is scored whole, window by window.

    A null id belongs to training.  Repeated rows are scored each and count each
    in training; other columns are ignored; an empty table gives an empty one, and
    with no training text the counts are all 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "16m")
    with open(tokenizer, "rb") as file:
        shipped = spark.sparkContext.broadcast(file.read())  # half a MB; tasks open no file of their machine
    pieces = Pieces(shipped.value)
    words = store(word_counts(docs))
    counts = words.where("n > 0")
    texts = docs.where(~held_out(F.col("doc_id"))).count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, kinds = total[0] + texts, total[1] + (texts > 0)
    log_all = np.log10(n_train + kinds + 1)
    top = _commonest(counts, COMMON).select("hash", "word", "n").toArrow()
    order = np.argsort(top.column(0).to_numpy().view(np.uint64))
    hashes = top.column(0).to_numpy().view(np.uint64)[order]
    common = top.column(2).to_numpy()[order]
    common_ids, common_bounds = pieces.encode([top.column(1)[int(i)].as_py() for i in order]) if len(order) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    singles, kept, first, follow, last, coded, three = _piece_counts(words, shipped, pieces.size)
    model = counted_model(pieces, singles, first, follow, last, kept, float(texts))
    values = add_triples(model, kept, three)
    named = F.broadcast(spark.createDataFrame(pa.table({"hash": pa.array(hashes.view(np.int64))})))
    found = spelled(coded.join(named, "hash", "left_semi"), model, values).select("hash", "spelled").toArrow()  # at most COMMON rows
    common_spelled = np.zeros(len(hashes))
    common_spelled[np.searchsorted(hashes, found.column(0).to_numpy().view(np.uint64))] = found.column(1).to_numpy()
    rare = spelled(coded.join(named, "hash", "left_anti"), model, values)

    # What encoding needs, a few MB.
    shared = spark.sparkContext.broadcast((replace(model, within=None, within_other=None, own=None, after=None, layer={}, triples=()), (hashes, common_ids, common_bounds), common, common_spelled))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known_counts, known_spelled = shared.value
        reader = Reader(shipped.value, *parts, now)
        logs, spellings = np.append(np.log10(known_counts + 1.0), 0.0), np.append(known_spelled, 0.0)  # -1, a word that is not common, counts 0
        for batch in batches:
            for lo, hi, data, offsets in texthash.text_slices(batch.column(3), SLICE_BYTES):
                h, at, which, upto, codes, bounds = reader.read(data, offsets)
                summed = lambda x: np.concatenate(([0], np.cumsum(x[which])))
                of_text = lambda x: pa.array(np.diff(summed(x)[upto]))
                # words that are not common, once a text, with how often
                text_of = np.repeat(np.arange(hi - lo), np.diff(upto))
                odd = np.flatnonzero(at[which] < 0)
                key, n = np.unique(text_of[odd] * max(len(h), 1) + which[odd], return_counts=True)
                cuts = np.searchsorted(key // max(len(h), 1), np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in range(3)),
                        pa.array(np.diff(upto) + 1),
                        of_text((at >= 0).astype(np.int64)),
                        of_text(logs[at]),
                        of_text(spellings[at]),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[key % max(len(h), 1)].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(n)),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))]),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "common", "value", "spelling", "odd", "times", "codes"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    encoded = store(rows.mapInArrow(encode, "row long, doc_id long, held_out boolean, n_tokens long, common long, value double, spelling double, odd array<long>, times array<long>, codes binary"))

    ids = encoded.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.octet_length("codes")), F.lit(0))).first()[0] // 2
    blocks = max(1, -(-ids // (ROUNDS * BLOCK_IDS)))
    slim = replace(model, symbol=None, class_of=None, within=None, within_other=None, own=None, triples=(), pairs=None)
    for round_ in range(ROUNDS):
        layer = spark.sparkContext.broadcast(slim)

        def learn(batches: Iterator[pa.RecordBatch], layer=layer, rate=0.006 * 0.3**round_, seed=round_) -> Iterator[pa.RecordBatch]:
            trainer, at = None, None

            def learnt() -> Iterator[pa.RecordBatch]:
                if trainer is not None and trainer.seen:
                    flat = np.concatenate([trainer.layer[k].ravel() for k in _LAYER]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * trainer.seen), pa.array(np.full(len(flat), float(trainer.seen)))], ["at", "value", "weight"])

            for block, codes, n in block_runs(batches):
                if block != at:
                    yield from learnt()
                    trainer, at = Trainer(layer.value, rate), block
                trainer.learn(codes, n, seed + trainer.seen)
            yield from learnt()

        mean = training_blocks(training_part(encoded, round_), blocks).mapInArrow(learn, "at long, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        layer.destroy()
        if mean.num_rows:
            flat = np.zeros(mean.num_rows)
            flat[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
            pieces_of = np.split(flat, np.cumsum([slim.layer[k].size for k in _LAYER])[:-1])
            slim = replace(slim, layer={k: p.reshape(slim.layer[k].shape).astype(np.float32) for k, p in zip(_LAYER, pieces_of, strict=True)})

    fitted = spark.sparkContext.broadcast(slim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [fitted.value.class_sums(codes, n) for codes, n in laid(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sums) if sums else np.zeros(0))], [*batch.schema.names[:-1], "classes"])

    done = encoded.drop("odd", "times").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, common long, value double, spelling double, classes double")
    odd = encoded.select("row", F.explode(F.arrays_zip("odd", "times")).alias("x")).select("row", F.col("x.odd").alias("hash"), F.col("x.times").alias("times"))
    found = odd.join(rare, "hash").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("of_more"), F.sum(F.col("times") * F.col("spelled")).alias("spelled")
    )
    end = float(np.log10(texts + 1.0))
    base = F.col("value") + F.coalesce("of_more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(log_all))
    known = F.col("common") + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))
    model_score = (F.col("classes") + F.col("spelling") + F.coalesce("spelled", F.lit(0.0))) / float(np.log(10))
    whole = store(done).join(found, "row", "left")
    return whole.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), base.alias("base_score"), model_score.alias("score"))
