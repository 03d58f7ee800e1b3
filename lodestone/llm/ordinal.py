"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document is a set of hashed features of its whole text.  One weight per
feature, shared by all grades, gives a score s; ordered thresholds
t_1 < t_2 < ... give P(grade >= k) = sigmoid(s - t_k).  From these come the
expected grade and the tail probability by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import texthash
from lodestone.runtime import bounded_batches

#: Features are hashed into this many weights.
DIMENSIONS = 1 << 18
#: Rated documents used for fitting, at most about: the fit's only bound.
FIT_ROWS = 16000

_LETTERS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the runs of letters and digits, A-Z as a-z."""
    inside = ~_LETTERS[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return texthash.span_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text.

    They are its words without marks, the last two bytes of its words as
    written, and graded shares: words equal to the one before, words of capitals,
    words ending in a mark, and words without letters.
    """
    for first, last, data, offsets in texthash.text_slices(column):
        starts, ends, upto = texthash.word_spans(data, offsets)
        n = np.diff(upto)
        text_of = np.repeat(np.arange(last - first), n)
        words = texthash.span_hashes(data, starts, ends)
        pieces, piece_of = _pieces(data, offsets)
        tails = data[np.maximum(ends - 2, 0)].astype(np.uint64) * np.uint64(256) + data[ends - 1] if len(ends) else np.zeros(0, np.uint64)
        tails = texthash.mix(tails + np.uint64(1 << 20))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])
        final, head = (data[ends - 1], data[np.maximum(ends - 2, starts)]) if len(ends) else (np.zeros(0, np.uint8),) * 2
        flags = [same, (head >= 65) & (head <= 90) | (final >= 65) & (final <= 90), _LETTERS[final], _LETTERS[final] & _LETTERS[head]]
        shares = []
        for k, flag in enumerate(flags):
            share = np.bincount(text_of[flag], minlength=last - first) / np.maximum(n, 1)
            grade = np.digitize(share, [1e-9, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64])
            shares.append(texthash.mix((np.uint64(1 << 22) + np.uint64(64 * k) + grade.astype(np.uint64))))
        all_of = np.concatenate([piece_of, text_of, *[np.flatnonzero(n > 0)] * len(flags)])
        which = np.concatenate([pieces, tails, *[s[n > 0] for s in shares]]) % np.uint64(DIMENSIONS)
        key = np.unique(all_of.astype(np.int64) * DIMENSIONS + which.astype(np.int64))
        bounds = np.searchsorted(key, np.arange(last - first + 1) * DIMENSIONS)
        for i in range(last - first):
            yield (key[bounds[i] : bounds[i + 1]] - i * DIMENSIONS).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """weights: one per feature; thresholds: ascending, one per grade above the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, indices: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and k = 1, 2, ..."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[indices], dtype=np.float64)))
        score = total[bounds[1:]] - total[bounds[:-1]]
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(sets: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Maximum likelihood with decay by full-batch Adam; features in under a thousandth of the rated texts, or in one, weigh nothing."""
    least = max(2, len(sets) // 1000)
    indices = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    used = np.bincount(indices, minlength=DIMENSIONS) >= least
    feature, place = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1
    keep = used[indices]
    sizes = np.add.reduceat(np.append(keep, False), np.cumsum([0, *map(len, sets)])[:-1], dtype=np.int64) if sets else np.zeros(0, np.int64)
    sizes[[i for i, s in enumerate(sets) if not len(s)]] = 0
    column = place[indices[keep]].astype(np.int64)
    del indices, keep
    some, starts = np.flatnonzero(sizes), np.concatenate(([0], np.cumsum(sizes)))[:-1][sizes > 0]
    w = np.zeros(len(feature))
    share = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, n_grades)])
    share = np.clip(share, 0.01, 0.99)
    t0, gaps = -np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 0.1))
    theta = np.concatenate(([t0], gaps))
    moments = [np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))]
    for step in range(1, rounds + 1):
        t = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))))
        score = np.zeros(len(sets))
        if len(some):
            score[some] = np.add.reduceat(w[column], starts)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))
        edge = np.hstack([np.ones((len(sets), 1)), above, np.zeros((len(sets), 1))])
        at = np.arange(len(sets))
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(sets), 1)), above * (1 - above), np.zeros((len(sets), 1))])
        lower, upper = slope[at, grades], slope[at, grades + 1]
        d_score = -(lower - upper) / p / max(len(sets), 1)
        g_t = np.zeros(len(t) + 2)
        np.add.at(g_t, grades, lower / p / max(len(sets), 1))
        np.add.at(g_t, grades + 1, -upper / p / max(len(sets), 1))
        g_t = g_t[1:-1]
        g_theta = np.concatenate(([g_t.sum()], [g_t[k:].sum() * np.exp(theta[k]) for k in range(1, len(theta))]))
        g = np.concatenate((np.bincount(column, np.repeat(d_score, sizes), len(w)) + decay * w, g_theta))
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    weights = np.zeros(DIMENSIONS)
    weights[feature] = w
    return Model(weights, np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:])))))


def fit_on(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, rows: int = FIT_ROWS) -> Model:
    """Fit on rated documents: `ratings` is (doc_id, grade 0..n_grades-1); beyond `rows` of them a sample by hash of the id.

    Null ids and grades are left out; of several grades of an id the lowest counts, and rows that repeat an id are fitted each.  Null and empty
    texts have no features; a text has at most DIMENSIONS of them, four bytes each, however long it is.  Without rated documents the model grades by fixed thresholds alone.
    """
    bounded_batches(docs.sparkSession, "4m")
    ratings = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = max(ratings.count(), 1)
    share = min(1.0, rows / n)
    sampled = ratings.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    known = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in features(batch.column(1))], pa.binary())], ["grade", "features"])

    table = known.mapInArrow(run, "grade int, features binary").toArrow().sort_by([("grade", "ascending"), ("features", "ascending")])
    sets = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column(1)]
    return fit(sets, table.column(0).to_numpy().astype(np.int64), n_grades)


def graded(docs: DataFrame, model: Model, least: float = 0.6) -> DataFrame:
    """(doc_id, score columns) per row: expected_grade, tail_probability of the best grade, kept.

    kept is true where the tail probability is at least `least`.  A null or
    empty text has no features: it is graded by the thresholds alone, like a
    text of unknown words.  A text of any length is graded whole.  Rows with null or repeated ids are graded like any
    other; other columns are ignored; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession, "4m")
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(weights, thresholds)
        for batch in batches:
            sets = list(features(batch.column(1)))
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
            tails = scorer.tails(np.concatenate(sets) if sets else np.zeros(0, np.int32), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], ["doc_id", "expected_grade", "tail_probability", "kept"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def kept_documents(docs: DataFrame, model: Model, least: float = 0.6) -> DataFrame:
    """The rows of `docs` that `graded` keeps, all columns as they are, whatever their names.

    Null and empty texts are graded by the thresholds alone, rows that repeat are each graded, and an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession, "4m")
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(weights, thresholds)
        for batch in batches:
            sets = list(features(batch.column(at)))
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
            tails = scorer.tails(np.concatenate(sets) if sets else np.zeros(0, np.int32), bounds)
            yield batch.filter(pa.array(tails[:, -1] >= least))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
