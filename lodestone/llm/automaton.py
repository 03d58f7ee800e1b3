"""Weighted acyclic automata that count sequences, as numpy arrays.

A count transducer reads sequences of 64-bit labels and gives how often each was
counted.  It is built from sorted sequences: the arcs of each depth are the
distinct prefixes in order, an arc's weight the sum over all sequences that pass it, so a
prefix's count is the weight of its last arc.  States with equal right languages
(labels, weights and targets) are one, from the ends upward, so what follows often in the same
way is stored once.  Automata of the same range of prefixes are united by
summing weights, and composed with a sorted list of sequences to look up its counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np

from lodestone.llm.texthash import mix


def _slim(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then as many from first[1] and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Automaton:
    """Arcs of each depth: label, weight and target; states: the span of their arcs in the next depth."""

    def __init__(self, labels: list[np.ndarray], weights: list[np.ndarray], targets: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.labels, self.weights, self.targets, self.starts, self.sizes = labels, weights, targets, starts, sizes

    def __len__(self) -> int:
        return sum(map(len, self.labels))

    @classmethod
    def built(cls, rows: np.ndarray, counts: np.ndarray) -> Automaton:
        """From sequences in lexicographic order, one a row of uint64 labels, 0 where it has ended; equal rows may repeat."""
        depths = rows.shape[1]
        labels, weights, parents = [], [], []
        fresh = np.zeros(len(rows), bool)
        fresh[:1] = True
        above = np.zeros(len(rows), np.int64)
        running = np.concatenate(([0], np.cumsum(counts)))
        for d in range(depths):
            fresh[1:] |= rows[1:, d] != rows[:-1, d]
            there = rows[:, d] != 0
            begins = np.flatnonzero(fresh & there)
            if not len(begins):
                break
            # A prefix runs on until the next change in its labels, and sequences that end above it come before.
            changes = np.flatnonzero(fresh)
            ends = np.append(changes[1:], len(rows))[np.searchsorted(changes, begins)]
            labels.append(rows[begins, d])
            weights.append(running[ends] - running[begins])
            parents.append(above[begins])
            above = np.cumsum(fresh & there) - 1
        return cls._frozen(labels, weights, parents)

    @classmethod
    def _frozen(cls, labels: list, weights: list, parents: list) -> Automaton:
        """Merge the states of each depth whose arcs agree, deepest first; parents tell the arc above each arc."""
        targets, starts, sizes = [None] * len(labels), [None] * len(labels), [None] * len(labels)
        for d in range(len(labels) - 1, -1, -1):
            # States below the arcs of depth d: those of depth d + 1, grouped by parent.
            n = len(labels[d])
            if d == len(labels) - 1:
                targets[d], starts[d], sizes[d] = np.zeros(n, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
                continue
            size = np.bincount(parents[d + 1], minlength=n)
            first = np.cumsum(size) - size
            arc = mix(mix(labels[d + 1] ^ mix(weights[d + 1].astype(np.uint64))) + targets[d + 1].astype(np.uint64))
            place = np.arange(len(arc)) - np.repeat(first, size)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(arc + place.astype(np.uint64)))))
            sign = mix(sums[first + size] - sums[first] + size.astype(np.uint64))
            _, keep, state = np.unique(sign, return_index=True, return_inverse=True)
            same = size == size[keep][state]
            mine, theirs = _spans(first[same], size[same]), _spans(first[keep][state][same], size[same])
            agree = (labels[d + 1][mine] == labels[d + 1][theirs]) & (weights[d + 1][mine] == weights[d + 1][theirs]) & (targets[d + 1][mine] == targets[d + 1][theirs])
            owner = np.repeat(np.flatnonzero(same), size[same])
            same[owner[~agree]] = False
            alone = np.flatnonzero(~same)  # equal signs, other arcs
            state[alone] = len(keep) + np.arange(len(alone))
            keep = np.append(keep, alone)
            kept = _spans(first[keep], size[keep])
            labels[d + 1], weights[d + 1], targets[d + 1] = labels[d + 1][kept], weights[d + 1][kept], targets[d + 1][kept]
            targets[d], sizes[d] = state, size[keep]
            starts[d] = np.cumsum(sizes[d]) - sizes[d]
        return cls(labels, weights, targets, starts, sizes)

    def sequences(self, depths: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, weights) of the prefixes of each depth in order, rows padded with 0 to `depths`."""
        rows, state = np.zeros((1, depths), np.uint64), None
        for d, (label, weight, target) in enumerate(zip(self.labels, self.weights, self.targets, strict=True)):
            if state is None:
                size, arcs = np.array([len(label)]), np.arange(len(label))
            else:
                size = self.sizes[d - 1][state]
                arcs = _spans(self.starts[d - 1][state], size)
            rows = np.repeat(rows, size, axis=0)
            rows[:, d] = label[arcs]
            state = target[arcs]
            yield rows.copy(), weight[arcs]

    def pruned(self, least: int, depth: int = 1) -> Automaton:
        """Without the arcs of a lower weight from `depth` on: a sequence counts no more often than its prefixes."""
        labels, weights, parents = [], [], []
        state, place = None, None
        for d, (label, weight, target) in enumerate(zip(self.labels, self.weights, self.targets, strict=True)):
            if state is None:
                arcs, above = np.arange(len(label)), np.zeros(len(label), np.int64)
            else:
                size = self.sizes[d - 1][state]
                arcs, above = _spans(self.starts[d - 1][state], size), np.repeat(place, size)
            if d + 1 >= depth:
                good = weight[arcs] >= least
                arcs, above = arcs[good], above[good]
            if not len(arcs):
                break
            labels.append(label[arcs])
            weights.append(weight[arcs])
            parents.append(above)
            state, place = target[arcs], np.arange(len(arcs))
        return self._frozen(labels, weights, parents)

    @classmethod
    def united(cls, parts: list[Automaton], depths: int) -> Automaton:
        """The sum of several automata."""
        if len(parts) == 1:
            return parts[0]
        rows, counts = [], []
        for part in parts:
            # What ends at a prefix is its weight less the weights that go on below it.
            levels = list(part.sequences(depths))
            for d, (row, weight) in enumerate(levels):
                rest = weight.astype(np.int64)
                if d + 1 < len(levels):
                    deeper, below = levels[d + 1]
                    change = np.ones(len(deeper), bool)
                    change[1:] = (deeper[1:, : d + 1] != deeper[:-1, : d + 1]).any(1)
                    begins = np.flatnonzero(change)
                    sums = np.add.reduceat(below.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
                    # Prefixes without arcs below are those whose state is empty.
                    rest = rest.copy()
                    rest[np.flatnonzero(part.sizes[d][part.targets[d][part._arcs(d)]] > 0)] -= sums
                rows.append(row[rest > 0])
                counts.append(rest[rest > 0])
        return cls.counted(np.concatenate(rows), np.concatenate(counts))

    def _arcs(self, depth: int) -> np.ndarray:
        """The arcs that the prefixes of a depth, in order, end with."""
        arcs = np.arange(len(self.labels[0]))
        for d in range(1, depth + 1):
            state = self.targets[d - 1][arcs]
            arcs = _spans(self.starts[d - 1][state], self.sizes[d - 1][state])
        return arcs

    @classmethod
    def counted(cls, rows: np.ndarray, counts: np.ndarray) -> Automaton:
        """From sequences in any order."""
        order = np.lexsort(rows.T[::-1])
        return cls.built(rows[order], counts[order])

    def composed(self, asked: np.ndarray) -> np.ndarray:
        """The weights of the rows of `asked`, 0 for those that the automaton does not read: the paths of both are followed together, all rows a depth at a time."""
        n, found = len(asked), np.zeros(len(asked), np.int64)
        alive, state = np.arange(n), None
        for d in range(min(asked.shape[1], len(self.labels))):
            going = asked[alive, d] != 0
            alive, state = alive[going], None if state is None else state[going]
            if not len(alive):
                break
            low = np.zeros(len(alive), np.int64) if state is None else self.starts[d - 1][state].astype(np.int64)
            high = low + (len(self.labels[0]) if state is None else self.sizes[d - 1][state].astype(np.int64))
            want, label, end = asked[alive, d], self.labels[d], high.copy()
            while (open_ := low < high).any():  # a binary search in every row's arcs
                middle = (low + high) // 2
                less = np.zeros(len(low), bool)
                less[open_] = label[middle[open_]] < want[open_]
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            hit = low < end
            hit[hit] = label[low[hit]] == want[hit]
            last = np.ones(len(alive), bool) if d + 1 == asked.shape[1] else asked[alive, d + 1] == 0
            done = hit & last
            found[alive[done]] = self.weights[d][low[done]]
            alive, state = alive[hit & ~last], self.targets[d][low[hit & ~last]].astype(np.int64)
        return found

    def packed(self) -> bytes:
        return pickle.dumps((self.labels, *([_slim(x) for x in part] for part in (self.weights, self.targets, self.starts, self.sizes))), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        labels, *rest = pickle.loads(data)
        return cls(labels, *([x.astype(np.int64) for x in part] for part in rest))
