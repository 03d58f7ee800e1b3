"""Embedding near-dedup by cover trees and dual traversal.

Vectors of a label fall into cells of like direction and, within those, into
blocks of bounded size.  A block is a cover tree: nested levels of nodes whose
radii halve, every node's centre being a point of the level below.  Pairs of blocks, then
pairs of nodes level by level, are dropped where the distance of their
centres exceeds both covering radii and the threshold, and taken whole where the
farthest points are near enough; the points that are left at the last level are decided by the cosine in double
precision, so the pairs are exact.

A pair of blocks gives the number of links per vector and ties each vector to the
first of its group, never the pairs themselves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import connected_components
from lodestone.runtime import small, store

#: Vectors of a block, about.
BLOCK = 1500
#: Children of a node pair from which on their centres are compared by a product of their own; fewer are gathered with those of other pairs.
WIDE = 2048
#: Cosines this near to the threshold are summed without rounding.
_CLOSE = 1e-12
#: Allowance of the bounds for rounding in distances taken from products; the cosine decides within it.
_SLACK = 1e-7


class CoverTree:
    """Points in depth-first order, and levels of nodes: centre, radius, range of points, range of children."""

    def __init__(self, points: np.ndarray) -> None:
        order = np.arange(len(points))
        centre, low, high = [0], [0], [len(points)]
        far_from = lambda at, c: np.sqrt(np.maximum(0, 2 - 2 * (points[at] @ points[c])))  # noqa: E731  unit vectors
        radius = float(far_from(order, 0).max()) if len(points) else 0.0
        levels = []
        while True:
            kids, k_centre, k_low, k_high = [], [], [], []
            reach = []
            for c, lo, hi in zip(centre, low, high, strict=True):
                own = order[lo:hi]
                away = far_from(own, c) if hi - lo > 1 else np.zeros(1)
                reach.append(float(away.max()))
                kids.append(len(k_centre))
                if reach[-1] <= _SLACK:
                    # Points that no longer differ: each its own child.
                    k_centre += own.tolist()
                    k_low += range(lo, hi)
                    k_high += range(lo + 1, hi + 1)
                    continue
                # Greedy net of half the radius, the node's own centre first.
                block = points[own]
                nearest, owner = away.copy(), np.zeros(len(own), np.int64)
                centres = [c]
                while True:
                    far = int(nearest.argmax())
                    if nearest[far] <= radius / 2:
                        break
                    centres.append(int(own[far]))
                    d = np.sqrt(np.maximum(0, 2 - 2 * (block @ block[far])))
                    closer = d < nearest
                    nearest[closer], owner[closer] = d[closer], len(centres) - 1
                stable = np.argsort(owner, kind="stable")
                order[lo:hi] = own[stable]
                sizes = np.bincount(owner, minlength=len(centres))
                ends = lo + np.cumsum(sizes)
                k_centre += centres
                k_low += (ends - sizes).tolist()
                k_high += ends.tolist()
            kids.append(len(k_centre))
            levels.append((np.array(centre), np.array(reach), np.array(low), np.array(high), np.array(kids)))
            if len(centre) == len(points):
                break
            centre, low, high, radius = k_centre, k_low, k_high, radius / 2
        self.points, self.order, self.levels = points, order, levels


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> bool:
    dot = math.fsum(a * b)
    return dot >= cosine * math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b))


def _children(tree: CoverTree, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first child on the next level, how many) of nodes; a tree at its last level stays there."""
    if depth >= len(tree.levels) - 1:
        return nodes, np.ones(len(nodes), np.int64)
    kids = tree.levels[depth][4]
    return kids[nodes], kids[nodes + 1] - kids[nodes]


def _opened(one: CoverTree, two: CoverTree, depth: int, i: np.ndarray, j: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(nodes of one, nodes of two, products of their centres) among the children of node pairs, without those that lie apart; the nodes of a part may repeat."""
    (fi, ni), (fj, nj) = _children(one, depth, i), _children(two, depth, j)
    a, b = (t.levels[min(depth + 1, len(t.levels) - 1)] for t in (one, two))
    wide = ni * nj >= WIDE

    def near(dots: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * dots)) <= reach + (limit + _SLACK)

    for k in np.flatnonzero(wide):
        left, right = slice(fi[k], fi[k] + ni[k]), slice(fj[k], fj[k] + nj[k])
        dots = one.points[a[0][left]] @ two.points[b[0][right]].T
        p, q = np.nonzero(near(dots, a[1][left][:, None] + b[1][right][None, :]))
        yield p + fi[k], q + fj[k], dots[p, q]
    few = np.flatnonzero(~wide)
    upto = np.cumsum((ni * nj)[few])
    start = 0
    while start < len(few):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 200_000, "right")))
        part = few[start:end]
        n = (ni * nj)[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nj[part], n)
        p, q = np.repeat(fi[part], n) + at // width, np.repeat(fj[part], n) + at % width
        dots = np.einsum("kd,kd->k", one.points[a[0][p]], two.points[b[0][q]])
        stay = near(dots, a[1][p] + b[1][q])
        yield p[stay], q[stay], dots[stay]
        start = end


def linked(one: CoverTree, two: CoverTree, raw_one: np.ndarray, raw_two: np.ndarray, cosine: float, tally: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Taken node pairs as ranges of depth-first positions, and single pairs of points, at `cosine` and above.

    Both trees are descended together, level by level.  `tally` gets (pairs compared, pairs neither dropped nor taken) of every level.
    """
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    taken: list[tuple[int, int, int, int]] = []
    i, j, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), -1
    last = max(len(one.levels), len(two.levels)) - 1
    while len(i) and depth < last:
        compared = 1
        if depth < 0:  # the roots
            parts = [(i, j, np.array([float(one.points[one.levels[0][0][0]] @ two.points[two.levels[0][0][0]])]))]
        else:
            compared = int((_children(one, depth, i)[1] * _children(two, depth, j)[1]).sum())
            parts = list(_opened(one, two, depth, i, j, limit))
        i, j, dots = (np.concatenate(x) for x in zip(*parts, strict=True))
        depth += 1
        a, b = (t.levels[min(depth, len(t.levels) - 1)] for t in (one, two))
        if depth < last:
            apart, reach = np.sqrt(np.maximum(0, 2 - 2 * dots)), a[1][i] + b[1][j]
            whole = apart + reach < limit - _SLACK
            taken += list(zip(a[2][i[whole]].tolist(), a[3][i[whole]].tolist(), b[2][j[whole]].tolist(), b[3][j[whole]].tolist(), strict=True))
            stay = ~whole & (apart <= reach + limit + _SLACK)
            i, j, dots = i[stay], j[stay], dots[stay]
        if tally is not None:
            tally.append((compared, len(i)))
    if not len(i):
        return taken, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Points are left, and their products decide.
    sure = dots >= cosine
    x, y = a[0][i], b[0][j]
    for k in np.flatnonzero(np.abs(dots - cosine) <= _CLOSE):
        sure[k] = _near(raw_one[x[k]], raw_two[y[k]], cosine)
    return taken, x[sure], y[sure]


def tree_of(raw: np.ndarray) -> CoverTree:
    """The cover tree of vectors made unit."""
    return CoverTree(raw / np.linalg.norm(raw, axis=1, keepdims=True))


def block_links(ids: list[np.ndarray], weights: list[np.ndarray], raw: list[np.ndarray], trees: list[CoverTree], same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links gained, id tied to) over a pair of blocks; for a block with itself every link counts for both ends."""
    one, two = trees[0], trees[-1]
    taken, p, q = linked(one, two, raw[0], raw[-1], cosine)
    n = [len(x) for x in ids]
    gain = [np.bincount(p, weights[-1][q], n[0]).astype(np.float64), np.bincount(q, weights[0][p], n[-1]).astype(np.float64)]
    base = 0 if same else n[0]
    tie = np.arange(base + n[-1])
    sums = [np.concatenate(([0], np.cumsum(w[t.order]))) for w, t in ((weights[0], one), (weights[-1], two))]
    heads, tails = [p], [q + base]
    for lo, hi, lo2, hi2 in taken:
        mine, theirs = one.order[lo:hi], two.order[lo2:hi2]
        gain[0][mine] += sums[1][hi2] - sums[1][lo2]
        gain[1][theirs] += sums[0][hi] - sums[0][lo]
        heads += [mine, np.full(len(theirs), mine[0])]
        tails += [np.full(len(mine), theirs[0] + base), theirs + base]
    u, v = np.concatenate(heads), np.concatenate(tails)
    while True:
        low = np.minimum(tie[u], tie[v])
        before = tie.copy()
        np.minimum.at(tie, u, low)
        np.minimum.at(tie, v, low)
        tie = tie[tie]
        if np.array_equal(before, tie):
            break
    if same:
        gain = [gain[0] - weights[0] * (gain[0] > 0)]  # a vector is no link of its own
    all_ids, links = np.concatenate(ids[: 1 if same else 2]), np.concatenate(gain)
    return all_ids, links.astype(np.int64), all_ids[tie]


def _codes(vectors: pd.Series) -> pd.Series:
    """12 bits: the signs of a vector's products with fixed directions."""
    out = np.zeros(len(vectors), np.int32)
    dims = vectors.map(len).to_numpy()
    for dim in np.unique(dims):
        planes = np.random.RandomState(5).standard_normal((dim, 12))
        at = np.flatnonzero(dims == dim)
        out[at] = (np.stack(vectors.iloc[at].to_numpy()) @ planes > 0) @ (1 << np.arange(12))
    return pd.Series(out)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors`, linked within a label by cosine in double precision.

    Vectors link where their labels are equal and not null, their dimensions
    equal and their cosine is at least `cosine`.  n_links counts the other vectors linked
    directly, equal ones included; component_id is the smallest vec_id reachable; kept marks the row whose vec_id that is.

    A vector that is null, empty or zero or holds null or non-finite
    components, or whose label or vec_id is null, links with nothing and is
    kept.  Labels may be of any type that can be text.  Repeated rows are vectors of their own that share a node.  Extra
    columns are ignored; an empty table gives an empty one.
    """
    sound = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").where(sound).select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = store(rows)
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # The cell is a code of signs of fixed projections, as many bits as the label's size asks for.
    classes = store(classes.withColumns({"code": F.pandas_udf(_codes, "int")("v"), "dim": F.size("v")}))
    sizes = classes.groupBy("label", "dim").count().withColumn("bits", F.least(F.lit(12), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("count") / block)))).cast("int"))
    placed = classes.join(small(store(sizes.drop("count"))), ["label", "dim"]).withColumn("cell", F.expr("pmod(code, shiftleft(1, bits))"))
    cells = placed.groupBy("label", "dim", "cell").count().withColumn("of", F.ceil(F.col("count") / block).cast("long"))
    placed = placed.join(cells.drop("count"), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), "of"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        middle = unit.mean(0)
        first = pdf.iloc[0]
        block_id = f"{first['label']}/{first['dim']}/{first['cell']}/{first['part']}"
        out = (block_id, first["label"], int(first["dim"]), middle.tolist(), float(np.linalg.norm(unit - middle, axis=1).max()), pdf["rep"].to_numpy(np.int64).tobytes(), pdf["copies"].to_numpy(np.int64).tobytes(), raw.tobytes(), pickle.dumps(tree_of(raw)))
        return pd.DataFrame([out], columns=["block", "label", "dim", "middle", "radius", "ids", "weights", "raw", "tree"])

    blocks = store(placed.groupBy("label", "dim", "cell", "part").applyInPandas(packed, "block string, label string, dim int, middle array<double>, radius double, ids binary, weights binary, raw binary, tree binary"))
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    a, b = (blocks.select("label", "dim", F.col("block").alias(f"b{k}"), F.col("middle").alias(f"m{k}"), F.col("radius").alias(f"r{k}")) for k in (1, 2))
    apart = F.sqrt(F.expr("aggregate(zip_with(m1, m2, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"))
    pairs = a.join(b, ["label", "dim"]).where("b1 <= b2").where(apart <= F.col("r1") + F.col("r2") + limit + _SLACK).select("b1", "b2")
    sides = [blocks.select(F.col("block").alias(f"b{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ids", "weights", "raw", "tree")]) for k in (1, 2)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = {c: batch.column(k)[row].as_py() for k, c in enumerate(batch.schema.names)}
                ids = [np.frombuffer(got[f"ids{k}"], np.int64) for k in (1, 2)]
                weights = [np.frombuffer(got[f"weights{k}"], np.int64).astype(np.float64) for k in (1, 2)]
                raw = [np.frombuffer(got[f"raw{k}"], np.float64).reshape(len(ids[k - 1]), -1) for k in (1, 2)]
                trees = [pickle.loads(got[f"tree{k}"]) for k in (1, 2)]
                who, links, tied = block_links(ids, weights, raw, trees, got["b1"] == got["b2"], cosine)
                some = (links > 0) | (who != tied)
                yield pa.RecordBatch.from_arrays([pa.array(who[some]), pa.array(links[some]), pa.array(tied[some])], ["rep", "links", "tied"])

    found = pairs.join(sides[0], "b1").join(sides[1], "b2").select("b1", "b2", "ids1", "weights1", "raw1", "tree1", "ids2", "weights2", "raw2", "tree2").mapInArrow(compared, "rep long, links long, tied long")
    found = store(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = classes.where("copies > 1").select("label", "v", "rep", "copies")
    same = rows.join(reps, ["label", "v"]).select("vec_id", "rep", F.col("copies"))
    same = store(same)
    groups = connected_components(found.select("rep", "tied").where("rep <> tied").union(same.select("rep", "vec_id").where("rep <> vec_id")), "rep", "tied", "vec_id", "component_id")
    copies = same.groupBy("vec_id").agg(F.min("rep").alias("rep"), F.max("copies").alias("copies"))
    ids = vectors.select("vec_id").join(copies, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    counted = ids.join(links, "rep", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0)))
    whole = counted.join(groups, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return whole.select("vec_id", F.col("n_links").cast("long"), "component_id", F.expr("vec_id <=> component_id").alias("kept"))
