"""MinHash near-dedup: one-permutation hashing with optimal densification.

One hash per word shingle fills `BINS` bins; an empty bin borrows from a full
one picked by hashing (bin, attempt).  Runs of bins make banded buckets, and
each bucket yields a star of candidate edges to its smallest member, so the
candidates grow with bucket members and never with their pairs.  Every link is
confirmed on the full shingle sets.  Buckets whose members are still in
different components after the star are compared completely, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import texthash
from lodestone.operators.graph import connected_components
from lodestone.runtime import bounded_batches, small, store

#: 42 bands of 6 bins: a pair at similarity 0.8 shares no bucket with probability 3e-6.
BINS, BANDS, ROWS = 256, 42, 6
#: Documents and shingles in a block of a bucket that is compared completely, about.
BLOCK, BLOCK_SHINGLES = 400, 400_000
_PROBE = np.random.RandomState(77).randint(0, BINS, (BINS, 4096))


def densified(shingle_set: np.ndarray) -> np.ndarray:
    """The signature of a sorted, non-empty set of 64-bit hashes: each bin's minimum, empty bins filled by probing."""
    bins = (shingle_set >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]] = shingle_set[first]
    full[bins[first]] = True
    source, empty, attempt = np.arange(BINS), np.flatnonzero(~full), 0
    if int(full.sum()) == 1:
        source[:] = bins[0]
        empty = empty[:0]
    while len(empty):
        probe = np.take(_PROBE, np.arange(attempt, attempt + 64) % _PROBE.shape[1], axis=1)[empty]
        met = full[probe]
        hit = met.any(1)
        source[empty[hit]] = probe[hit, met.argmax(1)[hit]]
        empty, attempt = empty[~hit], attempt + 64
        if attempt >= _PROBE.shape[1]:
            source[empty] = np.flatnonzero(full)[empty % full.sum()]
            break
    return value[source]


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key per band, for rows of signatures."""
    parts = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = texthash.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, data, offsets in texthash.text_slices(column):
        starts, ends, upto = texthash.word_spans(data, offsets)
        runs, total = texthash.shingles(texthash.span_hashes(data, starts, ends), upto, width)
        for i in range(last - first):
            yield np.unique(runs[total[i] : total[i + 1]])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): set size, two 64-bit fingerprints of the set, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, rows = [], [], []
            for s in _sets(batch.column(1), width):
                sizes.append(len(s))
                if len(s):
                    prints.append((int(np.sum(texthash.mix(s)).view(np.int64)), int(np.bitwise_xor.reduce(texthash.mix(s + np.uint64(17))).view(np.int64))))
                    rows.append(densified(s))
                else:
                    prints.append((0, 0))
            keys = band_keys(np.array(rows)).view(np.int64).ravel() if rows else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(np.array(sizes, np.int64) > 0, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full set as sorted 64-bit hashes in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in integers, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent) for i in range(len(batch))]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    on_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    on_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return edges.join(on_a, "a").join(on_b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over runs of the vocabulary."""
    vocabulary = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float32)

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(vocabulary, np.concatenate(sets))

    (ri, ci), (rj, cj) = rows(left), rows(right)
    run = 4096
    for at in range(0, len(vocabulary), run):
        parts = []
        for r, c, n in ((ri, ci, len(left)), (rj, cj, len(right))):
            inside = (c >= at) & (c < at + run)
            m = np.zeros((n, run), np.float32)
            m[r[inside], c[inside] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _block_links(percent: int):
    """Forest edges between the components of one pair of blocks of a bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.drop_duplicates("id")
        sides = [pdf[pdf["block"] == i], pdf[pdf["block"] == j]]
        if sides[0].empty or sides[1].empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in sides]
        common = common_counts(*sets)
        sizes = [np.array([len(s) for s in side]) for side in sets]
        linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        comps = [side["comp"].to_numpy() for side in sides]
        linked &= comps[0][:, None] != comps[1][None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for p, q in zip(*np.nonzero(linked), strict=True):
            x, y = root(int(comps[0][p])), root(int(comps[1][q]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(sides[0]["id"].iloc[p]), int(sides[1]["id"].iloc[q])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`, linked by the Jaccard similarity of word shingles.

    Two documents link where 100 * intersection >= percent * union of their
    sets of `width`-word shingles (A-Z lower-cased; a shorter text is one
    shingle; sets are held as 64-bit hashes).  component_id is the smallest
    doc_id reachable by links; kept marks the row whose doc_id that is.

    Null or wordless texts have size 0, link with nothing and are kept.  A row
    with a null doc_id is kept, with a null component.  Rows that repeat a
    doc_id share one node of the graph and so one component, and each gets its
    row.  A text of any length is compared whole.  Other columns of `docs` are ignored.  An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession, "4m")
    signed = store(signatures(docs, width))
    with_words = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same_set = ["n_shingles", "f1", "f2"]
    classes = with_words.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = store(classes)
    copies = classes.where("copies > 1").select(*same_set, "rep")
    copy_edges = with_words.select("doc_id", *same_set).join(copies, same_set).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    member = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = store(member.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).where("n > 1"))
    larger = buckets.where("n > 2")
    crowd = store(member.join(larger.select("bucket", "a", "n"), "bucket").select("bucket", "n", "a", F.col("rep").alias("b")))
    edges = store(buckets.select("a", "b").union(crowd.select("a", "b")).where("a <> b").distinct())
    ids = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(docs.select("doc_id", "text").join(small(store(ids)), "doc_id", "left_semi"), width)
    sets = store(sets.dropDuplicates(["id", "shingles"]))
    links = store(_confirmed(edges, sets, percent).union(copy_edges).distinct())

    # Buckets of three or more with members in different components: compared completely, equal buckets once.
    parts = connected_components(links, "a", "b", "b", "comp")
    placed = crowd.select("bucket", "n", "b").join(parts, "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    open_buckets = placed.groupBy("bucket", "n").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum(F.xxhash64("b").bitwiseAND((1 << 40) - 1)).alias("same")).where("low <> high")
    open_buckets = open_buckets.groupBy("n", "same", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket")
    opened = store(placed.join(open_buckets, "bucket"))
    weight = opened.join(sets.select(F.col("id").alias("b"), (F.octet_length("shingles") / 8).alias("w")), "b").groupBy("bucket").agg(F.sum("w").alias("w"))
    parts_of = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("long")
    blocks = opened.join(weight, "bucket").withColumn("of", parts_of)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("b"), "of")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    blocks = blocks.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("b").alias("id"), "comp")
    blocks = blocks.join(sets, "id")
    more = blocks.groupBy("bucket", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    final = connected_components(parts.select(F.col("b").alias("a"), F.col("comp").alias("b")).union(more), "a", "b", "doc_id", "component_id")
    return (
        signed.select("doc_id", "n_shingles")
        .join(final, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
    )
