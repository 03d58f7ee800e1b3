"""Retrieval and ranking: exact dense search, BM25, reranking, negatives, passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors
from lodestone.runtime import small, spread, store

#: Queries that meet a block in one task.
QUERY_ROWS = 4096
#: Vectors of a block, and vectors at most that blocks are gathered around.
BLOCK_ROWS, PIVOTS = 512, 256
#: Documents of a block of postings.
BLOCK_DOCS = 4096
#: Up to so many blocks, all are searched at once: bounds would save less than a second round costs.
ONE_ROUND = 16


def ranked(scores: DataFrame, k: int | None = None, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """`scores` with rank, from 1, by falling score and then rising id; the best `k` where given."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(doc))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties to the smaller id: all that reach the k-th score are sorted, no others."""
    at = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((docs[at], -scores[at]))[:k]]


def _hits(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """(query_id, doc_id, score) from a query's documents and scores each."""
    sizes = [len(docs) for _, docs, _ in found]
    queries = np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)
    docs, scores = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
    return pa.table([pa.array(queries), pa.array(docs.astype(np.int64)), pa.array(scores.astype(np.float64))], names=["query_id", "doc_id", "score"])


_HITS = "query_id long, doc_id long, score double"


def _chunks(queries: DataFrame) -> tuple[Column, int]:
    """(the part of a query_id, how many parts): parts of about QUERY_ROWS queries meet a block in tasks of their own."""
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    return F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), parts


def best_first(bounds: DataFrame, scored: Callable[[DataFrame], DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, pairs): the best hits of blocks of documents, and the (query_id, block) that were searched, from upper bounds (query_id, block, bound) of what a block can score.

    A query searches its most promising block first; of the others it searches those whose bound reaches the k-th score found there.
    `scored` gives (query_id, doc_id, score), the best `k` of every pair; no plan grows with the queries.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    turns = store(bounds.withColumn("turn", F.row_number().over(order)))
    first = store(scored(turns.where("turn = 1").select("query_id", "block")))
    reached = ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = turns.where("turn > 1").join(reached, "query_id", "left").where("reached IS NULL OR bound >= reached - 1e-6 * (1 + abs(reached))").select("query_id", "block")
    rest = store(rest)
    return store(first.unionByName(scored(rest))), turns.where("turn = 1").select("query_id", "block").unionByName(rest)


def vector_blocks(corpus: DataFrame, rows: int = BLOCK_ROWS, pivots: int = PIVOTS, seed: int = 5) -> DataFrame:
    """(block, dim, centre, radius, ids, vectors) of (doc_id, vector), written once: an exact index for any queries.

    Every vector goes to the nearest of at most `pivots` vectors drawn from the corpus, and the vectors of a pivot are dealt to blocks of about
    `rows` rows.  A block has the mean of its vectors, their largest distance from it, and the vectors as one matrix of doubles.
    Vectors of several dimensions stand in blocks of their own; null and empty ones, and those with null or non-finite components, are left out.
    """
    finite = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = corpus.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where("doc_id IS NOT NULL AND size(vector) > 0").where(finite(F.col("vector"))).withColumn("dim", F.size("vector"))
    n, points = corpus.count(), {}
    if n > ONE_ROUND * rows:
        some = kept.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(min(pivots, -(-n // rows))).toArrow()  # `pivots` rows at most
        points = {d: np.array([v for v in some.column(1).to_pylist() if len(v) == d]) for d in set(some.column(2).to_pylist())}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, place = batch.column(2).to_numpy(), np.zeros(len(batch), np.int32)
            for d in np.unique(dims):
                if d in points:
                    mine = np.flatnonzero(dims == d)
                    matrix = batch.column(1).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), d)
                    place[mine] = ((points[d] ** 2).sum(1) - 2 * matrix @ points[d].T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["doc_id", "vector", "dim", "pivot"])

    if points:
        placed = store(kept.mapInArrow(near, "doc_id long, vector array<double>, dim int, pivot int"))
        parts = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # `pivots` rows a dimension at most
        dealt = placed.join(F.broadcast(parts), ["dim", "pivot"])
    else:
        dealt = kept.withColumns({"pivot": F.lit(0), "parts": F.lit(max(1, -(-n // rows)))})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        dim, pivot, part = (x.as_py() for x in key)
        group = group.sort_by("doc_id")
        matrix = group["vector"].combine_chunks().flatten().to_numpy().reshape(len(group), dim)
        centre = matrix.mean(0)
        radius = float(np.sqrt(((matrix - centre) ** 2).sum(1).max()))
        kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary()]
        row = [f"{dim}-{pivot}-{part}", dim, centre.tolist(), radius, group["doc_id"].to_pylist(), matrix.tobytes()]
        return pa.table([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["block", "dim", "centre", "radius", "ids", "vectors"])

    return store(dealt.select("dim", "pivot", "part", "doc_id", "vector").groupBy("dim", "pivot", "part").applyInArrow(packed, "block string, dim int, centre array<double>, radius double, ids array<long>, vectors binary"))


def indexed_topk(queries: DataFrame, blocks: DataFrame, k: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(hits, pairs) of (query_id, vector) over `vector_blocks`: (query_id, doc_id, score) with the best `k` by inner product among them, and the (query_id, block) that were searched.

    A vector of a ball of radius r around c has at most q.c + |q| r with q, so blocks below the k-th product found need no search.
    Queries meet the blocks of their dimension alone.  Scores are rounded to `digits`, so that ties go by id whatever the order of summation.
    """
    asked = store(queries.where("query_id IS NOT NULL AND size(vector) > 0").select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim")))
    part, parts = _chunks(asked)

    def search(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(blocks):
            ids = np.array(blocks["ids"][0].as_py(), np.int64)
            matrix = np.frombuffer(blocks["vectors"][0].as_py()).reshape(len(ids), -1)
            asked = queries["vector"].combine_chunks().flatten().to_numpy().reshape(len(queries), -1)
            for q, scores in zip(queries["query_id"].to_pylist(), np.round(asked @ matrix.T, digits), strict=True):
                best = _best(scores, ids, k)
                found.append((q, ids[best], scores[best]))
        return _hits(found)

    def scored(pairs: DataFrame) -> DataFrame:
        held = pairs.join(asked, "query_id").select("block", part.alias("part"), "query_id", "vector")
        sent = blocks.select("block", "ids", "vectors").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        needed = sent if few else sent.join(held.select("block", "part").distinct(), ["block", "part"], "left_semi")
        return held.groupBy("block", "part").cogroup(needed.groupBy("block", "part")).applyInArrow(search, _HITS)

    few = blocks.count() <= ONE_ROUND
    if few:
        pairs = asked.join(F.broadcast(blocks.select(F.col("block").alias("near"), "dim")), "dim").select("query_id", F.col("near").alias("block"))
        return scored(pairs), pairs
    norm = F.sqrt(vectors.dot(F.col("vector"), F.col("vector")))
    bounds = asked.join(small(blocks.select("block", "dim", "centre", "radius")), "dim").select("query_id", "block", (vectors.dot(F.col("vector"), F.col("centre")) + norm * F.col("radius")).alias("bound"))
    return best_first(bounds, scored, k)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): the `k` best documents of each query by inner product, exactly, over blocks of the corpus.

    `queries` is (query_id, vector) and `corpus` (doc_id, vector).  Null vectors are left out, as are documents of another dimension than the query's.
    """
    return ranked(indexed_topk(queries, vector_blocks(corpus), k, digits)[0], k)


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length) of (doc_id, text), written once: how often a document holds a term, and its number of tokens.

    A document's tokens are sorted and counted within its row: nothing is shuffled, and a task's memory follows its longest text.
    """
    docs = spread(corpus).select("doc_id", F.sort_array(T.tokens(F.col("text"))).alias("t")).where("size(t) > 0")
    new = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    terms = F.transform("new", lambda i, j: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("new", j + 1), F.size("t")) - i).cast("long").alias("tf")))
    return store(docs.withColumn("new", new).select("doc_id", F.size("t").alias("length"), F.explode(terms).alias("x")).select("doc_id", "x.term", "length", "x.tf"))


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 9, terms_of: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by Okapi BM25 over (query_id, text) and (doc_id, text).

    A term in more than half of the documents weighs `epsilon` times the mean
    inverse document frequency of the vocabulary.  A term counts as often as the
    query repeats it.  Documents without a query's terms score 0 and fill up its ranks by id.

    `terms_of` are the corpus' `postings` where they stand already.  Only those of the queries' terms are gathered: documents are dealt to blocks of
    about BLOCK_DOCS, and a block holds for each term the documents, their weights and the largest of these.  Those maxima bound what a
    block can score, so a query searches its best block, then the blocks that can still reach its k-th score.
    """
    terms_of = postings(corpus) if terms_of is None else terms_of
    n = corpus.count()
    asked = store(queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    idf = store(terms_of.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).select("term", "all", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    mean, words = idf.agg(F.avg("idf"), F.coalesce(F.sum("all"), F.lit(0))).first()
    terms = asked.select("term").distinct().join(idf, "term").select("term", F.when(F.col("idf") < 0, epsilon * (mean or 0.0)).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(words / max(n, 1))))
    cells = max(1, -(-n // BLOCK_DOCS))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("string")
    held = terms_of.join(small(store(terms)), "term").select(block.alias("block"), "term", "doc_id", weight.alias("weight"))
    few = cells <= ONE_ROUND
    held = store(held.groupBy("block", "term").agg(F.collect_list("doc_id").alias("docs"), F.collect_list("weight").alias("weights"), F.max("weight").alias("most")))
    bounds = held.select("block", "term", "most").join(asked, "term").groupBy("query_id", "block").agg(F.sum(F.col("times") * F.greatest("most", F.lit(0.0))).alias("bound"))
    part, parts = _chunks(queries)

    def search(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not (len(queries) and len(blocks)):
            return _hits([])
        lists, weights = blocks["docs"].combine_chunks(), blocks["weights"].combine_chunks()
        ids, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        spans = {term: slice(end - size, end) for term, end, size in zip(blocks["term"].to_pylist(), ends.tolist(), lists.value_lengths().to_pylist(), strict=True)}
        weight = weights.flatten().to_numpy()
        asked = queries.sort_by("query_id")
        names, terms, times = (asked[c].to_pylist() for c in ("query_id", "term", "times"))
        found, at = [], 0
        while at < len(names):
            stop = at
            scores, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
            while stop < len(names) and names[stop] == names[at]:
                span = spans.get(terms[stop])
                if span is not None:  # a document holds a term once
                    scores[place[span]] += weight[span] * times[stop]
                    seen[place[span]] = True
                stop += 1
            docs = np.flatnonzero(seen)
            rounded = np.round(scores[docs], digits)
            best = _best(rounded, ids[docs], k)
            found.append((names[at], ids[docs[best]], rounded[best]))
            at = stop
        return _hits(found)

    def scored(pairs: DataFrame) -> DataFrame:
        mine = pairs.join(asked, "query_id").select("block", part.alias("part"), "query_id", "term", "times")
        sent = held.select("block", "term", "docs", "weights").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        needed = sent if few else sent.join(mine.select("block", "part", "term").distinct(), ["block", "part", "term"], "left_semi")
        return mine.groupBy("block", "part").cogroup(needed.groupBy("block", "part")).applyInArrow(search, _HITS)

    hits = scored(asked.select("query_id").distinct().crossJoin(F.broadcast(held.select(F.col("block").alias("near")).distinct())).select("query_id", F.col("near").alias("block"))) if few else best_first(bounds, scored, k)[0]  # ONE_ROUND blocks at most
    first = corpus.select("doc_id").orderBy("doc_id").limit(k)
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows a query
    return ranked(hits.unionByName(zero).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def containment(items: DataFrame, corpus: DataFrame, terms_of: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id): the documents whose text holds an item's, of (query_id, item) and (doc_id, text).

    A document that holds an item has its inner tokens whole, so only the documents with the rarest of them are
    searched.  Items of fewer than three tokens have no inner ones and are sought in every document.
    """
    items = store(items.where("item IS NOT NULL").withColumn("t", T.tokens(F.col("item"))))
    terms_of = postings(corpus) if terms_of is None else terms_of
    inner = items.where("size(t) > 2").select("query_id", F.explode(F.array_distinct(F.slice("t", F.lit(2), F.size("t") - 2))).alias("term"))
    counts = terms_of.join(small(store(inner.select("term").distinct())), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = inner.join(counts, "term").groupBy("query_id").agg(F.min(F.struct("df", "term"))["term"].alias("term"), F.count("*").alias("known"))
    whole = inner.groupBy("query_id").agg(F.count("*").alias("all"))  # an item with a token that no document has is held by none
    rarest = rarest.join(whole, "query_id").where("known = all").select("query_id", "term")
    texts = corpus.select("doc_id", "text")
    near = terms_of.select("doc_id", "term").join(small(store(rarest)), "term").select("query_id", "doc_id").join(items.select("query_id", "item"), "query_id").join(texts, "doc_id")
    held = near.where(F.contains("text", F.col("item"))).select("query_id", "doc_id")
    short = items.where("size(t) <= 2").select("query_id", "item")
    if short.isEmpty():
        return held
    return held.unionByName(texts.join(small(short), F.contains("text", F.col("item"))).select("query_id", "doc_id"))


def reranked_prefix(ranking: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """`ranking` (query_id, doc_id, rank) with new_rank: the first `k` by the second score, ties by old rank, the tail unchanged.

    `scores` is (query_id, doc_id, second); a document without a finite second score raises.
    """
    both = ranking.join(scores, ["query_id", "doc_id"], "left")
    second = F.when(F.col("rank") > k, F.lit(None)).when(F.col("second").isNull() | F.isnan("second") | (F.abs("second") == float("inf")), F.raise_error(F.lit("a second score is missing or not finite")).cast("double")).otherwise(F.col("second"))
    both = both.withColumn("__s", second).withColumn("__head", F.col("rank") <= k)
    order = Window.partitionBy("query_id", "__head").orderBy(F.col("__s").desc_nulls_last(), "rank")
    return both.withColumn("new_rank", F.when(F.col("__head"), F.row_number().over(order)).otherwise(F.col("rank"))).drop("__s", "__head")


def hard_negatives(ranking: DataFrame, positives: DataFrame, prints: DataFrame, n: int, strict: bool = True) -> DataFrame:
    """(query_id, doc_id, rank, negative): the first `n` ranked documents that are no positives and no copies of one or of an earlier negative.

    `positives` is (query_id, doc_id) and `prints` (doc_id, fingerprint).  A query with fewer than `n` raises;
    without `strict` it has those that there are.
    """
    known = positives.join(prints, "doc_id").select("query_id", "fingerprint").distinct()
    left = ranking.join(positives, ["query_id", "doc_id"], "left_anti").join(prints, "doc_id").join(known, ["query_id", "fingerprint"], "left_anti")
    first = Window.partitionBy("query_id", "fingerprint").orderBy("rank")
    left = left.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    chosen = left.withColumn("negative", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("negative") <= n).select("query_id", "doc_id", "rank", "negative")
    if not strict:
        return chosen
    asked = ranking.select("query_id").distinct()
    each = asked.join(chosen, "query_id", "left").withColumn("__found", F.count("doc_id").over(Window.partitionBy("query_id")))
    enough = F.when(F.col("__found") < n, F.raise_error(F.concat(F.lit("too few negatives for query "), F.col("query_id").cast("string")))).otherwise(F.lit(True))
    return each.where(enough.cast("boolean")).drop("__found")


def sentence_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, text): a row per non-empty line, numbered from 0 as in the document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence_index", "text"))
    return lines.where(F.trim("text") != "")


def rank_buckets(rank: Column) -> Column:
    """1, 2-10, 11-100 or >100; an absent rank is beyond 100."""
    return F.when(rank == 1, "1").when(rank <= 10, "2-10").when(rank <= 100, "11-100").otherwise(">100")
