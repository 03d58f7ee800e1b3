"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A block is one pass over one document; the last block that a source gives is
cut to its first words, so that the source meets its target to the word.  Each
source's blocks stand in an order permuted by hash; its quota is a number of
blocks from the front.  The quotas of all sources are split over a binary tree
of output shards: a node sends a multivariate-hypergeometric draw of its blocks
to its left half and the rest to the right, so shard sizes are exact and
each source's blocks are used once.  A shard takes consecutive, disjoint runs of each
permuted source and shuffles them by another hash.

Everything is DataFrame expressions.  A source is never ordered in one task:
its documents fall into cells of the permuted order, the sums of the cells give every
cell its place, and only cells are ordered.  Tables with a row a source are kept as
arrays in the nodes of the tree; sources are assumed to number in the thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import small, store

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: All sources together give this share of all words, and none over this multiple of its own.
SHARE, MOST = 1.5, 2.0
#: Cells of a source's permuted order.
CELLS = 4096
_SPACES = " \t\n\x0b\f\r"
_UNIT = float(1 << 53)


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than space and \\x09-\\x0D; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def word_count(text: Column) -> Column:
    """The number of words of a text, long; 0 for null."""
    return F.size(words(text)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) with number, weight and target: SHARE of all words shared by weight, none above MOST times its source.

    Sources in the order of MOST * size / weight reach their limit one after the
    other as the level rises; the level is that of the first source which it does not pass.
    """
    ordered = totals.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    ordered = ordered.withColumns({"weight": weight, "most": MOST * F.col("source_size")}).withColumn("full_at", F.col("most") / F.col("weight"))
    rising = Window.orderBy("full_at", "number")
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (SHARE * F.sum("source_size").over(everything) - capped) / rest
    leveled = ordered.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "number", "level"))).over(everything)["level"]
    return leveled.withColumn("chosen", level).select("source", "source_size", "number", "weight", F.coalesce(F.least("most", F.col("weight") * F.col("chosen")), "most").alias("target"))


#: A hypergeometric variate by inversion: `a.n` draws from `a.total`, `q.k` of them marked; `u` uniform.  Terms more than 8 deviations from the mean, of probability under 1e-14, are left out.
_VARIATE = """
transform(array(named_struct(
  'n', a.n, 'total', a.total, 'k', q.k, 'u', pmod(xxhash64({seed}, node, q.number), 9007199254740992L) / {unit}D,
  'mean', if(a.total = 0, 0D, double(a.n) * q.k / a.total),
  'spread', 8 + 8 * sqrt(if(a.total <= 1, 0D, double(a.n) * q.k / a.total * (1 - double(q.k) / a.total) * (a.total - a.n) / (a.total - 1))))),
 h -> transform(array(named_struct(
    'low', greatest(0L, h.n - (h.total - h.k), bigint(floor(h.mean - h.spread))), 'high', least(h.k, h.n, bigint(ceil(h.mean + h.spread))))),
   r -> aggregate(sequence(r.low, r.high),
     named_struct('at', r.low, 'w', 1D, 'sum', 0D, 'all', aggregate(sequence(r.low, r.high), named_struct('w', 1D, 'sum', 0D),
         (s, x) -> named_struct('w', s.w * ((h.k - x) * double(h.n - x)) / ((x + 1D) * greatest(1D, h.total - h.k - h.n + x + 1D)), 'sum', s.sum + s.w), s -> s.sum)),
     (s, x) -> named_struct('at', if(s.sum < h.u * s.all, x, s.at), 'w', s.w * ((h.k - x) * double(h.n - x)) / ((x + 1D) * greatest(1D, h.total - h.k - h.n + x + 1D)), 'sum', s.sum + s.w, 'all', s.all),
     s -> s.at))[0])[0]
"""


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(number, bounds): for each source the last block number + 1 of shards 0, 1, ... in its permuted order, from (number, blocks)."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("number", F.col("blocks").alias("k")))).alias("quotas"))
    nodes = nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("leaves"), "quotas").withColumn("node", F.lit(1).cast("long"))
    variate = _VARIATE.format(seed=seed, unit=int(_UNIT))
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (s, q) -> s + q.k)")).withColumn("left_leaves", F.expr("leaves div 2"))
        nodes = nodes.withColumn("n", F.expr("total * left_leaves div leaves"))
        drawn = f"""aggregate(quotas, named_struct('total', total, 'n', n, 'out', cast(array() AS array<bigint>)),
            (a, q) -> transform(array({variate}), d -> named_struct('total', a.total - q.k, 'n', a.n - d, 'out', array_append(a.out, d)))[0], a -> a.out)"""
        nodes = nodes.withColumn("drawn", F.expr(drawn))
        left = "zip_with(quotas, drawn, (q, d) -> named_struct('number', q.number, 'k', d))"
        right = "zip_with(quotas, drawn, (q, d) -> named_struct('number', q.number, 'k', q.k - d))"
        halves = f"""CASE WHEN leaves = 1 THEN array(named_struct('first', first, 'leaves', leaves, 'quotas', quotas, 'node', node))
            ELSE array(named_struct('first', first, 'leaves', int(left_leaves), 'quotas', {left}, 'node', node * 2),
                       named_struct('first', int(first + left_leaves), 'leaves', int(leaves - left_leaves), 'quotas', {right}, 'node', node * 2 + 1)) END"""
        nodes = nodes.select(F.explode(F.expr(halves)).alias("x")).select("x.*")
    per_shard = nodes.select("first", F.explode("quotas").alias("q")).select("first", "q.number", "q.k")
    listed = per_shard.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("first", "k"))).alias("ks"))
    running = "aggregate(ks, cast(array() AS array<bigint>), (s, x) -> array_append(s, x.k + coalesce(try_element_at(s, -1), 0L)))"
    return listed.select("number", F.expr(running).alias("bounds"))


MADE = ("size", "source_size", "target", "taken", "blocks")


def _drawn(docs: DataFrame, carry: list[str], shards: int, seed: int, cells: int) -> DataFrame:
    """(row, size, source_size, target, taken, blocks): the columns `carry` of each row as a struct, so none of them meets a working column."""
    given = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(given.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "crc", F.lit(seed))).drop("crc")
    rows = store(rows.withColumn("cell", F.shiftrightunsigned("order", 64 - (cells - 1).bit_length()).cast("int")))
    sums = store(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.count_if(F.col("size") > 0).alias("cell_rows")))
    plan = targets(sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    plan = plan.withColumn("want", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    plan = store(plan.withColumn("full", full).withColumn("rest", F.col("want") - F.col("full") * F.col("source_size")))
    so_far = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    of_source = F.col("a.source").eqNullSafe(F.col("b.source"))
    placed = sums.alias("a").join(small(plan).alias("b"), of_source).select("a.source", "cell", "cell_size", "cell_rows", "number", "source_size", "target", "full", "rest")
    placed = placed.withColumns({"words_before": F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)), "rows_before": F.coalesce(F.sum("cell_rows").over(so_far), F.lit(0)), "rows": F.sum("cell_rows").over(Window.partitionBy("number"))})
    placed = store(placed.drop("cell_size", "cell_rows"))
    rows = rows.alias("a").join(small(placed).alias("b"), of_source & (F.col("a.cell") == F.col("b.cell")))
    rows = rows.select("a.*", *[F.col(f"b.{c}") for c in ("number", "source_size", "target", "full", "rest", "words_before", "rows_before", "rows")])
    inside = Window.partitionBy("number", "cell").orderBy("order", "doc_id", "size")
    rows = rows.withColumns({"before": F.col("words_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "at": F.col("rows_before") + F.coalesce(F.count_if(F.col("size") > 0).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before"))))

    # Blocks of a source: every row once per full pass, then the rows before the one that is cut, and that one.
    of_cell = store(rows.groupBy("number").agg(F.max("full").alias("full"), F.max("rows").alias("n"), F.max(F.when(F.col("part") > 0, F.col("at") + 1)).alias("more")))
    quotas = of_cell.select("number", (F.col("full") * F.col("n") + F.coalesce("more", F.lit(0))).cast("long").alias("blocks"))
    bounds = shard_quotas(quotas, shards, seed)
    rows = rows.join(small(store(bounds)), "number")
    passes = f"""
      transform(filter(sequence(0L, 2L), p -> size > 0 AND (p < full OR p = full AND part > 0)), p -> named_struct(
        'pass', int(p), 'words', if(p < full, size, part),
        'shard', size(filter(bounds, b -> b <= p * rows + at)), 'order', xxhash64(order, p, {seed + 1})))"""
    taken = (F.col("full") * F.col("size") + F.col("part")).cast("long")
    return rows.select("row", "size", "source_size", "target", taken.alias("taken"), F.expr(passes).alias("blocks"))


def mixed(docs: DataFrame, shards: int = 16, seed: int = 4, cells: int = CELLS, carry: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `carry`) with size, source_size, target, taken, and blocks: array of (pass, words, shard, order).

    taken is the sum of the words of the row's blocks: its size for every full
    pass, up to two, and less for the one cut block of its source.  The blocks of
    a source add up to its target, rounded.  Blocks of a shard sorted by their order
    are the shard's local shuffle.

    Null texts have size 0 and give no words; a null source is a source of its own, the
    last.  The order depends on doc_id, the text's checksum and the seed, so reruns agree;
    rows equal in all of these may trade places.  With no words at all every target is 0.
    Columns of `docs` with the names of new columns are replaced, all others of any name come back as they were.
    A text of any length is one row; an empty table gives an empty one.

    Words are counted once: the carried columns are written with each row's size and place, and all later steps read that table.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    return _drawn(docs, kept, shards, seed, cells).select(*[F.col("row")[c].alias(c) for c in kept], *MADE)


def drawn_documents(docs: DataFrame, shards: int = 16, seed: int = 4) -> DataFrame:
    """The mixture itself, with the columns of `docs`: a row per block, the cut block with its first words joined by spaces.

    Columns other than text and n_chars come back as they were, whatever their names; a column n_chars holds the code points
    of a cut text, and stays as it was elsewhere.  Null and empty texts give no words and so no rows, null
    sources are one source, rows that repeat are drawn each for itself, and an empty table gives an empty one.
    """
    rows = _drawn(docs, docs.columns, shards, seed, CELLS).select("row", "size", F.explode("blocks").alias("block"))
    cut = F.array_join(F.slice(words(F.col("row")["text"]), F.lit(1), F.col("block.words").cast("int")), " ")
    rows = rows.withColumn("is_cut", F.col("block.words") < F.col("size")).withColumn("drawn", F.when(F.col("is_cut"), cut).otherwise(F.col("row")["text"]))
    instead = {"text": F.col("drawn"), "n_chars": F.when(F.col("is_cut"), F.length("drawn").cast("long")).otherwise(F.col("row")["n_chars"])}
    return rows.select(*[(instead[c] if c in instead else F.col("row")[c]).alias(c) for c in docs.columns])
