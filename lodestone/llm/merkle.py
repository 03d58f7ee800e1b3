"""A Merkle manifest of a dataset, and proofs for every row by octopus multiproofs.

Rows are leaves; each source's leaves make a tree, and the sources' roots make
one more.  Every node is the SHA-256 of up to three nodes below it, and a tree grows
levels while a level has several nodes.  A leaf partition is a block of 3^HEIGHT
consecutive leaves.  Its task works out which node coordinates its leaves' proofs lack,
less all that it derives from its own leaves; each coordinate is fetched once a block, interiors
that leaves share are hashed once, and the proofs of single leaves are
expanded where their block is.

Upper levels are built in the same blocks, so the tables shrink 3^HEIGHT-fold from one
Spark job to the next, and no task ever holds a source.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import small, store

#: Nodes that make one of the next level, and levels that a leaf partition covers.
ARITY, HEIGHT = 3, 6
BLOCK = ARITY**HEIGHT
#: The tree over the sources' roots; trees of sources are named by "=" and the source, that of the null source by "-".
TOP = "top"


def digest(text: str) -> str:
    """Lower-case hex SHA-256."""
    return sha256(text.encode()).hexdigest()


def heights(n: int) -> int:
    """How many levels stand above `n` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def lifted(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of consecutive leaves and of the `levels` levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def missing(positions: list[int], n: int, level: int = 0) -> list[tuple[int, int]]:
    """(level, index) of the nodes that the proofs of `positions` lack: the siblings, level by level, that cannot be derived from the positions' own nodes.

    `positions` are distinct nodes of `level`, which has `n` of them.  The union is minimal: a node that two proofs share is listed once, one above a position never.
    """
    known, out = sorted(set(positions)), []
    while n > 1:
        held = set(known)
        wanted = {i for p in known for i in range(p - p % ARITY, min(n, p - p % ARITY + ARITY))}
        out += [(level, i) for i in sorted(wanted - held)]
        known, n, level = sorted({p // ARITY for p in known}), -(-n // ARITY), level + 1
    return out


def folded(node: str, index: int, n: int, level: int, fetched: dict[tuple[int, int], str]) -> tuple[str, str]:
    """(root, siblings from here up, joined) of a node of a level with `n` nodes, from its siblings."""
    seen = []
    while n > 1:
        run = range(index - index % ARITY, min(n, index - index % ARITY + ARITY))
        seen += [fetched[level, i] for i in run if i != index]
        node = digest("".join(node if i == index else fetched[level, i] for i in run))
        index, n, level = index // ARITY, -(-n // ARITY), level + 1
    return node, "".join(seen)


def field(column: Column) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and its value; a dash for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, shown): the hash of every row, and that of the row as it is shown to the verifier."""
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.sha2(F.concat(*head, field(text)), 256)
    shown = F.when(tampered & F.contains(text, F.lit("\n")), F.sha2(F.concat(*head, field(F.replace(text, F.lit("\n"), F.lit("")))), 256)).otherwise(leaf)
    return docs.select("doc_id", "source", leaf.alias("leaf"), shown.alias("shown"))


def positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` (tree, ...) with pos, from 0 by `order` within each tree, and n, the rows of the tree: ranges of the order are numbered side by side.

    Rows equal in `order` are dealt apart at random once and then stand in the stored table.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__tie", F.rand(11))
    order = [F.col("tree"), *order, F.col("__tie")]
    dealt = store(dealt.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "__part").agg(F.count("*").alias("__n"))  # a row for each range and tree in it
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "__part", (F.sum("__n").over(tree.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order[1:]))
    return dealt.join(small(store(counts)), ["tree", "__part"]).withColumn("pos", F.col("__before") + inside - 1).drop("__tie", "__part", "__before")


def _levels(every: bool):
    """Per block of one tree: its nodes above those given, the topmost alone or `every` one, with the number of nodes of that level."""

    def lift(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        tree, level, n, start = group["tree"][0].as_py(), group["level"][0].as_py(), group["n"][0].as_py(), group["idx"][0].as_py()
        up, out = min(HEIGHT, heights(n)), []
        for k, nodes in enumerate(lifted(group["node"].to_pylist(), up)):
            if k == up or every and k:
                out += [(tree, level + k, start + i, n, node, k == up) for i, node in enumerate(nodes)]
            start, n = start // ARITY, n if k == up else -(-n // ARITY)
        columns = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "level", "idx", "n", "node", "top"])

    return lift


_NODES = "tree string, level int, idx long, n long, node string, top boolean"


def raised(nodes: DataFrame, every: bool) -> DataFrame:
    """Of nodes (tree, level, idx, n, node) of one level a tree, those up to HEIGHT levels above: (tree, level, idx, n, node, top)."""
    return store(nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).applyInArrow(_levels(every), _NODES))


def upper(tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) from the topmost nodes of the leaves' blocks: all nodes from there up as (tree, level, idx, node), and (tree, root)."""
    plain, level, found = ["tree", "level", "idx", "node"], tops, [tops]
    while not level.where("n > 1").isEmpty():
        made = raised(level.where("n > 1"), every=True)
        found.append(made)
        level = made.where("top")
    nodes = found[0].select(*plain)
    for part in found[1:]:
        nodes = nodes.unionByName(part.select(*plain))
    roots = found[0].where("n = 1")
    for part in found[1:]:
        roots = roots.unionByName(part.where("top AND n = 1"))
    return store(nodes), store(roots.select("tree", F.col("node").alias("root")))


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(root: str):
    def prove(key: tuple, block: pa.Table, fetched: pa.Table) -> pa.Table:
        if not len(block):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())], names=[c.split()[0] for c in _PROVED.split(", ")])
        block = block.sort_by("pos")
        n, start, place, trees = (block[c][0].as_py() for c in ("n", "pos", "place", "trees"))
        own, above = {}, {}
        for tree, level, index, node in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "node")), strict=True):
            (above if tree == TOP else own)[level, index] = node
        up = min(HEIGHT, heights(n))
        nodes = lifted(block["leaf"].to_pylist(), up)
        at_top, n_top = start // ARITY**up, n
        for _ in range(up):
            n_top = -(-n_top // ARITY)
        joined = ["".join(nodes[0][:0])] * len(nodes[0])
        for level in range(up):
            runs = [nodes[level][i : i + ARITY] for i in range(0, len(nodes[level]), ARITY)]
            beside = ["".join(run[:j] + run[j + 1 :]) for run in runs for j in range(len(run))]
            step = ARITY**level
            joined = [text + beside[i // step] for i, text in enumerate(joined)]

        ends: dict[str, tuple[str, str, str]] = {}

        def climbed(node: str) -> tuple[str, str, str]:
            """(subroot, root, siblings) above the block: once for each node that its leaves fold to."""
            if node not in ends:
                sub, first = folded(node, at_top, n_top, up, own)
                whole, second = folded(sub, place, trees, 0, above)
                ends[node] = (sub, whole, first + second)
            return ends[node]

        subroot, _, rest = climbed(nodes[up][0])
        said = []
        for i, node in enumerate(block["shown"].to_pylist()):
            for level in range(up):
                at = i // ARITY**level
                run = list(nodes[level][at - at % ARITY : at - at % ARITY + ARITY])
                run[at % ARITY] = node
                node = digest("".join(run))
            said.append(climbed(node)[1])
        m = len(said)
        return pa.table([block["doc_id"].cast(pa.int64()), block["leaf"], pa.array([subroot] * m), pa.array([root] * m), pa.array([digest(text + rest) for text in joined]), pa.array(said), pa.array([x == root for x in said])], names=[c.split()[0] for c in _PROVED.split(", ")])

    return prove


def _requests(batches):
    """The coordinates that the proofs of each block lack, in its own tree above the block and in the tree of sources."""
    for batch in batches:
        out = []
        for tree, block, n, place, trees in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            up, size = min(HEIGHT, heights(n)), n
            for _ in range(up):
                size = -(-size // ARITY)
            out += [(tree, block, tree, *c) for c in missing([block * BLOCK // ARITY**up], size, up)]
            out += [(tree, block, TOP, *c) for c in missing([place], trees)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["of", "block", "tree", "level", "idx"])


def proved(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of (doc_id, source, lang, n_chars, text).

    A leaf hashes the five fields, each its UTF-8 length, a colon and its value, or a dash for null.  Leaves ascend by doc_id
    within their source, null ids first, leaves of one id by their hash; rows that agree in everything are leaves of
    their own, and which stands first makes no difference to any hash but their own proofs.  Sources ascend bytewise, the null source first.
    proof_sha256 hashes the siblings of a leaf up to the root.  folded_root is what those siblings and the row as shown lead to:
    where the crc32 of the decimal doc_id is even, the row is shown without the line feeds of its text (not where the id is null).

    Empty texts are values of length 0; texts of any length are one leaf; other columns are ignored; an empty table gives an
    empty one.
    """
    rows = leaves(docs).withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    rows = store(positioned(rows.drop("source"), [F.col("doc_id").asc_nulls_first(), F.col("leaf")]))
    tops = raised(rows.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", F.col("leaf").alias("node")), every=False)
    nodes, subroots = upper(tops)
    # "-" sorts before "=", so trees stand in the order of their sources.
    bases = store(positioned(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node")), [F.col("of")]))
    base = bases.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", "node")
    top_nodes, top_root = upper(base.withColumn("top", F.lit(True)))
    ended = top_root.first()
    if ended is None:
        return docs.sparkSession.createDataFrame([], _PROVED)
    nodes = store(nodes.unionByName(top_nodes))
    places = bases.select(F.col("of").alias("tree"), F.col("pos").alias("place"), F.col("n").alias("trees"))
    rows = rows.withColumn("block", F.expr(f"pos div {BLOCK}")).join(small(places), "tree")
    blocks = store(rows.where(f"pos % {BLOCK} = 0").select("tree", "block", "n", "place", "trees"))
    asked = store(blocks.mapInArrow(_requests, "of string, block long, tree string, level int, idx long"))
    fetched = asked.join(small(nodes), ["tree", "level", "idx"]).select(F.col("of"), "block", "tree", "level", "idx", "node")
    kept = rows.select("tree", "block", "pos", "n", "place", "trees", "doc_id", "leaf", "shown")
    return kept.groupBy("tree", "block").cogroup(fetched.groupBy("of", "block")).applyInArrow(_proofs(ended["root"]), _PROVED)
