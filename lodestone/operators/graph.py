"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut


def _fingerprint(edges: DataFrame) -> tuple[DataFrame, tuple]:
    done = cut(edges)
    row = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first()
    return done, tuple(row)


def connected_components(edges: DataFrame, u: str, v: str, id_name: str = "id", component: str = "component_id") -> DataFrame:
    """(id, smallest id reachable) for every node of `edges`, itself included.

    Alternates the large-star and small-star steps: each node ties its larger
    neighbours, then its smaller ones, to the smallest node it sees.  A step is
    a minimum per node (aggregated before the shuffle, so a hot node costs no
    more than others) joined back to its edges, where skewed keys can be split.
    Edges with a null end are ignored; self-loops and repeated edges change nothing
    except that a node with only a self-loop appears with itself.
    """
    # v is the smaller end throughout.
    given = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e, mark = _fingerprint(given.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = e.where("u = v").select(F.col("u").alias("u"))
    e = e.where("u <> v")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        down = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, seen = _fingerprint(low.select("u", F.col("m").alias("v")).unionByName(down).distinct())
        if seen == mark:
            break
        e, mark = after, seen
    nodes = e.select(F.col("u").alias(id_name), F.col("v").alias(component))
    roots = e.select(F.col("v").alias(id_name)).distinct().withColumn(component, F.col(id_name))
    alone = loops.select(F.col("u").alias(id_name)).join(nodes.unionByName(roots), id_name, "left_anti").withColumn(component, F.col(id_name))
    return nodes.unionByName(roots).unionByName(alone)
