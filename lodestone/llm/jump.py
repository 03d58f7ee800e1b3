"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone; no
table of the ring exists.  With one more shard, a key either stays or moves
into the new shard, and about 1 / (n + 1) of the keys move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.texthash import mix

#: Parts of a shard that are numbered side by side; their sizes are summed first, so no task orders a shard.
CELLS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def _jump(shards: int):
    """The shard of a 64-bit key.  Marked as not deterministic, though it is: else the join's null check on the shard
    is pushed below it, ids are hashed twice in a task, and the task holds a second Python worker that stays in memory.
    """

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(ids.to_numpy(dtype="int64").astype(np.uint64)), shards)).astype("int32")

    return of.asNondeterministic()


def sharded(docs: DataFrame, shards: int = 16, cells: int = CELLS) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 length of the text (null: 0) plus 1 and text_crc32 the
    unsigned checksum of those bytes (null: of none).  shard and grown_shard
    are the jump hashes of doc_id among `shards` and one more.  slot numbers
    each shard's rows from 0 without gaps, in the order of a hash of the row,
    then of doc_id, checksum and size; rows equal in all of these take
    consecutive slots in any order.

    A null doc_id counts as -1.  Repeated ids share a shard.  A text of any length is one row, and an empty table gives an
    empty one.  Columns of `docs`
    with the names of new columns are replaced; all others are carried along.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")
    rows = docs.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)})
    rows = rows.withColumns({"law": F.lit("key"), "shard": _jump(shards)(key), "grown_shard": _jump(shards + 1)(key), "__cell": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int")})
    counts = rows.groupBy("shard", "__cell").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "__cell", before.alias("__before"))  # shards * cells rows at most
    order = Window.partitionBy("shard", "__cell").orderBy("doc_id", "text_crc32", "size")
    slot = (F.col("__before") + F.row_number().over(order) - 1).cast("long")
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return rows.join(F.broadcast(offsets), ["shard", "__cell"]).withColumn("slot", slot).select(*[F.col(f"`{c}`") for c in names], "size", "text_crc32", "law", "shard", "slot", "grown_shard")
