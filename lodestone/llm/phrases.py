"""Phrase collocations mined with weighted acyclic automata.

A task reads texts, sorts the sequences of words that it finds and builds count
transducers from them (`automaton.Automaton`), one for each range of prefixes; the
ranges' automata of all tasks meet, are united by summing weights, and pruned.
That takes three scans, each of which needs only what can still be frequent:

1. words, counted by Spark: those below the least count cut every phrase;
2. pairs of words that remain;
3. runs of three to five words whose pairs are all frequent, as suffixes: a run's weight is the
   number of suffixes that pass it, so one sequence a position counts all lengths.

What is frequent goes to the tasks of the next scan as a bit table of fixed size
(FILTER_BITS).  Bits may be shared, so a table keeps a few sequences too many, which
are pruned by their exact counts later, and never one too few; a table that fills up costs time and space, no rows.

Words are 64-bit hashes of language and bytes.  All distinct words are compared by hash once; if two share one, other hashes are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.automaton import Automaton
from lodestone.llm.texthash import mix, text_slices
from lodestone.runtime import bounded_batches, small, store

#: Words of a phrase, and counts that a candidate has at least.
MOST_WORDS, LEAST = 5, 100
#: Rows of the result for each language.
TOP = 2000
#: Bits of the tables of frequent words and pairs.
FILTER_BITS = 1 << 26
#: Sequences that a task gathers before it builds automata from them, and that are united at a time.
GATHERED = 1_000_000
#: Words of the corpus for each range of prefixes, and ranges at least.
RANGE_WORDS, RANGES = 4_000_000, 256

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random odd values of the bytes, and at least `n` powers of a base and of its inverse."""
    if seed not in _TABLES or len(_TABLES[seed][1]) < n:
        values = np.random.RandomState(seed).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        base = (int(values[0]) * 8 + 5) % (1 << 64)
        powers = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in powers:
            x[0] = 1
        _TABLES[seed] = (values, *(np.multiply.accumulate(x) for x in powers))
    return _TABLES[seed]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z: a polynomial over random values of the bytes, by prefix sums."""
    values, powers, inverses = _powers(seed, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _STEP)


def _tongue(lang: str, seed: int) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


def _words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of (lang, text) slice by slice: bytes, and of every word its row, start, end, hash, and whether the next word follows it in the same piece."""
    langs = batch.column(0).dictionary_encode()
    tongues = np.array([_tongue(x, seed) for x in langs.dictionary.to_pylist()] or [0], np.uint64)[langs.indices.to_numpy(zero_copy_only=False)]
    for first, _, data, offsets in text_slices(batch.column(1)):
        n = len(data)
        if not n:
            continue
        word = ~_GAPS[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner], stops[inner - 1] = word[inner], word[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(starts):
            continue
        rows = first + np.searchsorted(offsets, starts, "right") - 1
        cuts = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (cuts[1:] == cuts[:-1]) & (rows[1:] == rows[:-1])
        hashes = np.maximum(mix(_hashes(data, starts, ends, seed) ^ tongues[rows]), np.uint64(1))  # 0 ends a sequence
        yield data, rows, starts, ends, hashes, follows


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _counted(seed: int):
    """The distinct words of each batch: hash, language, word, count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, rows, starts, ends, hashes, _ in _words(batch, seed):
                # The first place of each hash, and the places whose word differs from that one's, should hashes ever clash.
                unique, at, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                low, size = _LOWER[data], ends - starts
                known = size[at][back]
                clash = size != known
                spans = np.minimum(size, known)
                both = np.repeat(np.arange(len(size)), spans)
                inside = np.arange(len(both)) - np.repeat(np.cumsum(spans) - spans, spans)
                clash[both[low[starts[both] + inside] != low[starts[at][back][both] + inside]]] = True
                for i in np.flatnonzero(clash):
                    times[back[i]] -= 1
                at, times, unique = np.append(at, np.flatnonzero(clash)), np.append(times, np.ones(int(clash.sum()), np.int64)), np.append(unique, hashes[clash])
                lengths = size[at]
                ends_of = np.cumsum(lengths)
                taken = np.repeat(starts[at] - (ends_of - lengths), lengths) + np.arange(int(ends_of[-1]))
                offsets = np.concatenate(([0], ends_of)).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[taken])])
                found.append(pa.table([pa.array(unique.view(np.int64)), batch.column(0).take(pa.array(rows[at])), words, pa.array(times)], names=["hash", "lang", "word", "n"]))
            if found:
                summed = pa.concat_tables(found).group_by(["hash", "lang", "word"]).aggregate([("n", "sum")]).select(["hash", "lang", "word", "n_sum"])
                yield from summed.rename_columns(["hash", "lang", "word", "n"]).combine_chunks().to_batches()

    return count


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(hash, lang, word, n) of all distinct words of (lang, text), and the seed of their hashes, under which no two of them share one."""
    seed = 0
    while True:
        words = store(texts.mapInArrow(_counted(seed), "hash long, lang string, word string, n long").groupBy("hash", "lang", "word").agg(F.sum("n").alias("n")))
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def _bits(keys: DataFrame) -> np.ndarray:
    """A table of FILTER_BITS bits from (key): its words of 64 bits, at most FILTER_BITS / 64 rows, are put together by Spark."""
    place = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, int(key & 63L))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return table.view(np.uint8)


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _STEP + right)


def _ranges(rows: np.ndarray, bits: int) -> np.ndarray:
    """The range of prefixes of each sequence: leading bits of its first words, up to three of them, in turn."""
    used = min(3, rows.shape[1])
    share = [bits // used + (i < bits % used) for i in range(used)]
    out = np.zeros(len(rows), np.int64)
    for i, b in enumerate(share):
        out = (out << b) | ((rows[:, i] >> np.uint64(64 - b)).astype(np.int64) if b else 0)
    return out


def _shard_automata(seed: int, words: np.ndarray, pairs: np.ndarray | None, bits: int):
    """Count transducers of a task's sequences, of pairs or (with the table of frequent pairs) of longer runs: range, automaton."""
    depth = 2 if pairs is None else MOST_WORDS

    def automata(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ranges = _ranges(rows, bits)
        order = np.lexsort([*rows.T[::-1], ranges])
        rows, ranges = rows[order], ranges[order]
        edges = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
        made = [(int(ranges[a]), Automaton.built(rows[a:b], np.ones(b - a, np.int64)).packed()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], ["range", "automaton"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, _, _, hashes, follows in _words(batch, seed):
                good = _held(words, hashes)
                linked = follows[:-1] & good[:-1] & good[1:]
                at = np.flatnonzero(linked)
                if pairs is not None and len(at):
                    linked[at] = _held(pairs, _pair_key(hashes[at], hashes[at + 1]))
                    run = np.zeros(len(hashes) + MOST_WORDS, np.int64)  # pairs that follow each other from here on, up to four
                    for _ in range(MOST_WORDS - 1):
                        run[: len(linked)] = np.where(linked, run[1 : len(linked) + 1] + 1, 0)
                    run = np.minimum(run, MOST_WORDS - 1)
                    at = np.flatnonzero(run >= 2)
                    steps = np.arange(depth)
                    places = np.minimum(at[:, None] + steps, len(hashes) - 1)
                    rows = np.where(steps <= run[at][:, None], hashes[places], np.uint64(0))
                else:
                    rows = np.stack([hashes[at], hashes[at + 1]], axis=1) if len(at) else np.zeros((0, depth), np.uint64)
                held.append(rows)
                size += len(rows)
                if size >= GATHERED:
                    yield from automata(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from automata(np.concatenate(held))

    return read


def _united(depth: int, complete: int, least: int):
    """One automaton for each range, of rows sorted by range: automata are united as they come, a bounded number of sequences at a time, and pruned at the end."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            whole = Automaton.united(parts, depth).pruned(least, complete)
            if len(whole.labels) >= complete:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([whole.packed()], pa.binary())], ["range", "automaton"])

        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if place != at and parts:
                    yield from done()
                    parts, size = [], 0
                at = place
                parts.append(Automaton.unpacked(data.as_py()))
                size += len(parts[-1])
                if size >= GATHERED and len(parts) > 1:
                    parts = [Automaton.united(parts, depth)]
                    size = 0
        if parts:
            yield from done()

    return unite


def _sequences(complete: int):
    """(gram, n) of automata: all their sequences from a length on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for d, (grams, weights) in enumerate(Automaton.unpacked(data.as_py()).sequences(MOST_WORDS)):
                    if d + 1 >= complete:
                        offsets = np.arange(0, (d + 1) * (len(grams) + 1), d + 1).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(grams[:, : d + 1]).ravel().view(np.int64)))
                        yield pa.RecordBatch.from_arrays([lists, pa.array(weights.astype(np.int64))], ["gram", "n"])

    return rows


def _kind(gram: Column) -> Column:
    return F.least(F.size(gram), F.lit(3))


def _range_of(gram: Column, bits: int) -> Column:
    """`_ranges` as an expression."""

    def joined(used: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(used):
            b = bits // used + (i < bits % used)
            out = F.shiftleft(out, b).bitwiseOR(F.shiftrightunsigned(gram[i], 64 - b)) if b else out
        return out

    return F.when(F.size(gram) == 1, joined(1)).when(F.size(gram) == 2, joined(2)).otherwise(joined(3))


def _looked_up(key: tuple, asked: pa.Table, automata: pa.Table) -> pa.Table:
    """The counts of the asked sequences of one length class and range, by composition with the range's automaton."""
    grams = asked["gram"].combine_chunks()
    sizes = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), MOST_WORDS), np.uint64)
    rows[np.repeat(np.arange(len(sizes)), sizes), _places(sizes)] = grams.flatten().to_numpy().view(np.uint64)
    order = np.lexsort(rows.T[::-1])
    counts = np.zeros(len(rows), np.int64)
    for data in automata["automaton"].to_pylist():
        counts[order] += Automaton.unpacked(data).composed(rows[order])
    return pa.table([grams, pa.array(counts)], names=["gram", "n"])


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _word_automata(bits: int):
    """Automata of single words from (range, hash, n), sorted by range."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, rows, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)[:, None], batch.column(2).to_numpy()
            order = np.lexsort((rows[:, 0], ranges))
            ranges, rows, counts = ranges[order], rows[order], counts[order]
            edges = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
            made = [(int(ranges[a]), Automaton.built(rows[a:b], counts[a:b]).packed()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["range", "automaton"])

    return build


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to five words by association.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends and into words at spaces and tabs.  a counts the phrase within pieces, overlaps
    included, n all words of the language.  A phrase of k words cut into two parts that count l and r scores floor(1000 a n / (l r));
    its lowest cut stands, the first of equals.  Candidates count `least` at least; those inside a longer candidate of the
    same count are dropped.  Rows come by falling score, then falling a, then phrase (bytewise).

    Null languages are `und`, null texts empty; texts of any length are read whole; repeated rows count as often as they stand; other columns are ignored; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, seed = word_counts(texts)
    sizes = store(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = (max(RANGES, -(-total // RANGE_WORDS)) - 1).bit_length()
    frequent = store(words.where(F.col("n") >= least))
    good = _bits(frequent.select(F.col("hash").alias("key")))

    def counted(pairs: np.ndarray | None) -> DataFrame:
        """(kind, range, automaton): the united and pruned automata of one scan."""
        depth, complete = (2, 2) if pairs is None else (MOST_WORDS, 3)
        made = texts.mapInArrow(_shard_automata(seed, good, pairs, bits), "range long, automaton binary")
        met = made.repartition("range").sortWithinPartitions("range")
        return store(met.mapInArrow(_united(depth, complete, least), "range long, automaton binary").select(F.lit(complete).alias("kind"), "range", "automaton"))

    two = counted(None)
    pairs = store(two.select("automaton").mapInArrow(_sequences(2), "gram array<long>, n long"))
    keys = pairs.select(F.col("gram")[0].alias("left"), F.col("gram")[1].alias("right")).mapInArrow(_keys, "key long")
    longer = counted(_bits(keys))
    grams = store(pairs.unionByName(longer.select("automaton").mapInArrow(_sequences(3), "gram array<long>, n long")))

    single = frequent.select(_range_of(F.array("hash"), bits).alias("range"), "hash", "n").repartition("range").sortWithinPartitions("range")
    automata = two.unionByName(longer).unionByName(single.mapInArrow(_word_automata(bits), "range long, automaton binary").select(F.lit(1).alias("kind"), "range", "automaton"))
    cuts = grams.select("gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = store(cuts.select("gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("left"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("right")))
    asked = cuts.select(F.explode(F.array("left", "right")).alias("gram")).distinct().select(_kind(F.col("gram")).alias("kind"), _range_of(F.col("gram"), bits).alias("range"), "gram")
    known = store(asked.groupBy("kind", "range").cogroup(automata.groupBy("kind", "range")).applyInArrow(_looked_up, "gram array<long>, n long"))
    left, right = known.select(F.col("gram").alias("left"), F.col("n").alias("l")), known.select(F.col("gram").alias("right"), F.col("n").alias("r"))
    cuts = store(cuts.join(left, "left").join(right, "right"))

    # A longer candidate of the same count has, among those one word longer, one of the same count as well.
    whole = cuts.where("k = size(gram) - 1 AND a = l").select(F.col("left").alias("gram"))
    inside = whole.unionByName(cuts.where("k = 1 AND a = r").select(F.col("right").alias("gram"))).distinct()
    kept = cuts.join(inside, "gram", "left_anti")
    named = kept.withColumn("first", F.col("gram")[0]).join(frequent.select(F.col("hash").alias("first"), "lang"), "first").join(small(sizes), "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    scored = named.withColumns({f"_{c}": v for c, v in exact.items()}).withColumn("score", F.expr("(_a * _n * 1000BD) div (_l * _r)"))
    best = scored.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("gram", "lang", "a", "n", "m.score", "m.l", "m.r")

    spelled = best.select("gram", F.posexplode("gram").alias("i", "hash")).join(frequent.select("hash", "word"), "hash")
    spelled = spelled.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(spelled, "gram").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    for by in (("lang", "salt"), ("lang",)):  # the best of parts, then of those
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(_pair_key(left, right).view(np.int64))], ["key"])


__all__ = ["collocations", "word_counts"]
