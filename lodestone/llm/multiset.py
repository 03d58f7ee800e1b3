"""Document fingerprints that are sums: a homomorphic multiset hash of paragraphs.

A paragraph is a part of a text between line feeds.  It is hashed to a wide
vector of lanes, and a text's fingerprint is the sum of its paragraphs' vectors,
every lane modulo 2^32.  So the order of paragraphs makes no difference, the
fingerprint of two texts on top of each other is a sum, and a paragraph is
inserted or deleted by adding or subtracting its vector, without the rest of the text.

Lanes of a paragraph's vector:

* DIGEST lanes, 32 bits each of its SHA-256 and of the SHA-256 of that: equality.
* one lane with the number of its clauses, and BITS lanes that count how many of
  its clauses have bit j set in their md5: likeness.  Twice such a lane less the number of clauses is
  a sum of random signs, so products of these sums estimate how many clauses two texts share.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import small, store

#: Lanes of equality and of likeness, and what every lane is counted modulo.
DIGEST, BITS, MODULUS = 16, 64, 1 << 32
LANES = DIGEST + 1 + BITS
#: What parts the clauses of a paragraph.
CLAUSE_ENDS = r"[.,;:!?\n]+"

_VECTOR = r"""
transform(array(named_struct(
  'd', transform(split({text}, '\n'), p -> transform(array(sha2(p, 256)), d -> concat(d, sha2(d, 256)))[0]),
  'h', transform(filter(split({text}, '{ends}'), c -> trim(c) <> ''), c -> transform(array(md5(trim(c))), m ->
         bigint(conv(substring(m, 1, 8), 16, 10)) | shiftleft(bigint(conv(substring(m, 9, 8), 16, 10)), 32))[0]))),
 v -> transform(array(transform(sequence(0, {half}), j -> aggregate(v.h, 0L, (s, h) -> s + (shiftrightunsigned(h, j) & 4294967297L)))), packed ->
   concat(
     transform(sequence(0, {digest}), j -> aggregate(v.d, 0L, (s, d) -> s + bigint(conv(substring(d, 8 * j + 1, 8), 16, 10))) % {modulus}L),
     array(bigint(size(v.h))),
     transform(packed, x -> x & 4294967295L),
     transform(packed, x -> shiftrightunsigned(x, 32))))[0])[0]
"""


def vector(text: str) -> Column:
    """The fingerprint of the text in the column or expression `text`, array<bigint> of LANES; null counts as the empty text, which is one empty paragraph."""
    return F.expr(_VECTOR.format(text=f"coalesce({text}, '')", ends=CLAUSE_ENDS, half=BITS // 2 - 1, digest=DIGEST - 1, modulus=MODULUS))


def inserted(fingerprint: Column, more: Column) -> Column:
    """The fingerprint with the paragraphs of another one added."""
    return F.zip_with(fingerprint, more, lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def deleted(fingerprint: Column, less: Column) -> Column:
    """The fingerprint with the paragraphs of another one taken away."""
    return F.zip_with(fingerprint, less, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a lane."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two texts' clauses, estimated from their fingerprints alone: 1 for equal ones, between 0 and 1 for others, 0 where one has no clauses."""

    def products(x: Column, y: Column) -> Column:
        signs = lambda v: F.transform(F.slice(v, DIGEST + 2, BITS), lambda c: 2 * c - F.element_at(v, DIGEST + 1))
        return F.aggregate(F.zip_with(signs(x), signs(y), lambda p, q: p * q), F.lit(0).cast("long"), lambda s, p: s + p)

    size = F.sqrt(products(a, a).cast("double") * products(b, b).cast("double"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(products(a, b).cast("double"), size), F.lit(0.0)))))


def _ranked(classes: DataFrame) -> DataFrame:
    """`classes` with rank from 0 by falling doc_id (null last), then rising digest: ranges of the order are numbered side by side."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest")]
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = store(classes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts of (doc_id, text), and of each text with its second half overwritten from the next document's.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).  Of a text of n code points the last
    floor(n / 2) give way to the first as many of the next text (all, if it has fewer) by falling doc_id; null ids come last,
    texts of one id by their SHA-256, and the first text follows the last.  Of rows that repeat id and text, one is
    followed by the next text and each other one by its equal.  Null texts count as empty, texts of any length are hashed
    whole, other columns are ignored, and an empty table gives an empty one.

    The edited fingerprint is made from the text's own: the paragraphs from the cut on are deleted and those
    that the edit makes are inserted.  Texts move once, as the halves that meet in an edit.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    head = "substring(text, 1, int(n_chars - n_chars div 2))"
    # From the start of the paragraph that is cut.
    tail = f"substring(text, int(1 + n_chars - n_chars div 2 - length(substring_index({head}, '\\n', -1))))"
    one = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    ranked = store(_ranked(one))
    total = ranked.count()
    follower = ranked.select("doc_id", "digest", "rank", F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("receiver"))
    needs = ranked.select(F.col("rank").alias("receiver"), F.expr("int(n_chars div 2)").alias("need"))
    places = store(follower.join(small(needs), "receiver"))

    # Every distinct text once: its fingerprint, that of the paragraphs an edit leaves alone, and its two halves of edits.
    placed = rows.alias("r").join(small(places).alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.digest") == F.col("p.digest"))).select("r.*", "p.rank", "p.receiver", "p.need")
    sent = F.array(
        F.struct(F.col("rank").alias("at"), F.expr(head).alias("head"), F.lit(None).cast("string").alias("gift")),
        F.struct(F.col("receiver").alias("at"), F.lit(None).cast("string").alias("head"), F.expr("substring(text, 1, need)").alias("gift")),
    )
    halves = placed.select(F.explode(sent).alias("s")).select("s.*").groupBy("at").agg(F.max("head").alias("head"), F.max("gift").alias("gift"))
    prints = placed.select("rank", vector("text").alias("own"), vector(tail).alias("gone"))
    prints = store(prints.groupBy("rank").agg(F.max("own").alias("own"), F.max("gone").alias("gone")))
    meant = F.array(F.struct(F.lit(False).alias("alike"), F.col("gift").alias("gift")), F.struct(F.lit(True).alias("alike"), F.expr("substring(head, 1, int(n_chars div 2))").alias("gift")))
    base = ranked.join(halves, ranked["rank"] == halves["at"]).select("rank", "doc_id", "n_chars", "copies", "head", F.explode(F.when(F.col("copies") > 1, meant).otherwise(F.slice(meant, 1, 1))).alias("m"))
    changed = base.select("rank", "doc_id", "n_chars", "copies", "m.alike", F.sha2(F.concat("head", "m.gift"), 256).alias("edited_sha256"), vector("concat(substring_index(head, '\\n', -1), m.gift)").alias("new"))
    both = changed.join(prints, "rank").withColumn("after", inserted(deleted(F.col("own"), F.col("gone")), F.col("new")))
    behind = prints.select(F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"), F.col("own").alias("following"))
    both = both.join(behind, "rank").withColumn("following", F.when(F.col("alike"), F.col("own")).otherwise(F.col("following")))
    own, after = F.col("own"), F.col("after")
    made = both.select("doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(after).alias("edited_fingerprint"), likeness(own, after).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"), F.when(F.col("alike"), F.col("copies") - 1).otherwise(F.lit(1)).alias("times"))
    # Copies come back last, as rows of digests, by the thousand.
    spread = made.withColumn("some", F.explode(F.expr("transform(sequence(0L, (times - 1) div 1000), i -> int(least(1000L, times - 1000 * i)))")))
    return spread.withColumn("x", F.explode(F.expr("sequence(1, some)"))).drop("x", "some", "times")
