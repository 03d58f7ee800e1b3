"""Chat formatting by quotation linking.

A line's quote level is the number of > before it.  Runs of lines of one level
above 0 are quoted passages, what is left is the message's own text.  Passages
and messages are normalised and hashed; a passage is linked to the message, or the paragraph,
line or lines in a row of one, of the same hash.  A message replies to the message that its
shallowest passage quotes, and a conversation is ordered so that replies follow what they
answer, without the quotes.

Everything is DataFrame expressions.  Windows find the latest place of a hash in the conversation,
and an index keeps one per hash and conversation, so texts that many messages share link no more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut, store

#: Passages whose normalised text is shorter than this are linked within their own conversation only.
LEAST_LETTERS = 12
#: Turns of a conversation that are numbered together; larger conversations are numbered part by part.
PART = 1024

_MARK = r"^(?:[ \t]*>)+[ \t]?"


def _normal(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hashed(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` with hash, 64 bits of the normalised `text`, and whether that is long; without those that have no letter or digit."""
    rows = rows.withColumn("__normal", _normal(text)).where("length(__normal) > 0")
    return rows.withColumns({"hash": F.xxhash64("__normal"), "long": F.length("__normal") >= LEAST_LETTERS}).drop("__normal")


def _lines(text: Column) -> Column:
    """The normalised lines of a text that have any letter or digit."""
    return F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "")


def _runs(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the runs of lines of bodies that begin like a passage of several lines and are as many.

    `placed` is (row, conv_id, turn, body) and `asked` has the passages' text.
    """
    seed = lambda lines, i: F.xxhash64(F.get(lines, i - 1), F.get(lines, i))
    begun = asked.select(_lines(F.col("text")).alias("l")).where("size(l) > 1").select(seed(F.col("l"), F.lit(1)).alias("seed"), F.size("l").alias("k")).distinct()
    held = placed.select("row", "conv_id", "turn", _lines(F.col("body")).alias("l")).where("size(l) > 1")
    starts = held.select("row", F.size("l").alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(i.alias("i"), seed(F.col("l"), i).alias("seed")))).alias("x"))
    found = starts.select("row", "m", "x.i", "x.seed").join(begun, "seed").where("i + k - 1 <= m").groupBy("row").agg(F.collect_set(F.struct("i", "k")).alias("at"))
    both = held.join(found, "row").select("conv_id", "turn", "l", F.explode("at").alias("x"))
    return both.select("conv_id", "turn", F.array_join(F.slice("l", F.col("x.i"), F.col("x.k")), " ").alias("text"))


def _latest(asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, near_turn): the latest turn of the conversation before a passage's own that holds its hash.

    Turns go part by part, so that a text said everywhere in a long conversation is no single task's.
    """
    key = ["conv_id", "hash", "__part"]
    events = asked.select("conv_id", "hash", "turn", "at", "level", F.lit(None).cast("long").alias("said")).unionByName(wanted.select("conv_id", "hash", "turn", F.col("turn").alias("said")), allowMissingColumns=True)
    events = events.withColumn("__part", F.expr(f"turn div {PART}"))
    before = F.max("top").over(Window.partitionBy("conv_id", "hash").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    tops = events.groupBy(*key).agg(F.max("said").alias("top")).select(*key, before.alias("earlier")).where("earlier IS NOT NULL")
    inside = F.max("said").over(Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = events.withColumn("inside", inside).where("at IS NOT NULL").join(tops, key, "left")
    return found.select("conv_id", "turn", "at", "level", F.coalesce("inside", "earlier").alias("near_turn")).where("near_turn IS NOT NULL")


def parsed(messages: DataFrame) -> DataFrame:
    """`messages` with `body`, the text without quotes, and `passages`: array of (level, text) in order.

    A line that ends in "wrote:" right before a quote introduces it and goes with it.  A null text has a null body and no passages.
    """
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    levels = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("line"), x.alias("raw")))
    rows = messages.withColumn("__lines", levels)
    rows = rows.withColumn("__starts", F.expr("filter(sequence(1, size(__lines)), i -> __lines[i - 1].level > 0 AND (i = 1 OR __lines[greatest(i - 2, 0)].level <> __lines[i - 1].level))"))
    rows = rows.withColumn("__ends", F.expr("filter(sequence(1, size(__lines)), i -> __lines[i - 1].level > 0 AND (i = size(__lines) OR __lines[least(i, size(__lines) - 1)].level <> __lines[i - 1].level))"))
    passages = F.expr("zip_with(__starts, __ends, (s, e) -> named_struct('level', __lines[s - 1].level, 'text', array_join(transform(slice(__lines, s, e - s + 1), x -> x.line), '\n')))")
    own = F.expr("filter(__lines, (x, i) -> x.level = 0 AND NOT (trim(x.line) RLIKE 'wrote:$' AND coalesce(get(__lines, i + 1).level, 0) > 0))")
    quoted = F.coalesce(F.size("__starts") > 0, F.lit(False))
    body = F.when(quoted, F.btrim(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), F.lit(" \t\n"))).otherwise(F.col("text"))
    rows = rows.withColumns({"body": body, "passages": F.coalesce(passages, F.array().cast("array<struct<level:int,text:string>>"))})
    return rows.drop("__lines", "__starts", "__ends")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, n_linked, parent_conv, parent_turn, root_turn, depth, position) per row of `messages`.

    n_quotes counts the quoted passages and n_linked those that are found: in
    the message's own conversation before it, else anywhere else, the latest turn before it and then the
    smallest (conversation, turn) winning; a passage shorter than LEAST_LETTERS is sought in its own
    conversation alone, and one without a letter or digit nowhere.  Lines in a row are compared without those that have neither.  parent is what the first of the
    shallowest linked passages quotes.  root_turn and depth follow parents within the conversation;
    position, from 1, orders it by root, depth and turn, so that a reply never comes before what it answers.

    Null texts have a null body.  Rows with a null conv_id form a conversation of
    their own and a null turn comes first; neither is quoted or quotes.  Repeated rows are messages of
    their own; of messages with equal ids one reply serves all.  A message of any length is
    read whole.  Extra columns are ignored, an empty table gives an empty one.
    """
    rows = parsed(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")).drop("text")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = placed.where("size(passages) > 0").select("conv_id", "turn", F.posexplode("passages").alias("at", "p"))
    asked = store(_hashed(asked.select("conv_id", "turn", "at", "p.level", "p.text"), F.col("text")).distinct())

    units = F.array_distinct(F.concat(F.array("body"), F.split("body", "\n[ \t]*\n"), F.split("body", "\n")))
    units = placed.select("conv_id", "turn", F.explode(units).alias("text")).unionByName(_runs(placed, asked))
    index = _hashed(units, F.col("text")).drop("text")
    wanted = index.where("long").join(asked.where("long").select("hash").distinct(), "hash", "left_semi").select("conv_id", "turn", "hash", "long")
    short = index.where("NOT long").join(asked.where("NOT long").select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    wanted = store(wanted.unionByName(short).distinct())
    near = _latest(asked, wanted)
    near = near.groupBy("conv_id", "turn", "at", "level").agg(F.max("near_turn").alias("near_turn"))
    # Anywhere: the smallest place, or the next conversation's where that is the quoting message's own.
    places = wanted.where("long").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    first = places.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    other = places.join(first, "hash").where("conv_id <> first.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    far = asked.where("long").join(first, "hash").join(other, "hash", "left")
    far = far.select("conv_id", "turn", "at", "level", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second")).alias("far")).where("far IS NOT NULL")
    both = near.join(far, ["conv_id", "turn", "at", "level"], "full")
    both = both.select("conv_id", "turn", "at", "level", F.when(F.col("near_turn").isNotNull(), F.col("conv_id")).otherwise(F.col("far.conv_id")).alias("pc"), F.coalesce("near_turn", "far.turn").alias("pt"))
    parents = store(both.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "at", "pc", "pt")).alias("p"), F.countDistinct("at").cast("long").alias("n_linked")))
    parents = parents.select("conv_id", "turn", "n_linked", F.col("p.pc").alias("parent_conv"), F.col("p.pt").alias("parent_turn"))

    # Roots and depths by doubling: after k rounds a reply has jumped 2^k messages up.
    jumps = cut(parents.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = jumps.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        after = cut(jumps.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        jumps = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    whole = rows.join(parents, ["conv_id", "turn"], "left").join(jumps, ["conv_id", "turn"], "left")
    whole = whole.select(
        "conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_conv", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    whole = whole.withColumn("__part", F.expr(f"coalesce(root_turn, -1) div {PART}"))
    counts = whole.groupBy("conv_id", "__part").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("__conv"), F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before")).where("__before > 0")
    order = Window.partitionBy("conv_id", "__part").orderBy(F.col("root_turn").asc_nulls_first(), "depth", F.col("turn").asc_nulls_first(), "role", "body")
    whole = whole.join(counts, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__part") == F.col("__of")), "left")
    position = (F.coalesce("__before", F.lit(0)) + F.row_number().over(order)).cast("long").alias("position")
    return whole.select("conv_id", "turn", "role", "body", "n_quotes", "n_linked", "parent_conv", "parent_turn", "root_turn", "depth", position)


def rendered(messages: DataFrame, most: int = 10_000) -> DataFrame:
    """(conv_id, part, n_messages, n_linked, chat): each conversation as texts of role and body blocks in reply order.

    A text holds `most` messages at most: a longer conversation goes on in
    parts, numbered from 0, whose n_messages and n_linked are their own.  Null roles and bodies are empty there, ties are in
    the order of `linked`, and an empty table gives an empty one.
    """
    block = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("body", F.lit("")))
    rows = linked(messages).withColumn("part", F.expr(f"(position - 1) div {most}"))
    made = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(F.struct("position", block.alias("block")))).alias("blocks"))
    return made.select("conv_id", "part", "n_messages", "n_linked", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("chat"))
