"""Chat formatting: quotation linking and reply-ordered conversations.

A line that starts with n quote marks ('>') is quoted at level n. Runs of lines of one level
are passages. A quoted passage, each of its paragraphs and each of its lines is normalised
(lower case, single blanks) and hashed, and so are the unquoted text of every message as a
whole, each of its passages, their paragraphs and their lines. A quoted hash links to the
nearest earlier message of the conversation that has it unquoted; a line that everybody
quotes makes no pairs. A message replies to the message that most hashes of its outermost
linked level point to; ties go to the later turn. Threads are followed to their roots by
pointer doubling.

A conversation may hold any share of all messages: the nearest earlier message is found
within chunks of turns with the last one of earlier chunks carried over, and places are
counted in ranges of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.native import let
from corpusmill.sources.store import written

#: Turns that one chunk spans, as a power of two, and messages that one range holds.
CHUNK_BITS = 12
PART_ROWS = 50_000
MARKS = r"^(?:[ \t]*>)+"
# Customary lines that introduce a quotation.
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\s*:\s*$"


def quoted_lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines; attributions just before a quotation get level -1."""
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    line = lambda x: F.struct(F.regexp_count(marks(x), F.lit(">")).alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("body"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)
    lead = lambda a, x, i: (x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(a, i + 1)["level"], F.lit(0)) > 0)
    return let(lines, lambda a: F.transform(a, lambda x, i: F.struct(F.when(lead(a, x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body"))))


def normalised(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, r"[\x09-\x0D ]+", " ")))


def passages(lines: Column) -> Column:
    """array<struct<level, lines>>: runs of lines of one level, in order."""
    none = F.array().cast("array<int>")

    def cut(a: Column) -> Column:
        starts = F.filter(F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(none), lambda i: ~F.get(a, i)["level"].eqNullSafe(F.get(a, i - 1)["level"]))
        bodies = lambda s, i, j: F.transform(F.slice(a, i + 1, F.coalesce(F.get(s, j + 1), F.size(a)) - i), lambda x: x["body"])
        return let(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(a, i)["level"].alias("level"), bodies(s, i, j).alias("lines"))))

    return let(lines, cut)


def units(lines: Column) -> Column:
    """What of some lines can be quoted: all of them joined, each paragraph, each line."""
    return F.concat(F.array(F.array_join(lines, " ")), F.split(F.array_join(lines, "\n"), r"\n[\x09-\x0D ]*\n"), lines)


def keys(texts: Column) -> Column:
    """Distinct hashes of texts; blank ones have none."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda t: t != ""), lambda t: F.xxhash64(t)))


def unquoted(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])


def of_level(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda p: test(p["level"]))


def linked(messages: DataFrame) -> DataFrame:
    """parent_turn of the messages that quote an earlier one: conv_id, turn, parent_turn, of messages(conv_id, turn, lines, passages)."""
    mine = F.flatten(F.transform(of_level(F.col("passages"), lambda x: x == 0), lambda p: units(p["lines"])))
    own = messages.select("conv_id", "turn", F.explode(keys(F.concat(F.array(F.array_join(unquoted(F.col("lines")), " ")), mine))).alias("key"))
    quoting = messages.select("conv_id", "turn", F.explode(of_level(F.col("passages"), lambda x: x > 0)).alias("p"))
    asked, _ = written(quoting.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(keys(units(F.col("p.lines")))).alias("key")).distinct(), "quoted")
    # Only what someone quotes can be linked to. Written, so that a hot passage can be split.
    wanted, _ = written(asked.select("conv_id", "key").distinct(), "quoted-keys")
    held = own.join(wanted, ["conv_id", "key"], "left_semi").distinct()
    events = held.select("conv_id", "key", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level")).unionByName(asked.select("conv_id", "key", "turn", F.lit(None).cast("bigint").alias("source"), "level"))
    events, _ = written(events.withColumn("chunk", F.shiftright("turn", CHUNK_BITS)), "quotation-events")
    within = Window.partitionBy("conv_id", "key", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("conv_id", "key", "chunk").agg(F.max("source").alias("last")).select("conv_id", "key", "chunk", F.max("last").over(before).alias("carried"))
    near = events.withColumn("near", F.max("source").over(within)).where("level is not null")
    found = near.join(carried, ["conv_id", "key", "chunk"]).withColumn("parent_turn", F.coalesce("near", "carried")).where("parent_turn is not null")
    votes = found.groupBy("conv_id", "turn", "level", "parent_turn").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("parent_turn", F.struct(-F.col("level"), "n", "parent_turn")).alias("parent_turn"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn (root), depth of linked messages, by pointer doubling."""
    at, _ = written(parents.withColumns({"up": F.col("parent_turn"), "depth": F.lit(1).cast("bigint")}), "threads")
    while True:
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        step, _ = written(at.join(above, ["conv_id", "up"], "left"), "threads")
        if step.where("up2 is not null").isEmpty():
            return at.select("conv_id", "turn", "parent_turn", F.col("up").alias("thread_turn"), "depth")
        at = step.select("conv_id", "turn", "parent_turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Messages without quotations, in reply order.

    conversations: conv_id, turn, role, text and any others, which are ignored. Returns
    conv_id, turn, role, body (text without quoted lines and the lines that introduce them),
    n_passages (quoted), parent_turn (null: no link), thread_turn (the message's own turn if
    it has no parent), depth and reply_order, the position in its conversation: threads by
    their root's turn, replies by turn, ties by role and the MD5 of the body. Null texts have
    an empty body. Messages with a null conv_id or turn link with nothing; without a conv_id
    they have no place either. Repeated rows share their links and get places of their own.
    An empty table gives no rows.
    """
    lines = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", quoted_lines(F.col("text")).alias("lines"))
    cut = lines.withColumn("passages", passages(F.col("lines")))
    found = threads(linked(cut.where("conv_id is not null and turn is not null").select("conv_id", "turn", "lines", "passages")))
    body = F.array_join(unquoted(F.col("lines")), "\n")
    quoted = F.size(of_level(F.col("passages"), lambda x: x > 0)).cast("bigint")
    rows = cut.select("conv_id", "turn", "role", body.alias("body"), quoted.alias("n_passages")).join(found, ["conv_id", "turn"], "left")
    rows = rows.withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("bigint"))})
    # Numbers given as the table is written are fixed; only they and the order's keys are ranged.
    rows, _ = written(rows.withColumn("row", F.monotonically_increasing_id()), "messages")
    placed = places(rows.where("conv_id is not null").select("row", "conv_id", "thread_turn", "turn", "role", F.md5("body").alias("digest"))).select("row", "reply_order")
    return rows.join(placed, "row", "left").select("conv_id", "turn", "role", "body", "n_passages", "parent_turn", "thread_turn", "depth", "reply_order")


def places(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with reply_order, their place in their conversation, counted in parts of bounded size."""
    order = [F.col(c).asc_nulls_first() for c in ("thread_turn", "turn", "role", "digest", "row")]
    parts = max(1, -(-rows.count() // part_rows))
    ranged, _ = written(rows.repartitionByRange(parts, F.col("conv_id").asc(), *order).withColumn("part", F.spark_partition_id()), "places")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return ranged.withColumn("place", within).join(bases, ["conv_id", "part"]).withColumn("reply_order", (F.col("base") + F.col("place")).cast("bigint"))
