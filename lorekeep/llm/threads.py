"""Quotation linking: which message answers which, from what it quotes.

A message's leading `>` marks give each line a quote level; a passage is a run of lines of
one level.  Passages, their lines and their sentences are normalised and hashed, and so are
those of the own passages and whole own texts of all messages; a quoted passage links its
message to the earlier message of the conversation that wrote the passage or else most of
its lines and sentences.  Conversations come out in reply order without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

MARKS = r"^(\s*>)+"
#: Between sentences: after a full stop and blanks, or after a full-width one.
STOPS = r"(?<=[.!?\u2026])[\"')\]\u201d\u2019]*\s+|(?<=[\u3002\uff01\uff1f])"


def lines(text: Column) -> Column:
    """Array of (level, line): the number of leading > marks and the line without them."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"\s", "")).alias("level"), F.regexp_replace(x, MARKS + r"\s?", "").alias("line")))


def passages(parsed: Column) -> Column:
    """Array of (level, text): runs of lines of one level, blank lines ending a run."""
    at = lambda i: F.get(parsed, i - 1)
    solid = lambda x: x.line.rlike(r"\S")
    goes_on = lambda i: F.coalesce((at(i - 1).level == at(i).level) & solid(at(i - 1)) & solid(at(i)), F.lit(False))
    starts = F.filter(F.sequence(F.lit(1), F.size(parsed)), lambda i: ~goes_on(i))

    def cut(s):
        run = lambda a, j: F.slice(parsed, a, F.coalesce(F.get(s, j + 1), F.size(parsed) + 1) - a)
        return F.transform(s, lambda a, j: F.struct(at(a).level.alias("level"), F.array_join(F.transform(run(a, j), lambda x: x.line), "\n").alias("text")))

    return F.filter(F.transform(F.array(starts), cut)[0], lambda p: p.text.rlike(r"\S"))


def normal(text: Column) -> Column:
    """Lower-case words between single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def pieces(text: Column) -> Column:
    """Distinct digests of a passage's lines and sentences; those without a word are left out."""
    cut = F.concat(F.split(text, "\n", -1), F.split(text, STOPS, -1))
    return F.array_distinct(F.transform(F.filter(F.transform(cut, normal), lambda x: x != ""), lambda x: F.sha2(x, 256)))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quotes, quote_depth, reply_to, by_quote, from_conv, from_turn, reply_depth, reply_order.

    reply_to is the turn that wrote the message's outermost and first quotation of which an earlier
    turn of the conversation wrote anything: of several such turns one that wrote all of it in one,
    then the one that wrote most of its lines and sentences, then the latest; without such a
    quotation it is the turn before, and null for a first turn.  by_quote tells the two apart.
    reply_depth counts the answers up to the root.  reply_order numbers a conversation's turns from
    0 by (reply_depth, turn), so that a message follows the one it answers: own_text in that order
    is the conversation without quotes.  Equal quotations of a conversation are looked up once.
    from_conv and from_turn are the first message of another conversation, by its id and turn,
    that wrote the outermost and first quotation of a message which no turn of its own wrote;
    it bears on no order.  Very long texts are cut whole.  Null texts are empty; rows with a null conversation or turn answer none and
    are answered by none; rows that repeat a turn are messages of their own that link alike and share a place in the order, which
    rows with a null conversation or turn do not have.  An empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), lines(text).alias("parsed"))
    own = F.array_join(F.transform(F.filter("parsed", lambda x: x.level == 0), lambda x: x.line), "\n")
    rows = rows.withColumn("p", passages(F.col("parsed"))).select("conv", "turn", "role", F.regexp_replace(own, r"^\s+|\s+$", "").alias("own_text"), F.filter("p", lambda x: x.level > 0).alias("quotes"), F.filter("p", lambda x: x.level == 0).alias("said"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "messages")
    placed = rows.filter("conv is not null and turn is not null")
    blank = F.sha2(F.lit(""), 256)
    quoted = placed.select("row", "conv", "turn", F.posexplode("quotes").alias("nth", "q")).select("row", "conv", "turn", "nth", "q.level", digest(F.col("q.text")).alias("whole"), pieces(F.col("q.text")).alias("pieces")).filter(F.col("whole") != blank)
    # equal quotations have one name; what they look for has as many rows as it has pieces
    quoted = scratch.table(quoted.withColumn("name", F.sha2(F.concat_ws(" ", F.col("whole"), F.array_sort("pieces")), 256)), "quoted")
    named = quoted.select("conv", "name", "whole", "pieces").dropDuplicates(["conv", "name"])
    sought = scratch.table(named.select("conv", "name", "whole", F.explode(F.array_union(F.array("whole"), F.col("pieces"))).alias("h")), "sought")
    own_parts = F.array_distinct(F.concat(F.array(digest(F.col("own_text"))), F.transform("said", lambda s: digest(s.text)), F.flatten(F.transform("said", lambda s: pieces(s.text)))))
    written = placed.select("conv", F.col("turn").alias("by"), F.explode(own_parts).alias("h"))
    written = written.join(sought.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
    covered = sought.join(written, ["conv", "h"]).groupBy("conv", "name", "by").agg(F.struct(F.bool_or(F.col("h") == F.col("whole")).alias("all"), F.count(F.lit(1)).alias("n"), F.col("by")).alias("best"))
    answer = _best_before(quoted, covered).groupBy("row").agg(F.min_by("best.by", F.struct("level", "nth")).alias("quoted"))
    # of quotations without an answer in their conversation: who wrote them first elsewhere
    alone = quoted.join(answer.select("row"), "row", "left_anti").select("row", "conv", "level", "nth", "whole")
    sources = placed.select("conv", "turn", F.explode(own_parts).alias("h")).join(alone.select(F.col("whole").alias("h")).distinct(), "h", "left_semi")
    first = _first_two(sources)
    elsewhere = alone.join(first, alone.whole == first.h).withColumn("p", F.when(F.col("one.conv") != F.col("conv"), F.col("one")).otherwise(F.col("two"))).filter("p is not null").groupBy("row").agg(F.min_by("p", F.struct("level", "nth")).alias("p"))
    turns = placed.select("conv", "turn").distinct()
    joined = rows.join(answer, "row", "left").join(elsewhere, "row", "left").join(_before(turns), ["conv", "turn"], "left")
    replies = scratch.table(joined.select("row", "conv", "turn", "role", "own_text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda q: q.level)), F.lit(0)).cast("long").alias("quote_depth"), F.coalesce("quoted", "before").alias("reply_to"), F.col("quoted").isNotNull().alias("by_quote"), F.col("p.conv").alias("from_conv"), F.col("p.turn").alias("from_turn")), "replies")
    depth = _depths(replies.filter("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.max("reply_to").alias("up")))
    out = replies.join(_order(depth), ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "own_text", "n_quotes", "quote_depth", "reply_to", "by_quote", "from_conv", "from_turn", F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"), "reply_order")


def chats(linked: DataFrame, conv_col: str = "conv_id", role_col: str = "role", block: int = 256) -> DataFrame:
    """conv_id, part and messages, an array of (role, content), of the rows of `link`: conversations in reply order without quotes.

    Messages without a text of their own are left out, and rows without a place.  A part holds at
    most `block` places of the order, so a long conversation is many rows.
    """
    rows = linked.filter("reply_order is not null and own_text <> ''").select(F.col(conv_col).alias("conv"), F.floor(F.col("reply_order") / block).alias("part"), F.struct("reply_order", F.col(role_col).alias("role"), F.col("own_text").alias("content")).alias("m"))
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return parts.select(F.col("conv").alias(conv_col), "part", F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def _first_two(sources: DataFrame) -> DataFrame:
    """(h, one, two): the first place (conv, turn) that wrote h, and the first of another conversation."""
    each = sources.groupBy("h", "conv").agg(F.min("turn").alias("turn")).select("h", F.struct("conv", "turn").alias("p"))
    one = each.groupBy("h").agg(F.min("p").alias("one"))
    two = each.join(one, "h").filter("p.conv <> one.conv").groupBy("h").agg(F.min("p").alias("two"))
    return one.join(two, "h", "left")


def _best_before(quoted: DataFrame, covered: DataFrame, block: int = 1024) -> DataFrame:
    """(row, level, nth, best): the greatest best(conv, name, by) of a quotation's name with by < turn, if any.  In blocks of turns, as in _before."""
    none = F.lit(None).cast("long")
    asks = quoted.select("conv", "name", F.col("turn").alias("at"), "row", "level", "nth", F.lit(None).cast(covered.schema["best"].dataType).alias("best"))
    both = asks.unionByName(covered.select("conv", "name", F.col("by").alias("at"), none.alias("row"), F.lit(None).cast(asks.schema["level"].dataType).alias("level"), F.lit(None).cast("int").alias("nth"), "best")).withColumn("block", F.floor(F.col("at") / block))
    ends = covered.groupBy("conv", "name", F.floor(F.col("by") / block).alias("block")).agg(F.max("best").alias("top"))
    ends = quoted.select("conv", "name", F.floor(F.col("turn") / block).alias("block"), F.lit(None).cast(covered.schema["best"].dataType).alias("top")).distinct().unionByName(ends).groupBy("conv", "name", "block").agg(F.max("top").alias("top"))
    ends = ends.select("conv", "name", "block", F.max("top").over(Window.partitionBy("conv", "name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = Window.partitionBy("conv", "name", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("best").over(within)).filter("row is not null")
    return both.join(ends, ["conv", "name", "block"], "left").select("row", "level", "nth", F.greatest("near", "earlier").alias("best")).filter("best is not null")


def _order(depths: DataFrame) -> DataFrame:
    """(conv, turn, depth, reply_order): places by (depth, turn) from 0.  Ranges of equal size are numbered, so a long conversation is many tasks' work."""
    ranged = depths.repartitionByRange("conv", "depth", "turn").withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged, "order")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("depth", "turn"))
    return ranged.withColumn("place", place).join(counts, ["conv", "part"]).select("conv", "turn", "depth", (F.col("base") + F.col("place") - 1).alias("reply_order"))


def _before(turns: DataFrame, block: int = 1024) -> DataFrame:
    """(conv, turn, before): the next lower turn of the conversation.  Long conversations are looked through in blocks."""
    blocks = turns.withColumn("block", F.floor(F.col("turn") / block))
    ends = blocks.groupBy("conv", "block").agg(F.max("turn").alias("end"))
    ends = ends.select("conv", "block", F.lag("end").over(Window.partitionBy("conv").orderBy("block")).alias("earlier"))
    within = blocks.withColumn("before", F.lag("turn").over(Window.partitionBy("conv", "block").orderBy("turn")))
    return within.join(ends, ["conv", "block"]).select("conv", "turn", F.coalesce("before", "earlier").alias("before"))


def _depths(parents: DataFrame) -> DataFrame:
    """(conv, turn, depth) by doubling pointers: as many rounds as the logarithm of the longest chain of answers."""
    known = scratch.table(parents.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "depths")
    while not known.filter("up is not null").isEmpty():
        above = known.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        # chains that have reached their root are not joined again
        new = scratch.table(known.filter("up is not null").join(above, ["conv", "up"]).select("conv", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")).unionByName(known.filter("up is null")), "depths")
        scratch.drop(known)
        known = new
    return known.select("conv", "turn", "depth")


def op8_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
