"""Line-delimited transcripts as one row per message, read as text and shredded with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, uuid string, sessionId string, cwd string, timestamp string, message struct<role: string, model: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>, content: string>"
BLOCKS = "array<struct<type: string, text: string, thinking: string, name: string, content: string>>"
#: Role aliases.
ROLES = {"human": "user", "gemini": "assistant", "model": "assistant"}


def role(name: Column) -> Column:
    out = F.lower(name)
    for alias, known in ROLES.items():
        out = F.when(F.lower(name) == alias, known).otherwise(out)
    return F.when(out.isin("user", "assistant", "system", "tool"), out).otherwise("unknown")


def _input(usage: Column) -> Column:
    """Raw input tokens with those read from and written to the cache; null without a usage."""
    return F.when(usage.isNotNull(), sum((F.coalesce(usage[c], F.lit(0)) for c in ("cache_read_input_tokens", "cache_creation_input_tokens")), F.coalesce(usage["input_tokens"], F.lit(0))))


def lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, block, line, value) of all lines; large files are read in parts, each in order.  Lines that are at hand, such as `collected` ones, are taken as they are."""
    if isinstance(path, DataFrame):
        return path
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta.file_path.alias("path"), meta.file_block_start.alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def collected(spark: SparkSession, path: str) -> DataFrame:
    """The `lines` of many logs in few files, each line after its log's name and a tab.

    A small file a log costs an opening each, and a place in the driver's list of files.  Here
    lines of different logs may alternate; those of one log stand in order in one file.
    """
    at = F.instr("value", "\t")
    named = lines(spark, path).filter(at > 0)
    return named.select(F.col("value").substr(F.lit(1), at - 1).alias("path"), "block", "line", F.col("value").substr(at + 1, F.length("value")).alias("value"))


def messages(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row per message event: path, line, session_id, id, role, model, ts, text, input_tokens, output_tokens.

    content is a string or an array of blocks, whose texts are joined.  Lines that are not
    JSON objects are left out (see `quality` and `whole`); an event without an id is named by its line.
    Files may be split between tasks, so line is an order within a file, not a count.
    """
    e = lines(spark, path).drop("block").withColumn("e", F.from_json("value", EVENT)).filter(F.col("e.type").isin("user", "human", "assistant", "system"))
    blocks = F.from_json("e.message.content", BLOCKS)
    text = F.when(F.col("e.message.content").startswith("["), F.array_join(F.transform(blocks, lambda b: F.coalesce(b.text, b.thinking, b.content, F.lit(""))), "\n")).otherwise(F.col("e.message.content"))
    return e.select(
        "path", "line", F.col("e.sessionId").alias("session_id"), F.coalesce("e.uuid", F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("id"),
        role(F.coalesce("e.message.role", "e.type")).alias("role"), F.col("e.message.model").alias("model"), F.try_to_timestamp("e.timestamp").alias("ts"), text.alias("text"),
        _input(F.col("e.message.usage")).alias("input_tokens"), F.col("e.message.usage.output_tokens").alias("output_tokens"),
    )


def quality(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, malformed, partial_tail) of each file; partial_tail: the last line is malformed, as while it is being written."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta.file_path.alias("path"), F.struct(meta.file_block_start, F.monotonically_increasing_id()).alias("at"), F.try_parse_json("value").isNull().alias("bad"), (F.trim("value") == "").alias("blank"))
    return lines.filter("not blank").groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("malformed"), F.max_by("bad", "at").alias("partial_tail"))


def whole(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of files without a malformed line before the last, by their `quality`: others fail as a whole."""
    broken = told.filter(F.col("malformed") > F.col("partial_tail").cast("int")).select("path")
    return rows.join(broken, "path", "left_anti")


def sessions(rows: DataFrame) -> DataFrame:
    """Sessions of messages: title (first user text, 120 characters), start, end, counts and token sums."""
    asked = (F.col("role") == "user") & F.col("text").rlike(r"\S")
    return rows.groupBy("session_id").agg(
        F.min_by(F.when(asked, F.substring("text", 1, 120)), F.when(asked, F.struct("path", "line"))).alias("title"), F.min("ts").alias("started"), F.max("ts").alias("updated"),
        F.count(F.lit(1)).alias("n_messages"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
