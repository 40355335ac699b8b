"""Other transcript formats as the same rows of messages.

Every reader gives path, session_id, ordinal, id, role, model, ts, text, input_tokens and
output_tokens, in Spark expressions over whole files or lines with explicit schemas.
Documents that are no JSON, or have no messages, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jsonl import role

COLUMNS = ["path", "session_id", "ordinal", "id", "role", "model", "ts", "text", "input_tokens", "output_tokens"]
PART = "array<struct<text: string, thinking: string, content: string>>"


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.withColumn("d", F.from_json("value", schema)).drop("value")


def _text(content: Column) -> Column:
    """content as a string, or as an array of parts joined by line ends."""
    parts = F.filter(F.transform(F.from_json(content, PART), lambda p: F.coalesce(p.text, p.thinking, p.content)), lambda t: t.isNotNull())
    return F.when(F.ltrim(content).startswith("["), F.array_join(parts, "\n")).otherwise(content)


def _rows(df: DataFrame, **known: Column) -> DataFrame:
    types = {"ordinal": "long", "ts": "timestamp", "input_tokens": "long", "output_tokens": "long"}
    return df.select(*(known.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS))


def gemini(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per session; tool calls count as lines `name(args)` below the text, thoughts come first."""
    message = "type: string, id: string, timestamp: string, model: string, content: string, toolCalls: array<struct<id: string, name: string, args: string>>, thoughts: array<struct<subject: string, description: string>>, tokens: struct<input: bigint, output: bigint, cached: bigint>"
    each = _files(spark, path, f"sessionId string, messages array<struct<{message}>>").select("path", "d.sessionId", F.posexplode("d.messages").alias("n", "m"))
    thoughts = F.transform("m.thoughts", lambda t: F.concat_ws(": ", t.subject, t.description))
    calls = F.transform("m.toolCalls", lambda c: F.concat(c["name"], F.lit("("), F.coalesce(c.args, F.lit("")), F.lit(")")))
    text = F.array_join(F.concat(F.coalesce(thoughts, F.array()), F.array(_text(F.col("m.content"))), F.coalesce(calls, F.array())), "\n")
    return _rows(each, path=F.col("path"), session_id=F.col("sessionId"), ordinal=F.col("n"), id=F.col("m.id"), role=role(F.col("m.type")), model=F.col("m.model"), ts=F.try_to_timestamp("m.timestamp"), text=text, input_tokens=F.col("m.tokens.input"), output_tokens=F.col("m.tokens.output"))


def task_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Editor agents' task folders, `<task>/<file>.json` holding an array of messages; of a task's files the API history wins."""
    each = _files(spark, path, "array<struct<role: string, content: string, ts: bigint>>").withColumn("task", F.element_at(F.split("path", "/"), -2))
    preferred = F.col("path").contains("api_conversation_history")
    best = each.withColumn("_n", F.row_number().over(Window.partitionBy("task").orderBy(preferred.desc(), "path"))).filter("_n = 1")
    m = best.select("path", "task", F.posexplode("d").alias("n", "m")).filter("m.role is not null")
    return _rows(m, path=F.col("path"), session_id=F.col("task"), ordinal=F.col("n"), id=F.concat("task", F.lit("-"), F.col("n").cast("string")), role=role(F.col("m.role")), ts=F.timestamp_millis("m.ts"), text=_text(F.col("m.content")))


def history(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per session with a history array; tool calls of an entry are named once per call id."""
    entry = "message: struct<role: string, content: string, id: string>, toolCallStates: array<struct<toolCall: struct<id: string, function: struct<name: string, arguments: string>>>>"
    each = _files(spark, path, f"sessionId string, title string, history array<struct<{entry}>>").filter("d.sessionId is not null").select("path", "d.sessionId", F.posexplode("d.history").alias("n", "m"))
    calls = F.transform("m.toolCallStates", lambda s: s.toolCall)
    ids = F.transform(calls, lambda c: c.id)
    once = F.filter(calls, lambda c, i: c.id.isNull() | (F.array_position(ids, c.id) == i + 1))
    named = F.transform(once, lambda c: F.concat(c.function["name"], F.lit("("), F.coalesce(c.function.arguments, F.lit("")), F.lit(")")))
    text = F.array_join(F.concat(F.array(_text(F.col("m.message.content"))), F.coalesce(named, F.array())), "\n")
    return _rows(each, path=F.col("path"), session_id=F.col("sessionId"), ordinal=F.col("n"), id=F.coalesce("m.message.id", F.concat(F.lit("entry-"), F.col("n").cast("string"))), role=role(F.col("m.message.role")), text=text)


def aider(spark: SparkSession, path: str) -> DataFrame:
    """Markdown chat logs: a header starts a session, `#### ` is the user, `> ` a tool, the rest the assistant.

    Inside code fences markers are plain text.  A log's lines are an array, so a file is one
    row; the fence state is folded over it, sessions and turns are running counts.  Headers
    that repeat within a file are told apart by their occurrence.
    """
    lines = F.split("value", "\r?\n")
    begin = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<l:string,code:boolean>>").alias("out"))

    def step(s, line):
        mark = F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1)
        closes = (s.fence != "") & mark.startswith(s.fence) & (F.trim(line) == mark)
        fence = F.when(s.fence == "", mark).when(closes, "").otherwise(s.fence)
        return F.struct(fence.alias("fence"), F.concat(s.out, F.array(F.struct(line.alias("l"), (s.fence != "").alias("code")))).alias("out"))

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.aggregate(lines, begin, step).out.alias("ls"))
    in_file = Window.partitionBy("path").orderBy("n")
    each = files.select("path", F.posexplode("ls").alias("n", "x")).select("path", "n", "x.*")
    header = ~F.col("code") & F.col("l").startswith("# aider chat started at")
    who = F.when(~F.col("code") & F.col("l").startswith("#### "), "user").when(~F.col("code") & F.col("l").startswith("> "), "tool").otherwise("assistant")
    each = each.withColumn("header", F.when(header, F.col("l"))).withColumn("session", F.count("header").over(in_file)).filter("session > 0")
    each = each.withColumn("role", who)
    in_session = Window.partitionBy("path", "session").orderBy("n")
    said = each.filter("header is null").withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(in_session))).cast("int")).withColumn("turn", F.sum("new").over(in_session))
    bare = F.when(F.col("role") == "user", F.substr("l", F.lit(6))).when(F.col("role") == "tool", F.substr("l", F.lit(3))).otherwise(F.col("l"))
    turns = said.groupBy("path", "session", "turn", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", bare.alias("b")))), lambda s: s.b), "\n").alias("t"))
    heads = each.filter("header is not null").select("path", "session", "header")
    heads = heads.withColumn("again", F.row_number().over(Window.partitionBy("path", "header").orderBy("session")))
    named = turns.filter(F.trim(F.replace("t", F.lit("\n"), F.lit(""))) != "").join(heads, ["path", "session"])
    ordinal = F.row_number().over(Window.partitionBy("path", "session").orderBy("turn")) - 1
    name = F.sha2(F.concat_ws("\n", "path", "header", F.col("again").cast("string")), 256)
    began = F.try_to_timestamp(F.regexp_extract("header", r"at (.*)$", 1))
    return _rows(named.withColumn("ordinal", ordinal), path=F.col("path"), session_id=name, ordinal=F.col("ordinal"), id=F.concat(name, F.lit("-"), F.col("ordinal").cast("string")), role=F.col("role"), ts=began, text=F.trim(F.regexp_replace("t", r"^\n+|\n+$", "")))
