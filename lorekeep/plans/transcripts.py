"""Transcript sources over the driver's conversations: written in a dialect, read back as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import jsonl, logs, share, wire
from .base import query, shared_folder


def _written(rows: DataFrame, value) -> DataFrame:
    """The lines of a log for each conversation, in order of turns, as a collector of logs leaves them: in few files, each line after its log's name.  value is one line or some."""
    path = shared_folder(rows.sparkSession, "transcripts")
    ordered = rows.select("conv_id", "turn", value.alias("value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.select(F.concat(F.lit("conv_id="), F.col("conv_id").cast("string"), F.lit("/log.txt\t")).alias("name"), F.explode(F.split("value", "\n")).alias("value")).select(F.concat("name", "value")).write.text(path)
    return logs.collected(rows.sparkSession, path)


def _turns(read) -> DataFrame:
    return read("conversations").select("conv_id", "turn", "role", "text")


def _checked(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("session_id").cast("long").alias("conv_id"), F.col("ordinal").cast("long").alias("n"), "role", F.sha2("text", 256).alias("text_sha"))


def _numbered_sql(where: str) -> str:
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, sha256(text) AS text_sha FROM conversations WHERE {where}"


@query("""
SELECT conv_id, role, count(*) AS n, CAST(sum(CASE WHEN role = 'assistant' THEN 60 + 2 * length(text) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(hash_len) AS BIGINT) AS n_chars
FROM (SELECT *, length(text) AS hash_len FROM conversations) GROUP BY conv_id, role""")
def message_log(read):
    """Message events with usage: cache reads and creations count as input."""
    c = F.length("text").cast("long")
    usage = F.when(F.col("role") == "assistant", F.struct(F.lit(10).alias("input_tokens"), c.alias("output_tokens"), (2 * c).alias("cache_read_input_tokens"), F.lit(50).alias("cache_creation_input_tokens")))
    line = F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", usage.alias("usage"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"))
    turns = _turns(read)
    got = jsonl.messages(turns.sparkSession, _written(turns, F.to_json(line)))
    return got.groupBy(F.col("session_id").cast("long").alias("conv_id"), "role").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""
SELECT m.conv_id, m.n, m.role, m.text_sha, CASE WHEN m.role = 'assistant' THEN length(c.text) END AS output_tokens
FROM ({_numbered_sql("text <> ''")}) m JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE text <> '') c ON c.conv_id = m.conv_id AND c.n = m.n""")
def event_log(read):
    """An event log in which every assistant message is followed by its token count."""
    turns = _turns(read)
    user = F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload"))
    said = F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), "text")).alias("content")).alias("payload"))
    error = F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("error").alias("type"), F.col("text").alias("message")).alias("payload"))
    tokens = F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(F.lit(1).alias("input_tokens"), F.length("text").alias("output_tokens")).alias("last_token_usage")).alias("info")).alias("payload"))
    start = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("conv_id").cast("string").alias("id")).alias("payload")))
    whole = F.concat_ws("\n", F.when(F.col("turn") == F.min("turn").over(_conv()), start), F.when(F.col("role") == "user", F.to_json(user)).when(F.col("role") == "assistant", F.concat(F.to_json(said), F.lit("\n"), F.to_json(tokens))).otherwise(F.to_json(error)))
    got = logs.event_log(turns.sparkSession, _written(turns, whole))
    return _checked(got).join(got.select(F.col("session_id").cast("long").alias("conv_id"), F.col("ordinal").alias("n"), F.col("output_tokens")), ["conv_id", "n"])


def _conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


@query(_numbered_sql("text <> ''"))
def session_log(read):
    """One log of all sessions, told apart by the id on each line."""
    turns = _turns(read)
    line = F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message"))
    path = shared_folder(turns.sparkSession, "transcripts")
    turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn").select(F.to_json(line).alias("value")).write.text(path)
    return _checked(logs.many_sessions(turns.sparkSession, path))


@query("SELECT conv_id, count(*) AS n, arg_max(role, turn) AS title, min(turn) AS first_second, max(turn) AS last_second FROM conversations GROUP BY conv_id")
def session_log_summary(read):
    """The same log's sessions: last title wins, least and greatest time."""
    turns = _turns(read)
    ts = F.date_format(F.timestamp_seconds("turn"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.col("role").alias("title"), ts.alias("timestamp"), F.struct("role", F.lit("x").alias("content")).alias("message"))
    lines = _written(turns, F.to_json(line))
    n = logs.many_sessions(turns.sparkSession, lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    rows = logs.many_sessions_summary(turns.sparkSession, lines).join(n, "session_id")
    return rows.select(F.col("session_id").cast("long").alias("conv_id"), "n", "title", F.unix_timestamp("started").alias("first_second"), F.unix_timestamp("updated").alias("last_second"))


@query(_numbered_sql("text <> ''"))
def agent_log(read):
    """Agents' logs, whose users' queries stand between tags."""
    turns = _turns(read)
    content = F.when(F.col("role") == "user", F.concat(F.lit("<context>x</context>\n<user_query>\n"), "text", F.lit("\n</user_query>"))).otherwise(F.col("text"))
    got = logs.agent_log(turns.sparkSession, _written(turns, F.to_json(F.struct("role", F.struct(content.alias("content")).alias("message")))))
    return _checked(got.withColumn("session_id", F.regexp_extract("path", r"conv_id=(\d+)/", 1)))


@query(_numbered_sql("text <> '' AND conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def step_log(read):
    """Step logs; those that repeat a step are left out as a whole."""
    turns = _turns(read).join(read("labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("twice")), "conv_id", "left")
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("NOTE")
    source = F.when(F.col("role") == "user", "USER_EXPLICIT").when(F.col("role") == "assistant", "MODEL").otherwise("SYSTEM")
    line = F.to_json(F.struct(kind.alias("type"), source.alias("source"), F.col("turn").alias("step_index"), F.col("text").alias("content")))
    value = F.when(F.col("twice"), F.concat(line, F.lit("\n"), line)).otherwise(line)
    got = logs.step_log(turns.sparkSession, _written(turns, value))
    return _checked(got.withColumn("session_id", F.regexp_extract("session_id", r"conv_id=(\d+)", 1)))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 2 - 2 AS n, 'user' AS role, sha256(text) AS text_sha FROM conversations WHERE text <> ''")
def patch_log(read):
    """Patch logs: a first state, then a request appended a line."""
    turns = _turns(read).filter("text <> ''")
    first = F.to_json(F.struct(F.lit(0).alias("kind"), F.struct(F.col("conv_id").cast("string").alias("sessionId")).alias("v")))
    push = F.to_json(F.struct(F.lit(2).alias("kind"), F.array(F.lit("requests")).alias("k"), F.array(F.struct(F.struct("text").alias("message"))).alias("v")))
    value = F.when(F.col("turn") == F.min("turn").over(_conv()), F.concat(first, F.lit("\n"), push)).otherwise(push)
    return _checked(logs.patch_log(turns.sparkSession, _written(turns, value)))


@query("""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(length(text), 0) AS l FROM conversations),
h AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t BIGINT, u BOOLEAN)[]) AS kept FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, CASE WHEN l % 13 = 5 THEN CAST([] AS STRUCT(t BIGINT, u BOOLEAN)[]) WHEN l % 11 = 4 THEN [{'t': -turn - 1, 'u': false}]
    WHEN l % 5 = 3 THEN CASE WHEN len(users) >= 1 + l % 2 THEN more[1:users[len(users) - l % 2] - 1] ELSE more END ELSE more END AS kept
  FROM (SELECT *, [k FOR k IN range(1, len(more) + 1) IF more[k].u] AS users
    FROM (SELECT c.conv_id, c.i, c.l, c.turn, list_append(h.kept, {'t': CAST(c.turn AS BIGINT), 'u': c.role = 'user'}) AS more FROM h JOIN c ON c.conv_id = h.conv_id AND c.i = h.i + 1))),
last AS (SELECT conv_id, arg_max(kept, i) AS kept FROM h GROUP BY conv_id),
m AS (SELECT conv_id, unnest(kept).t AS t, generate_subscripts(kept, 1) - 1 AS n FROM last)
SELECT m.conv_id, m.n, CASE WHEN m.t < 0 THEN 'user' ELSE c.role END AS role, sha256(CASE WHEN m.t < 0 THEN 'summary ' || (-m.t - 1) ELSE coalesce(c.text, '') END) AS text_sha FROM m LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.t""")
def wire_log(read):
    """Wire logs replayed: lengths of texts decide where one is followed by an undo of one or two prompts, a clear or a compaction that keeps none."""
    turns = _turns(read)
    c = F.coalesce(F.length("text"), F.lit(0))
    append = F.struct(F.lit("context.append_message").alias("type"), F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("content")).alias("message"))
    clear = F.struct(F.lit("context.clear").alias("type"))
    compact = F.struct(F.lit("context.apply_compaction").alias("type"), F.lit(0).alias("compactedCount"), F.lit(0).alias("keptUserMessageCount"), F.concat(F.lit("summary "), F.col("turn").cast("string")).alias("summary"))
    undo = F.struct(F.lit("context.undo").alias("type"), (1 + c % 2).alias("count"))
    then = F.when(c % 13 == 5, F.to_json(clear)).when(c % 11 == 4, F.to_json(compact)).when(c % 5 == 3, F.to_json(undo))
    got = wire.wire_log(turns.sparkSession, _written(turns, F.concat_ws("\n", F.to_json(append), then)))
    return _checked(got.withColumn("session_id", F.regexp_extract("path", r"conv_id=(\d+)/", 1)))


SHOWN_SQL = r"regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t\r\f\v]*(?:citeturn|navlist|turn\d+\w*)[^,\s]*,?', '', 'g'), '(?m)[ \t\r\f\v]+$', '', 'g')"


@query(f"""
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'legacy' ELSE 'table' END AS form, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, CASE WHEN role IN ('user', 'tool') THEN role ELSE 'assistant' END AS role, sha256(shown) AS text_sha
FROM (SELECT *, {SHOWN_SQL} AS shown FROM conversations WHERE role <> 'system' AND text IS NOT NULL) WHERE shown <> ''""")
def share_page(read):
    """Pages of shared conversations, every third in the older form; in the others roles and texts stand at places of a flat table."""
    turns = _turns(read)
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    literal = lambda x: F.coalesce(F.regexp_replace(F.to_json(F.array(x)), r"\A\[|\]\z", ""), F.lit("null"))

    def data(role, text):
        said = F.transform("ts", lambda t, i: F.concat(F.lit('{"id": "'), t.turn.cast("string"), F.lit('", "message": {"author": {"role": '), role(t, i), F.lit('}, "content": {"content_type": "text", "parts": ['), text(t, i), F.lit("]}}}")))
        return F.concat(F.lit('{"conversation_id": "'), F.col("conv_id").cast("string"), F.lit('", "linear_conversation": ['), F.array_join(said, ","), F.lit("]}"))

    place = lambda k: lambda t, i: (2 * i + 3 + k).cast("string")  # noqa: E731  roles and texts follow the first three values in turns
    values = F.array_join(F.transform("ts", lambda t: F.concat(literal(t.role), F.lit(","), literal(t.text))), ",")
    flat = F.concat(F.lit('[0,"loaderData",{"' + share.ROUTE + '": {"serverResponse": {"data": '), data(place(0), place(1)), F.lit("}}},"), values, F.lit("]"))
    old = F.concat(F.lit('{"props": {"pageProps": {"serverResponse": {"data": '), data(lambda t, i: literal(t.role), lambda t, i: literal(t.text)), F.lit("}}}}"))
    script = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(f'<script id="{share.LEGACY_ID}">'), old, F.lit("</script>"))).otherwise(F.concat(F.lit("<script>w.streamController.enqueue("), literal(flat), F.lit(");</script>")))
    pages = listed.select("conv_id", F.concat(F.lit("<html><script>f(1)</script>"), script, F.lit("</html>")).alias("html"))
    got = share.share_pages(pages)
    return got.select("conv_id", "form", F.col("ordinal").alias("n"), "role", F.sha2("text", 256).alias("text_sha"))
