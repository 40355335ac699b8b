"""Event logs, logs of many sessions, step logs and patch logs as the same rows of messages; from a path, or from lines at hand."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shipping
from .jsonl import collected, lines, role  # noqa: F401
from .transcripts import COLUMNS, _rows, _text

LINE = ["path", "block", "line"]  #: where a line stands: its file, the part of the file, and its order within that


def _in_file(*more: str) -> Window:
    return Window.partitionBy("path", *more).orderBy("block", "line")


def _stem() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)


EVENT = (
    "type string, timestamp string, payload struct<type: string, id: string, cwd: string, message: string, role: string, content: string, call_id: string, name: string, input: string, arguments: string,"
    " output: string, action: string, item: struct<type: string, content: string>, info: struct<last_token_usage: struct<input_tokens: bigint, output_tokens: bigint>>>"
)


def event_log(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Session, message and response events, one file a session.

    Users' messages come in two dialects, of which a file's first counts.  A token count fills the
    usage of the last assistant message before it that has none.  Lines that are no JSON are left out.
    """
    shipping.ship(spark)
    e = lines(spark, path).select(*LINE, F.from_json("value", EVENT).alias("e")).filter("e.payload is not null").select(*LINE, "e.type", "e.timestamp", "e.payload")
    kind, t, p = F.col("type"), F.col("payload.type"), lambda c: F.col(f"payload.{c}")
    call = F.concat(F.coalesce(p("name"), F.when(t == "web_search_call", "web_search"), F.lit("unknown")), F.lit("("), F.coalesce(p("arguments"), p("input"), p("action"), F.lit("")), F.lit(")"))
    says = lambda who, text, dialect=None: F.struct(F.lit(who).alias("role"), text.cast("string").alias("text"), F.lit(dialect).cast("string").alias("dialect"))
    told = (
        F.when((kind == "event_msg") & (t == "user_message"), says("user", p("message"), "legacy"))
        .when((kind == "event_msg") & (t == "item_completed") & (p("item.type") == "UserMessage"), says("user", _text(p("item.content")), "item"))
        .when((kind == "event_msg") & (t == "error"), says("system", F.coalesce(p("message"), F.lit("Unknown error"))))
        .when((kind == "event_msg") & (t == "token_count") & p("info.last_token_usage").isNotNull(), says("usage", F.lit(None)))
        .when((kind == "response_item") & (t == "message") & (p("role") == "assistant"), says("assistant", _text(p("content"))))
        .when((kind == "response_item") & t.isin("function_call", "custom_tool_call", "web_search_call"), says("assistant", call))
        .when((kind == "response_item") & t.isin("function_call_output", "custom_tool_call_output"), says("tool", p("output")))
    )
    each = e.withColumn("m", told).filter("m is not null")
    each = each.select(*LINE, "timestamp", "m.*", p("info.last_token_usage.input_tokens").alias("i"), p("info.last_token_usage.output_tokens").alias("o"))
    first = each.filter("dialect is not null").groupBy("path").agg(F.min_by("dialect", F.struct("block", "line")).alias("own"))
    each = each.join(first, "path", "left").filter("dialect is null or dialect = own").filter("role = 'usage' or coalesce(text, '') <> ''")
    meta = e.filter("type = 'session_meta'").groupBy("path").agg(F.min_by(p("id"), F.struct("block", "line")).alias("session"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, []  # the assistant messages of this file that have no usage yet
        for batch in batches:
            out = []
            for at, b, n, who, i, o in batch.itertuples(index=False):
                if at != now:
                    now, open_ = at, []
                if who == "assistant":
                    open_.append((b, n))
                elif open_:
                    out.append((at, *open_.pop(), None if pd.isna(i) else int(i), None if pd.isna(o) else int(o)))
            yield pd.DataFrame(out, columns=[*LINE, "i", "o"]).astype({"i": "Int64", "o": "Int64"})

    counted = each.filter("role in ('assistant', 'usage')").select(*LINE, "role", "i", "o").repartition("path").sortWithinPartitions(*LINE)
    usage = counted.mapInPandas(fill, "path string, block long, line long, i long, o long")
    said = each.filter("role <> 'usage'").drop("i", "o").join(usage, LINE, "left").join(meta, "path", "left")
    said = said.withColumn("n", F.row_number().over(_in_file()) - 1)
    return _rows(said, path=F.col("path"), session_id=F.coalesce("session", _stem()), ordinal=F.col("n"), id=F.concat(F.lit("event-"), F.col("n").cast("string")), role=F.col("role"), ts=F.try_to_timestamp("timestamp"), text=F.col("text"), input_tokens=F.col("i"), output_tokens=F.col("o"))


MIXED = "sessionId string, cwd string, title string, model string, timestamp string, uuid string, message struct<role: string, content: string>"


def _mixed(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return lines(spark, path).select(*LINE, F.from_json("value", MIXED).alias("e")).select(*LINE, "e.*").filter("sessionId is not null")


def many_sessions(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages of logs that hold many sessions, each line naming its own."""
    m = _mixed(spark, path).filter("message is not null").withColumn("text", _text(F.col("message.content"))).filter("coalesce(text, '') <> ''")
    n = F.row_number().over(_in_file("sessionId")) - 1
    return _rows(m.withColumn("n", n), path=F.col("path"), session_id=F.col("sessionId"), ordinal=F.col("n"), id=F.coalesce("uuid", F.concat(F.lit("line-"), F.col("line").cast("string"))), role=role(F.col("message.role")), model=F.col("model"), ts=F.try_to_timestamp("timestamp"), text=F.col("text"))


def many_sessions_summary(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, session_id, title, project, model, started, updated): of each value the last that is given; the least and greatest time."""
    at = F.struct("block", "line")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    ts = F.try_to_timestamp("timestamp")
    return _mixed(spark, path).groupBy("path", F.col("sessionId").alias("session_id")).agg(last("title").alias("title"), last("cwd").alias("project"), last("model").alias("model"), F.min(ts).alias("started"), F.max(ts).alias("updated"))


def agent_log(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages of agents' logs; a user's query stands between <user_query> tags, if there are any.  A session is named by its file's whole path, as file names repeat."""
    e = lines(spark, path).select(*LINE, F.from_json("value", "role string, content string, message struct<role: string, content: string>").alias("e")).filter("e is not null")
    who, text = role(F.coalesce("e.role", "e.message.role")), _text(F.coalesce("e.message.content", "e.content"))
    asked = F.regexp_extract(text, r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    m = e.select(*LINE, who.alias("role"), F.when((who == "user") & (asked != ""), asked).otherwise(text).alias("text")).filter("coalesce(text, '') <> ''")
    m = m.withColumn("n", F.row_number().over(_in_file()) - 1)
    name = F.concat(F.substring(F.sha2("path", 256), 1, 32), F.lit(":"), _stem())
    return _rows(m, path=F.col("path"), session_id=name, ordinal=F.col("n"), id=F.concat(F.lit("line-"), F.col("n").cast("string")), role=F.col("role"), text=F.col("text"))


def step_log(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages of step logs, `<conversation>/<file>`; source and type tell the role.

    A file that repeats a step, or names another conversation, is ambiguous: none of its rows are
    given (see `ambiguous_steps`).
    """
    e = _steps(spark, path)
    m = e.join(_ambiguous(e).select("path"), "path", "left_anti")
    who = F.when((F.col("source") == "USER_EXPLICIT") & (F.col("type") == "USER_INPUT"), "user").when((F.col("source") == "MODEL") & (F.col("type") == "PLANNER_RESPONSE"), "assistant").when(F.col("source") == "SYSTEM", "system").otherwise("unknown")
    m = m.withColumn("role", who).withColumn("text", F.when(who == "unknown", F.col("value")).otherwise(_text(F.col("content")))).filter("coalesce(text, '') <> ''")
    m = m.withColumn("n", F.row_number().over(_in_file()) - 1)
    return _rows(m, path=F.col("path"), session_id=F.col("conversation"), ordinal=F.col("n"), id=F.concat(F.lit("step-"), F.coalesce(F.col("step_index").cast("string"), F.concat(F.lit("line-"), F.col("line").cast("string")))), role=F.col("role"), ts=F.try_to_timestamp("created_at"), text=F.col("text"))


def _steps(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    kind = "type string, source string, step_index bigint, conversationId string, content string, created_at string"
    e = lines(spark, path).select(*LINE, "value", F.from_json("value", kind).alias("e")).filter("e.type is not null and e.source is not null")
    return e.select(*LINE, "value", "e.*").withColumn("conversation", F.element_at(F.split("path", "/"), -2))


def _ambiguous(e: DataFrame) -> DataFrame:
    per = e.groupBy("path").agg(F.count("step_index").alias("n"), F.count_distinct("step_index").alias("different"), F.count_if(F.col("conversationId") != F.col("conversation")).alias("foreign"))
    return per.filter("n > different or foreign > 0")


def ambiguous_steps(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, repeated, foreign) of the step logs that `step_log` leaves out."""
    return _ambiguous(_steps(spark, path)).select("path", (F.col("n") - F.col("different")).alias("repeated"), "foreign")


def _place(state, path: list):
    """The container that holds the last segment of a path, made on the way where there is none."""
    here = state
    for segment, following in zip(path, path[1:], strict=False):
        if isinstance(segment, str):
            if here.get(segment) is None:
                here[segment] = {} if isinstance(following, str) else []
        else:
            here.extend([None] * (segment + 1 - len(here)))
            if here[segment] is None:
                here[segment] = {} if isinstance(following, str) else []
        here = here[segment]
    return here


def patched(state, event: dict):
    """The state after a patch: kind 0 gives it whole, 1 sets a value, 2 cuts a list at `i` and appends to it, 3 deletes."""
    kind = event["kind"]
    if kind == 0:
        return event["v"]
    path = event["k"]
    if kind not in (1, 2, 3):
        raise ValueError("a patch of an unknown kind")
    if not path:
        return event["v"] if kind == 1 else [*(state or [])[: event.get("i")], *event.get("v", [])]
    here, last = _place(state, path), path[-1]
    if not isinstance(last, str) and kind != 3:
        here.extend([None] * (last + 1 - len(here)))
    if kind == 1:
        here[last] = event["v"]
    elif kind == 2:
        items = (here.get(last) if isinstance(last, str) else here[last]) or []
        cut = event.get("i", len(items))
        here[last] = [*items[:cut], *[None] * (cut - len(items)), *event.get("v", [])]
    elif kind == 3:
        if isinstance(here, dict):
            here.pop(last, None)
        elif last < len(here):
            del here[last]
    return state


def patch_log(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages of the states that patch logs add up to: a request's message, then its response's parts.

    A file's patches are streamed through a task in order; what it holds is the state of one file.
    A file with a patch that doesn't fit its state, or without a first state, gives no rows.
    """
    shipping.ship(spark)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, bad, out = None, None, False, []

        def flush() -> None:
            if now is not None and state is not None and not bad:
                out.append((now, json.dumps(state, ensure_ascii=False).encode("utf-8", "replace").decode()))

        for batch in batches:
            for at, value in zip(batch["path"], batch["value"], strict=True):
                if at != now:
                    flush()
                    now, state, bad = at, None, False
                try:
                    event = json.loads(value)
                    if state is None and event["kind"] != 0:
                        bad = True
                    elif not bad:
                        state = patched(state, event)
                except (ValueError, KeyError, TypeError, AttributeError, IndexError):
                    bad = True
            yield pd.DataFrame(out, columns=["path", "state"])
            out = []
        flush()
        yield pd.DataFrame(out, columns=["path", "state"])

    rows = lines(spark, path).filter("trim(value) <> ''").repartition("path").sortWithinPartitions(*LINE).select("path", "value")
    shape = "sessionId string, requests array<struct<requestId: string, timestamp: bigint, message: struct<text: string>, response: array<struct<value: string>>>>"
    s = rows.mapInPandas(replay, "path string, state string").select("path", F.from_json("state", shape).alias("s"))
    each = s.select("path", F.coalesce("s.sessionId", _stem()).alias("session"), F.posexplode("s.requests").alias("n", "r"))
    answer = F.array_join(F.filter(F.transform("r.response", lambda x: x.value), lambda v: v.isNotNull()), "\n")
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("r.message.text").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), answer.alias("text")))
    m = each.select("path", "session", "n", "r.requestId", "r.timestamp", F.explode(both).alias("m")).filter("coalesce(m.text, '') <> ''")
    return _rows(m, path=F.col("path"), session_id=F.col("session"), ordinal=F.col("n") * 2 + F.col("m.k"), id=F.concat_ws("-", F.coalesce("requestId", F.lit("request")), "n", "m.k"), role=F.col("m.role"), ts=F.timestamp_millis("timestamp"), text=F.col("m.text"))


def discover(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources' messages, with the column source, and what went wrong by source: a source that fails to open leaves the others alone."""
    found, failed = None, {}
    for name, read in sources.items():
        try:
            df = read().select(F.lit(name).alias("source"), *COLUMNS)
            found = df if found is None else found.unionByName(df)
        except Exception as e:  # noqa: BLE001  whatever a source raises is its own failure
            failed[name] = str(e).splitlines()[0]
    return found, failed


def imported(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], folder: str, at_once: int = 4) -> tuple[DataFrame | None, dict[str, str]]:
    """Like `discover`, but each source is a job of its own, `at_once` at a time, and written to a new folder below folder/<name>: one that breaks while it is read leaves the others' rows."""

    def one(name: str) -> tuple[str, str | None]:
        new = f"{folder}/{name}/{uuid.uuid4().hex}"
        try:
            sources[name]().select(F.lit(name).alias("source"), *COLUMNS).write.parquet(new)
        except Exception as e:  # noqa: BLE001  whatever a source raises is its own failure
            return name, (str(e).splitlines() or [type(e).__name__])[0]
        paths[name] = new
        return name, None

    paths: dict[str, str] = {}
    with ThreadPoolExecutor(at_once) as pool:
        ran = list(pool.map(inheritable_thread_target(spark)(one), sources))
    failed = {name: why for name, why in ran if why is not None}
    written = [paths[name] for name in sources if name in paths]
    return (spark.read.parquet(*written) if written else None), failed
