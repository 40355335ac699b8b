"""Wire logs of agent sessions, replayed into the history they leave: appends, steps, undo, clear and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shipping
from .jsonl import role
from .logs import LINE, _stem, lines
from .transcripts import _rows, _text

RECORD = (
    "type string, time string, modelAlias string, model string, count bigint, compactedCount bigint, keptUserMessageCount bigint, keptHeadUserMessageCount bigint, legacyTail boolean,"
    " summary string, contextSummary string, message struct<id: string, role: string, content: string, origin: struct<kind: string, trigger: string, ownerPromptId: string>, toolCalls: string>,"
    " event struct<type: string, toolCallId: string, name: string, args: string, part: string, result: struct<output: string, isError: boolean>>"
)
#: What the replay is told of a record: no text, only what moves messages about.
TOLD = ["op", "n", "kept", "head", "legacy", "full", "anchor", "origin", "owner", "id", "call"]


class History:
    """The messages of one file as lists [records, interrupted calls, is anchor, origin, owner, id]; texts stay in the table."""

    def __init__(self) -> None:
        self.kept, self.deferred, self.pending, self.open = [], [], set(), None

    def settle(self) -> None:
        """After an undo, a clear or a compaction no step is open and nothing waits."""
        self.open, self.pending, self.deferred = None, set(), []

    def close(self) -> None:
        if self.open is not None:
            self.open[1] = sorted(self.pending)
            if len(self.open[0]) == 1:  # a step of which nothing but its beginning is recorded
                self.kept = [m for m in self.kept if m is not self.open]
        late = self.deferred
        self.settle()
        self.kept += late

    def undo(self, n: int) -> None:
        """Cuts before the nth prompt from the end, with what was injected for it; nothing if a summary stands before or prompts are too few."""
        at = len(self.kept)
        while n and at:
            at -= 1
            if self.kept[at][3] == "compaction_summary":
                return
            n -= self.kept[at][2]
        if n or at == len(self.kept):
            return
        owner = self.kept[at][5]
        while at and self.kept[at - 1][3] == "injection" and self.kept[at - 1][4] == owner:
            at -= 1
        del self.kept[at:]
        self.settle()

    def compact(self, at, r) -> None:
        n, kept, head = r.n, r.kept, max(r.head, 0)
        if n < 0 or n > len(self.kept) or not r.full:
            raise ValueError("a compaction without a boundary or a summary")
        summary = [[at], [], False, "compaction_summary", None, r.id]
        if r.legacy:
            self.kept = [summary, *self.kept[n:]]
        else:
            prompts = [m for m in self.kept if m[2]]
            if kept < 0 or not head <= kept <= len(prompts):
                raise ValueError("a compaction that keeps prompts it does not have")
            self.kept = [*prompts[:head], *prompts[len(prompts) - (kept - head) :], summary]
        self.settle()

    def apply(self, at, r) -> None:
        message = [[at], [], bool(r.anchor), r.origin, r.owner, r.id]
        if r.op == "append":
            (self.deferred if self.pending else self.kept).append(message)
        elif r.op == "clear":
            self.kept = []
            self.settle()
        elif r.op == "undo":
            self.undo(r.n)
        elif r.op == "compact":
            self.compact(at, r)
        elif r.op == "begin":
            self.close()
            self.open = message
            self.kept.append(message)
        elif r.op == "end":
            self.close()
        elif r.op in ("part", "call"):
            if self.open is None or (r.op == "call" and (not r.call or r.call in self.pending)):
                raise ValueError("a part or a call outside a step, or a call twice")
            self.open[0].append(at)
            if r.op == "call":
                self.pending.add(r.call)
        elif r.op == "result":
            if not r.call:
                raise ValueError("a result without a call id")
            message[3] = None if r.call in self.pending else "orphan_result"
            self.pending.discard(r.call)
            self.kept.append(message)
            if not self.pending:
                late, self.deferred = self.deferred, []
                self.kept += late
        else:
            raise ValueError("a record of an unknown kind")


def _told(e: DataFrame) -> DataFrame:
    """One row per record that moves messages, with TOLD; records of other kinds than context are left out."""
    kind, event, origin = F.col("e.type"), F.col("e.event"), F.col("e.message.origin")
    step = F.when(event["type"] == "step.begin", "begin").when(event["type"] == "step.end", "end").when(event["type"] == "content.part", "part").when(event["type"] == "tool.call", "call").when(event["type"] == "tool.result", "result").otherwise("unknown")
    op = (
        F.when(kind.isNull(), "unknown")
        .when(kind == "context.clear", "clear")
        .when(kind == "context.undo", "undo")
        .when(kind == "context.apply_compaction", "compact")
        .when((kind == "context.append_message") & F.col("e.message").isNotNull(), "append")
        .when((kind == "context.append_loop_event") & event.isNotNull(), step)
        .when(kind.startswith("context."), "unknown")
    )
    asked = (role(F.col("e.message.role")) == "user") & (origin["kind"].isNull() | (origin["kind"] == "user") | (origin["kind"].isin("skill_activation", "plugin_command") & (origin["trigger"] == "user-slash")))
    missing = F.lit(-1).cast("long")
    n = F.when(op == "undo", F.when(F.col("e.count") >= 0, F.col("e.count")).otherwise(F.lit(1))).otherwise(F.coalesce("e.compactedCount", "e.count", missing))
    summary = F.coalesce("e.contextSummary", "e.summary")
    told = e.select(
        *LINE, op.alias("op"), n.cast("long").alias("n"), F.coalesce("e.keptUserMessageCount", missing).alias("kept"), F.coalesce("e.keptHeadUserMessageCount", F.lit(0)).cast("long").alias("head"),
        F.coalesce("e.legacyTail", F.col("e.keptUserMessageCount").isNull()).alias("legacy"), F.coalesce(summary != "", F.lit(False)).alias("full"), F.coalesce(asked, F.lit(False)).alias("anchor"),
        origin["kind"].alias("origin"), origin["ownerPromptId"].alias("owner"), F.col("e.message.id").alias("id"), event["toolCallId"].alias("call"),
    )
    return told.filter("op is not null")


def _replayed(told: DataFrame) -> DataFrame:
    """(path, ordinal, part, block, line, origin, interrupted): the records of each message of the history that is left, in order; state `failed` alone for a file that cannot be replayed."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, history, bad = None, History(), False
        columns = ["path", "ordinal", "part", "block", "line", "origin", "interrupted", "failed"]

        def flush() -> Iterator[pd.DataFrame]:
            if now is None:
                return
            if bad:
                yield pd.DataFrame([(now, None, None, None, None, None, None, True)], columns=columns)
                return
            history.close()
            out = []
            for i, m in enumerate(history.kept):
                out += [(now, i, p, *at, m[3], ",".join(m[1]) or None, False) for p, at in enumerate(m[0])]
                if len(out) >= 10000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.path != now:
                    yield from flush()
                    now, history, bad = r.path, History(), False
                if not bad:
                    try:
                        history.apply((r.block, r.line), r)
                    except ValueError:
                        bad = True
        yield from flush()

    rows = told.repartition("path").sortWithinPartitions(*LINE).select(*LINE, *TOLD)
    return rows.mapInPandas(replay, "path string, ordinal long, part int, block long, line long, origin string, interrupted string, failed boolean")


def _call(name: Column, args: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("unknown")), F.lit("("), F.coalesce(args, F.lit("")), F.lit(")"))


def _time(c: Column) -> Column:
    return F.coalesce(F.timestamp_millis(F.when(c.rlike(r"^-?\d+$"), c).try_cast("long")), F.try_to_timestamp(c))


def _records(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return lines(spark, path).filter("trim(value) <> ''").select(*LINE, F.from_json("value", RECORD).alias("e"))


def wire_log(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages of the histories that wire logs add up to, one file a session.

    A message appended while calls wait for results comes after the last of them; a step's parts and
    calls make one message, a step of neither none.  Undo of n takes the last n prompts and all that
    follows, but not past a summary.  A compaction puts a summary before what follows its boundary,
    or keeps prompts from both ends before it.  A file with a line that is no JSON object (an
    unfinished last one too), an unknown context record, or one that does not fit its history gives
    no rows (see `wire_states`).  Repeated ids stay apart; null ids are named by their record's place.

    The replay is told only what moves messages: a task holds the places of one file's records, and
    texts meet them in a join.
    """
    shipping.ship(spark)
    e = _records(spark, path)
    left = _replayed(_told(e)).filter("not failed").drop("failed")
    said = F.when(F.col("e.type") == "context.append_message", F.concat_ws("\n", F.when(_text(F.col("e.message.content")) != "", _text(F.col("e.message.content"))), _tool_calls(F.col("e.message.toolCalls"))))
    summary = F.coalesce("e.contextSummary", "e.summary")
    said = said.when(F.col("e.type") == "context.apply_compaction", F.when(F.ltrim(summary).startswith("{"), _text(F.get_json_object(summary, "$.content"))).otherwise(_text(summary)))
    said = said.when(F.col("e.event.type") == "content.part", _part(F.col("e.event.part"))).when(F.col("e.event.type") == "tool.call", _call(F.col("e.event.name"), F.col("e.event.args"))).when(F.col("e.event.type") == "tool.result", _text(F.col("e.event.result.output")))
    who = F.when(F.col("e.type") == "context.append_message", role(F.col("e.message.role"))).when(F.col("e.type") == "context.apply_compaction", role(F.coalesce(F.get_json_object(summary, "$.role"), F.lit("user")))).when(F.col("e.event.type") == "tool.result", "tool").otherwise("assistant")
    model = F.when(F.col("e.type").isin("profile.bind", "llm.request"), F.coalesce(F.nullif("e.modelAlias", F.lit("")), F.nullif("e.model", F.lit(""))))
    known = e.filter(F.col("e.type").startswith("context.")).select(*LINE, F.coalesce(said, F.lit("")).alias("text"), who.alias("role"), _time(F.col("e.time")).alias("ts"), F.coalesce("e.message.id", F.concat(F.lit("record-"), F.col("block").cast("string"), F.lit("-"), F.col("line").cast("string"))).alias("id"))
    steps = _models(e.select(*LINE, model.alias("model"), (F.col("e.event.type") == "step.begin").alias("begins")).filter("model is not null or begins"))
    rows = left.join(known, LINE).join(steps, LINE, "left")
    first = F.col("part") == 0
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("part", "text"))))
    m = rows.groupBy("path", "ordinal").agg(
        F.array_join(F.transform(texts, lambda t: t.text), "\n").alias("text"), *[F.any_value(F.when(first, F.col(c)), ignoreNulls=True).alias(c) for c in ("role", "ts", "id", "model")]
    )
    return _rows(m, path=F.col("path"), session_id=_stem(), ordinal=F.col("ordinal"), id=F.col("id"), role=F.col("role"), model=F.col("model"), ts=F.col("ts"), text=F.col("text"))


def _part(part: Column) -> Column:
    """A part's text or thought; a string is its own text; other parts stand as they are, redacted ones not at all."""
    p = F.from_json(part, "type string, text string, thinking string, think string")
    return F.when(~F.ltrim(part).startswith("{"), _text(part)).when(p["type"] == "redacted", "").otherwise(F.coalesce(p.text, p.thinking, p.think, part))


def _tool_calls(calls: Column) -> Column:
    each = F.from_json(calls, "array<struct<name: string, input: string, arguments: string, function: struct<name: string, arguments: string>>>")
    return F.array_join(F.transform(each, lambda c: _call(F.coalesce(c.function["name"], c["name"]), F.coalesce(c.function.arguments, c.input, c.arguments))), "\n")


def _models(marks: DataFrame) -> DataFrame:
    """(path, block, line, model) of each step's beginning: the model named last before it."""
    w = Window.partitionBy("path").orderBy("block", "line")
    return marks.withColumn("model", F.last("model", ignorenulls=True).over(w)).filter("begins").drop("begins")


def wire_states(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, state, messages, interrupted, orphans) of each file: `ok` or `failed`, its messages, those whose calls had no result, results without a call."""
    shipping.ship(spark)
    left = _replayed(_told(_records(spark, path)))
    first = F.col("part") == 0
    return left.groupBy("path").agg(
        F.when(F.bool_or("failed"), "failed").otherwise("ok").alias("state"), F.count_if(first).alias("messages"),
        F.count_if(first & F.col("interrupted").isNotNull()).alias("interrupted"), F.count_if(first & (F.col("origin") == "orphan_result")).alias("orphans"),
    )
