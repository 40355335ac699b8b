"""Tables of SQLite files, read in parallel by ranges of rowid.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").schema(...).option("path", p).option("table", t).load()

The file must be at the same path on every executor.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.columns = schema.names

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        con.close()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        con = self._open()
        yield from con.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
        con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)


def table(spark: SparkSession, path: str, name: str, schema: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).options(path=path, table=name, partitions=partitions).load()


def parts_messages(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of a session/message/part store, the texts of a message's parts in order of time.

    A tool part counts as `tool: input` and, on a new line, its output.
    """
    p = parts.withColumn("d", F.from_json("data", "type string, text string, tool string, state struct<input: string, output: string>"))
    line = F.when(F.col("d.type") == "tool", F.concat_ws("\n", F.concat_ws(": ", "d.tool", "d.state.input"), "d.state.output")).otherwise(F.col("d.text"))
    texts = p.filter(line.isNotNull()).groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "id", line.alias("l")))), lambda x: x.l), "\n").alias("text"))
    m = messages.withColumn("d", F.from_json("data", "role string, modelID string"))
    return m.join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id").join(texts, m.id == texts.message_id, "left").select(
        "session_id", "title", m.id.alias("id"), F.col("d.role").alias("role"), F.col("d.modelID").alias("model"), F.timestamp_millis(m.time_created).alias("ts"), F.coalesce("text", F.lit("")).alias("text")
    )


def keyed(kv: DataFrame, prefix: str, most_bytes: int = 8 << 20) -> DataFrame:
    """(id, value) of a key-value store's keys `prefix:id`, without values above the size that the reader takes."""
    return kv.filter(F.col("key").startswith(prefix + ":") & (F.octet_length("value") <= most_bytes)).select(F.substr("key", F.lit(len(prefix) + 2)).alias("id"), "value")
