"""Archives, rendered documents, retention and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_archive(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Compressed JSON lines, foldered by the columns of `by`."""
    out = rows.write.mode("overwrite").option("compression", "gzip")
    (out.partitionBy(*by) if by else out).json(path)


def read_archive(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def session_markdown(messages: DataFrame, redact=lambda text: text) -> DataFrame:
    """(session_id, markdown) of messages(session_id, ordinal, role, text): a title line, then a heading per message; redacted last."""
    turn = F.struct("ordinal", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(turn)), lambda p: p.part)
    body = F.concat(F.lit("# Session "), F.coalesce(F.col("session_id").cast("string"), F.lit("")), F.lit("\n\n"), F.array_join("_parts", "\n\n"), F.lit("\n"))
    return messages.groupBy("session_id").agg(parts.alias("_parts")).select("session_id", redact(body).alias("markdown"))


def item_markdown(title: Column, summary: Column, content: Column, lists: dict[str, Column]) -> Column:
    """A knowledge item as a document: summary as a quote, content, then each list that has entries under its heading."""
    sections = [F.when(F.size(v) > 0, F.concat(F.lit(f"## {name}\n\n- "), F.array_join(v, "\n- "))) for name, v in lists.items()]
    quote = F.when(F.trim(summary) != "", F.concat(F.lit("> "), F.replace(F.trim(summary), F.lit("\n"), F.lit("\n> "))))
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), quote, content, *sections), F.lit("\n"))


def newest(rows: DataFrame, order: list[Column], keep: int = 2000) -> DataFrame:
    """A cache cut to its newest rows; end the order with a unique column."""
    return rows.orderBy(*order).limit(keep)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose column keys[name] is among the single column of `gone`; null keys stay."""
    ids = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    return {name: t.join(ids, t[keys[name]] == ids["_gone"], "left_anti") for name, t in tables.items()}
