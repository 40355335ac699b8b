"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so (after the first punctuation mark or
digit that follows `min_chars` characters, at `max_chars` at the latest), so equal
texts are cut alike.  Every distinct chunk is moved once, to verify that no two
different chunks share an identifier; after that a document is represented by its
recipe, the ordered list of its chunks' identifiers, and only recipes are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WHITE = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(norm: Column, min_chars: int = 1024, max_chars: int = 8192) -> Column:
    """The chunks of a normalised text, in order; concatenated they are the text."""
    cut = rf"(?s).{{{min_chars},{max_chars}}}?(?<=[\p{{P}}\p{{Nd}}])|.{{{max_chars}}}|.+"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def sha256_identifier(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifier: Callable[[Column], Column] = sha256_identifier) -> DataFrame:
    """(id, chars, text_sha256, recipe) of each row.

    If two different chunks ever share an identifier, the chunks themselves stand in the recipes.
    """
    norm = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("chars"), normalise(F.col(text_col)).alias("norm"))
    each = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identifier(F.col("chunk")).alias("chunk_id"), "chunk")
    clash = each.distinct().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    name = identifier if clash.isEmpty() else (lambda c: F.encode(c, "UTF-8"))
    return norm.select("id", "chars", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), name).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifier: Callable[[Column], Column] = sha256_identifier) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most characters before normalising stays, then the
    smallest id; null ids come last.  Null and empty texts, and those of white space only,
    are equal to each other.  Rows that repeat the kept id count in group_size and are all
    marked kept: a document is its id.  An empty table gives an empty table; other columns
    of the input are ignored, whatever their names.
    """
    rows = scratch.table(recipes(docs, id_col, text_col, identifier), "recipes")
    order = F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    groups = groups.filter("n > 1").select(F.col("recipe").alias("of"), "n", F.col("first.c").alias("first_id"))
    # a hot recipe has one row in groups: the skew-join rule of adaptive execution splits its other side
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return rows.join(groups, rows.recipe == groups.of, "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
