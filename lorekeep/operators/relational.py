"""Joins, latest rows, paging, unions, upserts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order; end the order with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_value(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the row with the greatest order per key, by map-side combined aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), most))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same key."""
    return incoming.unionByName(stored.join(incoming.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def missing(stored: DataFrame, visible: DataFrame, keys: list[str], scope: DataFrame) -> DataFrame:
    """Stored rows not visible any more, under a scope that was scanned completely."""
    return stored.join(scope, scope.columns, "left_semi").join(visible.select(*keys), keys, "left_anti")


def backfill(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def reconcile(stored: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """What becomes of each item when a session is extracted again: (key, stored_id, action).

    Items match by a key that is unique on both sides; user-owned items stay as they are.
    """
    one = lambda df: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("owner").alias("owner"))
    s, e = one(stored).alias("s"), one(extracted.withColumn("owner", F.lit(None).cast("string"))).alias("e")
    j = s.join(e, F.col(f"s.{key}") == F.col(f"e.{key}"), "full")
    action = (
        F.when(F.col("s.n").isNull(), "insert")
        .when(F.col("e.n").isNull(), F.when(F.col("s.owner") == "user", "keep").otherwise("tombstone"))
        .when((F.col("s.n") > 1) | (F.col("e.n") > 1), "ambiguous")
        .when(F.col("s.owner") == "user", "keep")
        .otherwise("update")
    )
    return j.select(F.coalesce(f"s.{key}", f"e.{key}").alias(key), F.col("s.id").alias("stored_id"), action.alias("action"))


def conflict(local: Column, synced: Column, remote: Column) -> Column:
    """What to do with a document from its local, last synced and remote hashes."""
    return (
        F.when(remote.isNull(), "create")
        .when(local == remote, "unchanged")
        .when(synced.isNull(), "conflict")
        .when(remote == synced, "push")
        .when(local == synced, "pull")
        .otherwise("conflict")
    )


def file_change(size: Column, mtime: Column, digest: Column, parser: Column, old_size: Column, old_mtime: Column, old_digest: Column, old_parser: Column) -> Column:
    """new, modified, truncated or unchanged: another parser reads a file again, equal size and time or an equal digest don't."""
    return (
        F.when(old_size.isNull(), "new")
        .when(~parser.eqNullSafe(old_parser), "modified")
        .when(size < old_size, "truncated")
        .when((size == old_size) & mtime.eqNullSafe(old_mtime), "unchanged")
        .when(F.coalesce(digest == old_digest, F.lit(False)), "unchanged")
        .otherwise("modified")
    )


def fill_budget(items: Column, budget: int, size=lambda x: F.length(x)) -> Column:
    """The items of an ordered array that fit a budget one after another; what does not fit is skipped."""
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, 1, 0).alias("kept"))

    def step(s, x):
        fits = s.used + size(x) <= budget
        return F.struct(F.when(fits, s.used + size(x)).otherwise(s.used).cast("long").alias("used"), F.when(fits, F.concat(s.kept, F.array(x))).otherwise(s.kept).alias("kept"))

    return F.aggregate(items, begin, step).kept
