"""Listings, scopes, audits, reviews and merges of a knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of feedback that keep an item out of a review, and the categories of its three parts.
REJECTED = ("incorrect", "outdated")
BUCKETS = {"decision": "decisions", "bug": "problems", "fix": "problems", "problem": "problems"}


def optional_filters(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality on every column whose wanted value is set; None and the empty string ask for nothing."""
    given = [F.col(c) == F.lit(v) for c, v in wanted.items() if v not in (None, "")]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def listing(df: DataFrame, wanted: dict[str, object], order: list[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """A page of the rows that pass the filters, each with the total under the same filters."""
    rows = optional_filters(df, wanted)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), most)).crossJoin(F.broadcast(total))


def without_pairs(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys together are not among the excluded ones; rows with a null key stay."""
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def having_any(df: DataFrame, key: str, others: dict[str, DataFrame]) -> DataFrame:
    """df with a flag per other table that tells whether it has a row of the key: EXISTS conditions, to be combined at will."""
    for name, other in others.items():
        df = df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def claimable(jobs: DataFrame, session: str, status: str, waiting: str, running: str) -> DataFrame:
    """Waiting jobs of sessions that have no running job."""
    busy = jobs.filter(F.col(status) == running).select(session).distinct()
    return jobs.filter(F.col(status) == waiting).join(busy, session, "left_anti")


def under_scope(rows: DataFrame, path: str, scopes: DataFrame) -> DataFrame:
    """Rows whose path is one of scopes(path), or lies below one, at component boundaries.

    A path is looked up by all its own ancestors, so this is an equality join.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    keyed = rows.withColumn("_row", F.struct(*rows.columns)).select("_row", F.explode(ancestors).alias("_path"))
    hit = keyed.join(scopes.select(F.rtrim(scopes[scopes.columns[0]], F.lit("/")).alias("_path")).distinct(), "_path")
    return hit.select("_row").distinct().select("_row.*")


def truncated_history(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows per key, each with whether there were more: one row beyond is read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    read = df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most + 1)
    more = (F.max("nth").over(Window.partitionBy(*keys)) > most).alias("truncated")
    return read.select("*", more).filter(F.col("nth") <= most)


def changed(rows: DataFrame, state: DataFrame, key: str, same: list[str], ready: str = "ready") -> DataFrame:
    """Rows whose index state is missing, not ready, or differs in any of the columns of `same`."""
    known = state.select(F.col(key).alias("_key"), "status", *[F.col(c).alias(f"_{c}") for c in same])
    fresh = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]) & (F.col("status") == ready)
    return rows.join(known, F.col(key) == F.col("_key"), "left").filter(~F.coalesce(fresh, F.lit(False))).select(*rows.columns)


def error_results(messages: DataFrame, session: str, order: list[str], text: str, is_error: Column, most: int = 3, chars: int = 500) -> DataFrame:
    """The first `most` error results of each session, cut and prefixed."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = messages.filter(is_error).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    return rows.withColumn("excerpt", F.concat(F.lit("[error] "), F.substring(text, 1, chars)))


def work_review(items: DataFrame, feedback: DataFrame, first: str, last: str) -> DataFrame:
    """items(id, category, day, title) of the days from first to last without rejected ones, by bucket: n and the titles in order of day and id."""
    kept = items.join(feedback.filter(F.col("kind").isin(*REJECTED)).select("id"), "id", "left_anti").filter(F.col("day").between(first, last))
    bucket = F.lit("knowledge")
    for category, name in BUCKETS.items():
        bucket = F.when(F.col("category") == category, name).otherwise(bucket)
    return kept.select("id", "day", "title", bucket.alias("bucket"))


def relation_scope(edges: DataFrame, items: DataFrame) -> DataFrame:
    """edges(source_id, target_id) with why they are admissible: the same verified project, session or label; else `reject`.

    items(id, project, session, label), any of which may be null; a project counts on both ends or on none.
    """
    a, b = (items.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "project", "session", "label")]) for s in ("a", "b"))
    rows = edges.join(a, F.col("source_id") == F.col("a_id"), "left").join(b, F.col("target_id") == F.col("b_id"), "left")
    both = F.col("a_project").isNotNull() & F.col("b_project").isNotNull()
    mixed = F.col("a_project").isNotNull() != F.col("b_project").isNotNull()
    why = (
        F.when(F.col("a_id").isNull() | F.col("b_id").isNull() | (F.col("source_id") == F.col("target_id")), "reject")
        .when(both, F.when(F.col("a_project") == F.col("b_project"), "project").otherwise("reject"))
        .when(mixed, "reject")
        .when(F.col("a_session") == F.col("b_session"), "session")
        .when(F.col("a_label") == F.col("b_label"), "label")
        .otherwise("reject")
    )
    return rows.select("source_id", "target_id", why.alias("scope"))


def organisation_scope(sources: DataFrame, group: str, most: int = 5) -> DataFrame:
    """sources(group, source_id, project): whether a group may be organised: 1 to `most` sources, all of one project."""
    rows = sources.groupBy(group).agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("project").alias("n_projects"), F.count_if(F.col("project").isNull()).alias("n_unresolved"))
    state = F.when(F.col("n_sources") > most, "too many").when((F.col("n_projects") == 1) & (F.col("n_unresolved") == 0), "ok").otherwise("mixed")
    return rows.select(group, "n_sources", state.alias("state"))


def revise(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(draft_id, base_revision) against drafts(draft_id, revision): the next revision, or a conflict if the base is not the newest."""
    newest = drafts.groupBy("draft_id").agg(F.max("revision").alias("newest"))
    rows = edits.join(newest, "draft_id", "left")
    ok = F.col("base_revision") == F.coalesce("newest", F.lit(0))
    return rows.select("draft_id", F.when(ok, F.col("base_revision") + 1).alias("revision"), F.when(ok, "saved").otherwise("conflict").alias("state"))


def merged(items: DataFrame, keys: list[str], order: list[str], scalars: list[str], lists: list[str], most: list[str], content: str) -> DataFrame:
    """Items of one key as one: the first one's scalars, its lists' entries in the order in which they first appear, the maxima of `most`, the distinct contents.

    Contents and entries are made distinct by shuffles of their own before a key's rows meet.
    """
    first = items.groupBy(*keys).agg(F.min_by(F.struct(*scalars), F.struct(*order)).alias("_s"), *[F.max(c).alias(c) for c in most], F.count(F.lit(1)).alias("n_items"))
    out = first.select(*keys, "_s.*", *most, "n_items")
    for c in [*lists, content]:
        each = items.select(*keys, *order, F.posexplode(c).alias("_p", "_x")) if c in lists else items.select(*keys, *order, F.lit(0).alias("_p"), F.col(c).alias("_x"))
        once = each.groupBy(*keys, "_x").agg(F.min(F.struct(*order, "_p")).alias("_o"))
        col = once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_x"))), lambda s: s["_x"]).alias(c))
        out = out.join(col, keys, "left")
    return out
