"""Secrets in texts, told from widely copied examples by who owns their copies.

Three patterns give the base findings.  Other long tokens of letters and digits are
candidates: every candidate and every base finding is hashed, and the hashes are counted
over the whole corpus by distinct repository and owner.  What many owners or repositories
hold is an example that was copied; what few hold is live if it also looks so: enough
different characters, and neither the words nor the runs of placeholders.  A candidate
becomes a finding (kind `owned`) only if it is live; base findings always stay, marked live
or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .spans import matches

KEYWORD = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base patterns in the order of their kinds; the last two are those of shorter runs with the length built in, which finds the same runs.
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}"))
#: A candidate is a run of 24 or more that no other such character borders; it has to have a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+"
#: Placeholders: words that stand in examples, a character five times in a row, and the keyboard's and the alphabet's runs.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?(key|token|secret|pass)|insert|redacted|lorem|foobar|deadbeef|(.)\2{4}|01234567|12345678|87654321|abcdefgh|qwertyui|asdfghjk"
KINDS = ("assign", "access", "hex", "owned")


def looks_live(value: Column) -> Column:
    """Eight different characters or more, a third of its length or more where it is short, and no placeholder."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(8), F.ceil(F.length(value) / 3))) & ~value.rlike(PLACEHOLDER)


def _kind(text: Column, kind: str, pattern: str) -> Column:
    found = matches(text, pattern)
    if kind == "owned":
        found = F.filter(found, lambda m: m.match.rlike("[0-9]") & m.match.rlike("[A-Za-z]"))
    value = lambda m: F.regexp_extract(m.match, pattern, 2) if kind == "assign" else m.match
    valued = F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), m.end.alias("end"), F.sha2(value(m), 256).alias("hash"), F.length(value(m)).alias("size"), looks_live(value(m)).alias("looks")))
    return F.filter(valued, lambda m: m["size"] >= 8) if kind == "assign" else valued


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.k], s.start.cast("string"), s.end.cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", few: int = 2, few_repos: int = 8) -> DataFrame:
    """One row per row of docs: id, base and found: arrays of (start, k, end, hash, live, owners, repos), ordered by start and kind.

    k numbers KINDS.  owners and repos count who holds the value anywhere and in how many
    repositories; live: at most `few` owners hold it, in at most `few_repos` repositories, and it
    looks live.  A null repository or owner counts as one of its own.  Null texts are empty; very
    long texts are read whole; repeated rows are rows of their own; an empty table gives an empty
    table; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("t"))
    base = F.concat(*[_kind(F.col("t"), k, p) for k, p in BASE])
    extra = _kind(F.col("t"), "owned", CANDIDATE)
    outside = lambda e, spans: ~F.exists(spans, lambda b: (b.start < e.end) & (e.start < b.end))
    rows = rows.select("id", "repo", "owner", base.alias("base"), extra.alias("extra"))
    rows = rows.select("id", "repo", "owner", "base", F.filter("extra", lambda e: outside(e, F.col("base"))).alias("extra"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "findings")
    some = rows.filter("size(base) + size(extra) > 0").select("row", "repo", "owner", F.explode(F.concat("base", "extra")).alias("s"))
    held = some.groupBy(F.col("s.hash").alias("hash"), F.coalesce("repo", F.lit("\u0000")).alias("repo"), F.coalesce("owner", F.lit("\u0000")).alias("owner")).agg(F.count(F.lit(1)).alias("places"))
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("places").alias("places")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("places").alias("places"))
    owners = scratch.table(owners, "owners")
    # values of more than a 20 000th of all places, so fewer than 20 000 of them, are broadcast: no task gets all places of one
    often = F.col("places") > max(1000, (owners.agg(F.sum("places")).first()[0] or 0) // 20_000)
    hot, rest = F.broadcast(owners.filter(often)), owners.filter(~often)
    named = some.withColumn("hash", F.col("s.hash"))
    told = named.join(hot, "hash").unionByName(named.join(hot.select("hash"), "hash", "left_anti").join(rest, "hash"))
    live = (F.col("owners") <= few) & (F.col("repos") <= few_repos) & F.col("s.looks")
    told = told.select("row", F.struct(F.col("s.start").alias("start"), F.col("s.k").alias("k"), F.col("s.end").alias("end"), "hash", live.alias("live"), "owners", "repos").alias("s"))
    spans = told.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = rows.select("row", "id").join(spans, "row", "left")
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint,hash:string,live:boolean,owners:bigint,repos:bigint>>")
    out = out.withColumn("spans", F.coalesce("spans", none))
    return out.select(F.col("id").alias(id_col), F.filter("spans", lambda s: s.k < 3).alias("base"), F.filter("spans", lambda s: (s.k < 3) | s.live).alias("found"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), repo_col="doc_id")
    held = F.transform("found", lambda s: F.concat_ws(":", s.owners.cast("string"), s.repos.cast("string")))
    count = lambda k: F.size(F.filter("base", lambda s: s.k == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s.live)).cast("long").alias("n_live"),
        F.array_join(held, ",").alias("owners_repos"),
    )
