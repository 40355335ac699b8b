"""Volumes, differences, repairs, caches and deletion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions import documents as D
from ..operators import sinks as S
from .base import query


@query("SELECT doc_id, sha256(text) AS joined_sha, true AS all_fit FROM documents WHERE text IS NOT NULL")
def volume_round_trip(read):
    """Documents cut into volumes of at most 4096 bytes and put together again."""
    docs = read("documents")
    shipping.ship(docs.sparkSession)
    cut = docs.filter("text is not null").select("doc_id", D.volumes(F.col("text"), 4096).alias("v"))
    return cut.select("doc_id", F.sha2(F.array_join("v", ""), 256).alias("joined_sha"), F.forall("v", lambda x: F.octet_length(x) <= 4096).alias("all_fit"))


@query()
def turn_line_diff(read):
    """How many lines each turn keeps of, adds to and removes from the turn before."""
    turns = read("conversations")
    shipping.ship(turns.sparkSession)
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.withColumn("d", D.line_diff(before, F.col("text")))
    return rows.select("conv_id", "turn", *(F.col("d." + k).cast("int").alias("n_" + k) for k in ("same", "added", "removed")), "d.truncated", "d.identical")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS repaired FROM events")
def reply_repair(read):
    """JSON replies that broke off before their last bracket."""
    events = read("events")
    shipping.ship(events.sparkSession)
    reply = F.concat(F.lit("<think>{</think>```json\n"), F.substr("props", F.lit(1), F.length("props") - 1))
    rows = events.select("event_id", D.reply_json(F.regexp_replace(reply, "</think>", "</think>\n")).alias("r"))
    return rows.select("event_id", F.get_json_object("r.json", "$.k").cast("long").alias("k"), "r.repaired")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT text FROM benchmark)) AS n_cached FROM l GROUP BY doc_id""")
def content_cache(read):
    """Lines whose content key is in a cache of known passages."""
    lines = read("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("key", D.content_key(F.col("line")))
    known = read("benchmark").select(D.content_key(F.col("text")).alias("key")).distinct().withColumn("hit", F.lit(1))
    return lines.join(known, "key", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("hit").alias("n_cached"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def newest_cache_rows(read):
    return S.newest(read("events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 2000)


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS table_name, count(*) AS n_left FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)""")
def cascade_delete(read):
    gone = read("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    left = S.cascade_delete({"orders": read("orders"), "lineitem": read("lineitem")}, gone, {"orders": "o_orderkey", "lineitem": "l_orderkey"})
    counts = [t.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("table_name"), "n_left") for name, t in left.items()]
    return counts[0].unionAll(counts[1])
