"""Roll-ups, listings, queues and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .base import query

LONG = "long"


@query("""
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
       CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first_turn, max(turn) AS last_turn,
       arg_min(substr(text, 1, 120), turn) FILTER (role = 'user' AND trim(text) <> '') AS title
FROM conversations GROUP BY conv_id""")
def session_rollup(read):
    asked = (F.col("role") == "user") & (F.trim("text") != "")
    return read("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length("text")).alias("n_chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.min_by(F.when(asked, F.substring("text", 1, 120)), F.when(asked, F.col("turn"))).alias("title"),
    )


@query("""
SELECT source, count(*) AS n_docs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, max(n_chars) AS longest,
       arg_min(doc_id, struct_pack(a := -n_chars, b := doc_id)) AS representative
FROM documents GROUP BY source""")
def project_rollup(read):
    return read("documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.max("n_chars").alias("longest"),
        F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("representative"),
    )


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event_per_user(read):
    return R.latest_value(read("events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


JOB_SQL = """
SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderstatus FROM customer c LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o
ON o.o_custkey = c.c_custkey"""


@query(JOB_SQL)
def latest_job_left_join(read):
    last = R.latest_value(read("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    c = read("customer").select("c_custkey", "c_mktsegment")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderstatus")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def excluded_anti_join(read):
    return read("documents").select("doc_id", "lang", "source").join(read("labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10)
AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def missing_sessions(read):
    docs = read("documents").select("doc_id", "source")
    scope = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("source")
    return R.missing(docs, read("labels"), ["doc_id"], scope).select("doc_id", "source")


@query("""
WITH j AS (SELECT * FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1)
SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS n_overdrawn
FROM j GROUP BY 1""")
def task_center_stats(read):
    orders = read("orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    jobs = orders.join(newest, ["o_custkey", "o_orderdate"])
    poor = read("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("poor"))
    return jobs.join(poor, "o_custkey", "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if("poor").alias("n_overdrawn"))


@query(f"""
WITH j AS ({JOB_SQL})
SELECT c_custkey, n_name, CASE WHEN o_orderstatus IS NULL THEN 'never' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state
FROM j JOIN customer USING (c_custkey) LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 4
WHERE contains(lower(j.c_mktsegment), 'build') ORDER BY o_orderkey DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20""")
def task_center_page(read):
    jobs = latest_job_left_join(read).filter(F.lower("c_mktsegment").contains("build"))
    nation = read("nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = jobs.join(read("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nation, "c_nationkey", "left")
    state = F.when(F.col("o_orderstatus").isNull(), "never").when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    return R.page(rows.select("c_custkey", "n_name", state.alias("state"), "o_orderkey"), [F.desc_nulls_last("o_orderkey"), F.asc("c_custkey")], 20, 20).select("c_custkey", "n_name", "state")


@query("""
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN quality = 1 THEN 'synced' ELSE 'failed' END AS status FROM labels
  UNION ALL SELECT 'pending' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY status""")
def migration_stats(read):
    done = read("labels").select("doc_id", F.when(F.col("quality") == 1, "synced").otherwise("failed").alias("status"))
    todo = R.backfill(read("documents").select("doc_id"), done, ["doc_id"]).withColumn("status", F.lit("pending"))
    return done.unionByName(todo).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def document_ids_union(read):
    return read("documents").filter("lang = 'en'").select("doc_id").union(read("labels").select("doc_id")).distinct()


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (value > 50) AS n_high, round(sum(value), 4) AS total
FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 8""")
def usage_by_type_top8(read):
    rows = read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.sum("value"), 4).alias("total"))
    return rows.orderBy(F.desc("n"), "event_type").limit(8)


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY event_type""")
def latency_percentiles(read):
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return read("events").groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("value").alias("worst"))


@query("""
SELECT count(*) AS n_items, count(e.vec_id) AS n_embedded, CAST(sum(CASE WHEN e.vec_id IS NOT NULL AND len(e.embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def index_audit(read):
    e = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("width"))
    rows = read("documents").select("doc_id").join(e, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_items"), F.count("width").alias("n_embedded"), F.sum(F.when(F.col("width") != 64, 1).otherwise(0)).alias("n_bad"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def backfill_missing_embeddings(read):
    return R.backfill(read("documents").select("doc_id"), read("embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("""
SELECT t.topic, count(d.doc_id) AS n FROM (VALUES ('en', 'english'), ('fr', 'romance'), ('es', 'romance'), ('de', 'german'), ('ja', 'other')) t(lang, topic)
LEFT JOIN documents d ON d.lang = t.lang GROUP BY t.topic""")
def topic_counts(read):
    counts = read("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    topics = F.explode(F.create_map(*[F.lit(x) for x in ("en", "english", "fr", "romance", "es", "romance", "de", "german", "ja", "other")]))
    fixed = counts.sparkSession.range(1).select(topics.alias("lang", "topic"))
    return fixed.join(counts, "lang", "left").groupBy("topic").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


FEEDBACK_SQL = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'useful' ELSE 'needs_detail' END AS kind FROM labels"


def feedback(read):
    return read("labels").select("doc_id", F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "useful").otherwise("needs_detail").alias("kind"))


@query(f"""
SELECT count(*) FILTER (kind = 'useful') AS useful, count(*) FILTER (kind = 'incorrect') AS incorrect, count(*) FILTER (kind = 'needs_detail') AS needs_detail, count(*) AS total
FROM ({FEEDBACK_SQL})""")
def quality_counts(read):
    kinds = ("useful", "incorrect", "needs_detail")
    return feedback(read).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


@query(f"""
SELECT doc_id, reason FROM (
  SELECT doc_id, kind AS reason FROM ({FEEDBACK_SQL}) WHERE kind <> 'useful'
  UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 100) ORDER BY doc_id DESC, reason LIMIT 100""")
def review_queue(read):
    flagged = feedback(read).filter("kind <> 'useful'").select("doc_id", F.col("kind").alias("reason"))
    short = read("documents").filter("n_chars < 100").select("doc_id", F.lit("short").alias("reason"))
    return flagged.unionByName(short).orderBy(F.desc("doc_id"), "reason").limit(100)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, max(event_id) AS last_event FROM events GROUP BY 1")
def update_timeline(read):
    return read("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.max("event_id").alias("last_event"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 3 AS a, CAST(l_partkey AS BIGINT) % 3 AS b, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN c IS NULL THEN 'create' WHEN a = c THEN 'unchanged' WHEN c = b THEN 'push' WHEN a = b THEN 'pull' ELSE 'conflict' END AS decision FROM h""")
def conflict_decision(read):
    local, synced = F.col("l_quantity").cast(LONG) % 3, F.col("l_partkey") % 3
    remote = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 3)
    return read("lineitem").select("l_orderkey", "l_linenumber", R.conflict(local, synced, remote).alias("decision"))


@query("""
WITH s AS (SELECT n_name || '#' || (c_custkey % 7) AS k, c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'user' ELSE 'pipeline' END AS owner FROM customer JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT n_name || '#' || (s_suppkey % 9) AS k, s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey),
s2 AS (SELECT k, count(*) AS n, min(id) AS id, min(owner) AS owner FROM s GROUP BY k), e2 AS (SELECT k, count(*) AS n FROM e GROUP BY k)
SELECT coalesce(s2.k, e2.k) AS k, s2.id AS stored_id, CASE WHEN s2.n IS NULL THEN 'insert' WHEN e2.n IS NULL THEN (CASE WHEN s2.owner = 'user' THEN 'keep' ELSE 'tombstone' END)
  WHEN s2.n > 1 OR e2.n > 1 THEN 'ambiguous' WHEN s2.owner = 'user' THEN 'keep' ELSE 'update' END AS action
FROM s2 FULL JOIN e2 ON s2.k = e2.k""")
def knowledge_reconcile(read):
    nation = read("nation").select("n_nationkey", "n_name")
    name = lambda i, m: F.concat("n_name", F.lit("#"), (F.col(i) % m).cast("string"))
    s = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c_custkey", 7).alias("k"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "user").otherwise("pipeline").alias("owner"))
    e = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s_suppkey", 9).alias("k"), F.col("s_suppkey").alias("id"))
    return R.reconcile(s, e, "k")


@query("""
SELECT c_custkey AS id, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_items(read):
    return R.upsert(read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("""
SELECT s_suppkey, count(*) AS n_edges, count(*) FILTER (sn.n_regionkey = cn.n_regionkey) AS n_same_region
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY s_suppkey""")
def edge_scopes(read):
    nation = read("nation").select("n_nationkey", "n_regionkey")
    end = lambda df, key, out: df.join(nation, F.col(key) == F.col("n_nationkey")).withColumnRenamed("n_regionkey", out).drop("n_nationkey", key)
    c = end(read("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_region")
    s = end(read("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_region")
    edges = read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = edges.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("c_region") == F.col("s_region")).alias("n_same_region"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation,
       coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), CAST(o_orderdate AS DATE)), -1) AS days_since
FROM orders""")
def job_generations(read):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast(LONG).alias("generation"), F.coalesce(F.date_diff(F.to_date("o_orderdate"), F.lag(F.to_date("o_orderdate")).over(w)), F.lit(-1)).cast(LONG).alias("days_since"))
