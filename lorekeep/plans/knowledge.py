"""Scopes, audits, reviews, histories and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge as K
from ..operators import relational as R
from .base import query


@query("""
SELECT e.vec_id, d.source, l.quality, c.n_turns FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 JOIN (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id""")
def ready_embeddings(read):
    """Vectors of sessions whose index is ready: a 4-way join with a status gate."""
    turns = read("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_turns"))
    ready = read("labels").filter("quality = 1").select("doc_id", "quality")
    return read("embeddings").select(F.col("vec_id").alias("doc_id")).join(read("documents").select("doc_id", "source"), "doc_id").join(ready, "doc_id").join(turns, "doc_id").withColumnRenamed("doc_id", "vec_id")


CLAIMABLE_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders o WHERE o_orderstatus = 'O'
AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'P')"""


@query(f"SELECT o_orderkey, o_custkey FROM ({CLAIMABLE_SQL})")
def claimable_jobs(read):
    return K.claimable(read("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "O", "P").select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM ({CLAIMABLE_SQL}) ORDER BY o_orderdate, o_orderkey LIMIT 1")
def queue_head(read):
    """The oldest job that may be claimed."""
    jobs = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return K.claimable(jobs, "o_custkey", "o_orderstatus", "O", "P").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_custkey")


@query("""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l ON l.doc_id = x.doc_id AND l.toxic = 1 WHERE x.source = d.source AND x.lang = d.lang)""")
def excluded_pairs(read):
    """Documents whose (source, language) has no toxic document: an anti join on a composite key."""
    docs = read("documents").select("doc_id", "source", "lang")
    toxic = docs.join(read("labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return K.without_pairs(docs, toxic, ["source", "lang"]).select("doc_id")


@query("""
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def either_exists(read):
    """Customers with a pending or with a large order: EXISTS conditions joined by OR."""
    orders = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    rows = K.having_any(read("customer").select("c_custkey"), "c_custkey", {"pending": orders.filter("o_orderstatus = 'P'"), "large": orders.filter("o_totalprice > 450000")})
    return rows.filter("pending or large").select("c_custkey")


@query("""
SELECT o_orderkey, l_linenumber, coalesce(p_name, 'deleted') AS name, coalesce(p_size, 0) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey WHERE o_orderstatus = 'P'""")
def audit_trail(read):
    """An audit's sources over a bridge table; sources that are gone have tombstone values."""
    active = read("part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    rows = read("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")).join(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").join(active, "l_partkey", "left")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.coalesce("p_name", F.lit("deleted")).alias("name"), F.coalesce("p_size", F.lit(0)).alias("size"))


@query("""
SELECT coalesce(b.path, d.source) AS path, count(*) AS n FROM documents d
LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'quarantine' WHEN quality = 0 THEN 'review' END AS path FROM labels) b ON b.doc_id = d.doc_id GROUP BY 1""")
def bound_projects(read):
    """Documents by project path, where a binding overrides the document's own."""
    bound = read("labels").select("doc_id", F.when(F.col("toxic") == 1, "quarantine").when(F.col("quality") == 0, "review").alias("path"))
    return read("documents").select("doc_id", "source").join(bound, "doc_id", "left").groupBy(F.coalesce("path", "source").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
s AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]+', 0) AS path FROM pages WHERE url LIKE 'https:%')
SELECT page_id FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.path <> '' AND (p.path = s.path OR starts_with(p.path, s.path || '/')))
AND page_id NOT IN (SELECT page_id FROM pages WHERE contains(html, '<script'))""")
def missing_under_scope(read):
    """Stored pages below a covered path that are not visible any more."""
    pages = read("pages").select("page_id", "url")
    scopes = pages.filter("url like 'https:%'").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/[a-z]+", 0).alias("path")).filter("path <> ''")
    visible = read("pages").filter(F.col("html").contains("<script")).select("page_id")
    return K.under_scope(pages.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path")), "path", scopes).join(visible, "page_id", "left_anti").select("page_id")


@query("SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def filtered_listing(read):
    """A page of a listing with optional filters, two of which are set, and its total."""
    rows = read("documents").select("doc_id", "n_chars", "lang", "source")
    return K.listing(rows, {"lang": "en", "source": "src1", "doc_id": None}, [F.desc("n_chars"), F.asc("doc_id")], 10, 5).select("doc_id", "n_chars", "total")


@query("""
SELECT CASE WHEN starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '2-') THEN 'failed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS class, count(*) AS n
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' GROUP BY 1""")
def status_classes(read):
    """Orders of a date window by class of status: prefixes and disjunctions."""
    p = F.col("o_orderpriority")
    kind = F.when(p.startswith("1-") | p.startswith("2-"), "failed").when(F.col("o_orderstatus") == "O", "open").otherwise("done")
    return read("orders").filter("to_date(o_orderdate) between date'1996-01-01' and date'1997-06-30'").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id, turn, nth, sha256('[error] ' || substr(text, 1, 500)) AS excerpt_sha FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'assistant' AND contains(text, 'er')) WHERE nth <= 3""")
def error_excerpts(read):
    """At most three error results of a session, 500 characters of each."""
    rows = K.error_results(read("conversations"), "conv_id", ["turn"], "text", (F.col("role") == "assistant") & F.col("text").contains("er"))
    return rows.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), F.sha2("excerpt", 256).alias("excerpt_sha"))


@query("""
SELECT c_custkey, greatest(coalesce(o.t, TIMESTAMP '1970-01-01'), coalesce(l.t, TIMESTAMP '1970-01-01')) AS updated FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, max(l_shipdate) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey""")
def last_update(read):
    """The later of two times that may both be missing."""
    orders = read("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    asked = orders.groupBy("c_custkey").agg(F.max("o_orderdate").alias("a"))
    sent = orders.join(read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey").groupBy("c_custkey").agg(F.max("l_shipdate").alias("b"))
    never = F.lit("1970-01-01").cast("timestamp_ntz")
    return read("customer").select("c_custkey").join(asked, "c_custkey", "left").join(sent, "c_custkey", "left").select("c_custkey", F.greatest(F.coalesce("a", never), F.coalesce("b", never)).alias("updated"))


@query("""
SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM conversations WHERE conv_id = doc_id) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)""")
def eligible_sessions(read):
    """Sessions that may run again: a semi join and two anti joins."""
    done = read("labels")
    rows = read("documents").select("doc_id").join(read("conversations").select(F.col("conv_id").alias("doc_id")), "doc_id", "left_semi")
    return rows.join(done.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti").join(done.filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT user_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END), 0)::BIGINT AS input_tokens, count(*) AS n,
       sum(CASE WHEN event_type = 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END)::BIGINT AS cache_tokens FROM events GROUP BY user_id""")
def usage_totals(read):
    """Token sums per key: input counts nothing as 0, cache counters stay null until one is seen."""
    k = F.get_json_object("props", "$.k").cast("long")
    error = F.col("event_type") == "error"
    return read("events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(~error, k)), F.lit(0)).alias("input_tokens"), F.count(F.lit(1)).alias("n"), F.sum(F.when(error, k)).alias("cache_tokens"))


@query("""
WITH t AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END AS source, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done,
       quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM t GROUP BY 1""")
def task_diagnostics(read):
    """The latest 200 tasks by allow-listed source, with nearest-rank percentiles; 200 is the report's size."""
    source = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority")).otherwise("other")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY o_totalprice)")
    latest = read("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    return latest.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


@query("""
SELECT CASE WHEN c IS NULL THEN 'create' WHEN a = c THEN 'unchanged' WHEN c = b THEN 'push' WHEN a = b THEN 'pull' ELSE 'conflict' END AS outcome, count(*) AS n FROM (
  SELECT CAST(l_quantity AS BIGINT) % 3 AS a, l_partkey % 3 AS b, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END AS c FROM lineitem) GROUP BY 1""")
def sync_outcomes(read):
    remote = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 3)
    outcome = R.conflict(F.col("l_quantity").cast("long") % 3, F.col("l_partkey") % 3, remote)
    return read("lineitem").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


TITLE = "lower(substr(string_split(text, chr(10))[1], 1, 24))"


@query(f"""
WITH i AS (SELECT *, lower(trim(lang)) AS category, regexp_replace({TITLE}, '[\\s:：\\-—_·。.]+', '', 'g') AS title FROM documents WHERE text IS NOT NULL),
t AS (SELECT category, title, word, min((doc_id, p)) AS o FROM (SELECT category, title, doc_id, unnest(tags) AS word, generate_subscripts(tags, 1) AS p FROM (SELECT *, string_split(source || ' ' || lang, ' ') AS tags FROM i)) GROUP BY ALL),
c AS (SELECT category, title, text, min(doc_id) AS o FROM i GROUP BY ALL)
SELECT f.category, f.title, f.doc_id, f.source, f.n_items, f.n_chars, g.tags, h.contents_sha
FROM (SELECT category, title, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n_items, max(n_chars) AS n_chars FROM i GROUP BY 1, 2) f
JOIN (SELECT category, title, string_agg(word, ',' ORDER BY o) AS tags FROM t GROUP BY 1, 2) g USING (category, title)
JOIN (SELECT category, title, sha256(string_agg(sha256(text), ',' ORDER BY o)) AS contents_sha FROM c GROUP BY 1, 2) h USING (category, title)""")
def merged_items(read):
    """Extracted items of one category and normalised title merged: first scalars, ordered union of tags, maxima, distinct whole contents."""
    title = T.title_key(F.substring(F.split("text", "\n")[0], 1, 24))
    items = read("documents").filter("text is not null").select("doc_id", "source", "n_chars", F.lower(F.trim("lang")).alias("category"), title.alias("title"), F.array("source", "lang").alias("tags"), F.sha2("text", 256).alias("content"))
    out = K.merged(items, ["category", "title"], ["doc_id"], ["doc_id", "source"], ["tags"], ["n_chars"], "content")
    return out.select("category", "title", "doc_id", "source", "n_items", "n_chars", F.array_join("tags", ",").alias("tags"), F.sha2(F.array_join("content", ","), 256).alias("contents_sha"))


LATEST_SQL = "SELECT user_id, event_type AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def latest_kind(read):
    return R.latest_value(read("events"), ["user_id"], ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "kind")


@query(f"SELECT kind, count(*) AS n FROM ({LATEST_SQL}) GROUP BY kind")
def latest_feedback(read):
    """The feedback that holds: each item's latest, by time and id."""
    return latest_kind(read).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS latency FROM events GROUP BY ALL")
def stage_latency(read):
    """The latest latency of each stage of a run."""
    return R.latest_value(read("events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"]).withColumnRenamed("value", "latency")


@query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def first_in_ranking(read):
    """Each entity where it first appears in a ranked list."""
    return R.latest(read("documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")]).drop("n_chars")


@query("""
SELECT o_custkey, o_orderkey, n AS nth, total > 5 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE n <= 5""")
def review_history(read):
    """The newest five of a history, with whether there were more."""
    rows = K.truncated_history(read("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return rows.select("o_custkey", "o_orderkey", F.col("nth").cast("long").alias("nth"), "truncated")


@query("""
SELECT corpus, id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY corpus, id) AS n FROM (
    SELECT 'documents' AS corpus, doc_id AS id, substr(text, 1, 40) AS title FROM documents UNION ALL SELECT 'sessions', conv_id, substr(text, 1, 40) FROM conversations WHERE turn = 0)) WHERE n = 1""")
def both_corpora(read):
    """Two corpora one after the other, each title where it first appears."""
    a = read("documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"))
    b = read("conversations").filter("turn = 0").select(F.lit("sessions").alias("corpus"), F.col("conv_id").alias("id"), F.substring("text", 1, 40).alias("title"))
    return R.latest(a.unionByName(b), ["title"], [F.asc("corpus"), F.asc("id")])


@query("""
SELECT source, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM (
  SELECT source, list_concat(array_agg(lang ORDER BY doc_id)[:20], array_agg(lang ORDER BY doc_id DESC)[:20]) AS l FROM documents GROUP BY source)""")
def ordered_union(read):
    """Two ordered lists joined, each entry where it first appears; 20 is the lists' length."""
    up, down = (Window.partitionBy("source").orderBy(o) for o in (F.asc("doc_id"), F.desc("doc_id")))
    docs = read("documents")
    first, last = (docs.select("source", "lang", F.row_number().over(w).alias("n")).filter("n <= 20").select("source", "lang", F.lit(k).alias("k"), "n") for k, w in enumerate((up, down)))
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("n", "lang")))), lambda s: s.lang)
    return first.unionByName(last).groupBy("source").agg(F.array_join(F.array_distinct(F.concat(part(0), part(1))), ",").alias("tags"))


@query("""
SELECT conv_id, turn, CAST(floor((n - 1) / 8) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system')""")
def fixed_chunks(read):
    """Eight messages to a chunk, system messages aside."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return read("conversations").filter("role <> 'system'").select("conv_id", "turn", F.floor((n - 1) / 8).alias("chunk"))


@query("""
SELECT d.doc_id FROM documents d LEFT JOIN (SELECT vec_id, label, len(embedding) AS dimensions, CASE WHEN label < 8 THEN 'ready' ELSE 'failed' END AS status FROM embeddings) s ON s.vec_id = d.doc_id
WHERE NOT coalesce(s.status = 'ready' AND s.dimensions = 64, false)""")
def index_skip(read):
    """Documents that have to be indexed again: not ready, of other dimensions, or unknown."""
    state = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimensions"), F.when(F.col("label") < 8, "ready").otherwise("failed").alias("status"))
    return K.changed(read("documents").select("doc_id", F.lit(64).alias("dimensions")), state, "doc_id", ["dimensions"]).select("doc_id")


@query("""
WITH i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fix' WHEN 'O' THEN 'decision' ELSE 'note' END AS category, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority AS title FROM orders)
SELECT CASE WHEN category IN ('bug', 'fix', 'problem') THEN 'problems' WHEN category = 'decision' THEN 'decisions' ELSE 'knowledge' END AS bucket, day, count(*) AS n,
       string_agg(title, ';' ORDER BY id) AS titles FROM i
WHERE day BETWEEN '1996-01-01' AND '1996-03-31' AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1, 2""")
def work_review(read):
    """What was done in a window of days, by bucket and day, without items whose feedback rejects them."""
    category = F.when(F.col("o_orderstatus") == "F", "fix").when(F.col("o_orderstatus") == "O", "decision").otherwise("note")
    items = read("orders").select(F.col("o_orderkey").alias("id"), category.alias("category"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderpriority").alias("title"))
    told = read("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("incorrect").alias("kind"))
    rows = K.work_review(items, told, "1996-01-01", "1996-03-31")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda s: s.title), ";")
    return rows.groupBy("bucket", "day").agg(F.count(F.lit(1)).alias("n"), titles.alias("titles"))


ITEMS_SQL = "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_nationkey % 3 END AS project, c_nationkey AS session, c_mktsegment AS label FROM customer"


@query(f"""
WITH i AS ({ITEMS_SQL}), e AS (SELECT DISTINCT o_custkey AS source_id, CAST(floor(o_totalprice) AS BIGINT) % 1600 AS target_id FROM orders)
SELECT source_id, target_id, CASE WHEN a.id IS NULL OR b.id IS NULL OR source_id = target_id THEN 'reject'
  WHEN a.project IS NOT NULL AND b.project IS NOT NULL THEN CASE WHEN a.project = b.project THEN 'project' ELSE 'reject' END
  WHEN (a.project IS NULL) <> (b.project IS NULL) THEN 'reject' WHEN a.session = b.session THEN 'session' WHEN a.label = b.label THEN 'label' ELSE 'reject' END AS scope
FROM e LEFT JOIN i a ON a.id = source_id LEFT JOIN i b ON b.id = target_id""")
def relation_scope(read):
    """Which relations are admissible, and by what they are."""
    items = read("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 3).alias("project"), F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("label"))
    edges = read("orders").select(F.col("o_custkey").alias("source_id"), (F.floor("o_totalprice") % 1600).alias("target_id")).distinct()
    return K.relation_scope(edges, items)


@query("""
SELECT l_orderkey, count(DISTINCT l_partkey) AS n_sources, CASE WHEN count(DISTINCT l_partkey) > 5 THEN 'too many' WHEN count(DISTINCT l_returnflag) = 1 THEN 'ok' ELSE 'mixed' END AS state
FROM lineitem GROUP BY 1""")
def organisation_scope(read):
    rows = read("lineitem").select("l_orderkey", F.col("l_partkey").alias("source_id"), F.col("l_returnflag").alias("project"))
    return K.organisation_scope(rows, "l_orderkey")


@query("""
WITH n AS (SELECT o_custkey AS draft_id, count(*) AS newest FROM orders GROUP BY 1)
SELECT c_custkey AS draft_id, CASE WHEN c_nationkey = coalesce(newest, 0) THEN c_nationkey + 1 END AS revision, CASE WHEN c_nationkey = coalesce(newest, 0) THEN 'saved' ELSE 'conflict' END AS state
FROM customer LEFT JOIN n ON n.draft_id = c_custkey""")
def draft_revisions(read):
    """Edits of drafts: saved on top of the newest revision only."""
    drafts = read("orders").select(F.col("o_custkey").alias("draft_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("revision"))
    return K.revise(drafts, read("customer").select(F.col("c_custkey").alias("draft_id"), F.col("c_nationkey").alias("base_revision")))


@query("""
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(n_parts, 0) AS n_parts FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey""")
def deletion_impact(read):
    """What would go with each session if it were deleted."""
    orders = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = orders.join(read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))
    counts = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    rows = read("customer").select("c_custkey").join(counts, "c_custkey", "left").join(lines, "c_custkey", "left")
    return rows.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orders", "n_lines", "n_parts")])


@query("""
SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE contains(lower(text), 'license') AND (l.toxic IS NULL OR l.toxic = 0)""")
def visible_hits(read):
    """Hits that are still in scope when they are read: a semi join against what is visible now."""
    docs = read("documents")
    hits = docs.filter(F.lower("text").contains("license")).select("doc_id", "n_chars")
    scope = docs.select("doc_id").join(read("labels").filter("toxic <> 0").select("doc_id"), "doc_id", "left_anti")
    return hits.join(scope, "doc_id", "left_semi")
