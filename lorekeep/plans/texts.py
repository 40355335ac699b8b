"""Cleaning, redaction, chunking, fingerprints and rendering of the driver's texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions import text as T
from ..operators import chunks as K
from ..operators import containment, log_lines
from ..operators import relational as R
from .base import query


@query("""
SELECT conv_id, turn, role FROM conversations WHERE trim(text) <> '' AND NOT (role = 'assistant' AND strlen(trim(text)) < 50
  AND (starts_with(lower(trim(text)), 'let me') OR starts_with(lower(trim(text)), 'i''ll ') OR starts_with(lower(trim(text)), 'now ')))""")
def clean_messages(read):
    t = F.trim("text")
    low = F.lower(t)
    noise = (F.col("role") == "assistant") & (F.octet_length(t) < 50) & (low.startswith("let me") | low.startswith("i'll ") | low.startswith("now "))
    return read("conversations").filter((t != "") & ~noise).select("conv_id", "turn", "role")


@query("""
SELECT conv_id, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS n_chars FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''
GROUP BY conv_id HAVING count(*) >= 2 AND sum(length(trim(text))) >= 200""")
def meaningful_sessions(read):
    rows = read("conversations").filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.trim("text"))).alias("n_chars")).filter("n >= 2 and n_chars >= 200")


@query(f"SELECT doc_id, sha256({T.redact_sql('text')}) AS redacted_sha, {T.redact_sql('text')} <> text AS has_secrets FROM documents")
def redact_documents(read):
    each = F.transform(F.array(T.redact(F.col("text"))), lambda t: F.struct(F.sha2(t, 256).alias("redacted_sha"), (t != F.col("text")).alias("has_secrets")))[0]
    return read("documents").select("doc_id", F.explode(F.array(each)).alias("r")).select("doc_id", "r.*")


@query("""
WITH d AS (SELECT doc_id, text, CASE WHEN length(text) <= 2800 THEN 0 ELSE CAST(ceil((length(text) - 2800) / 2380.0) AS BIGINT) END AS last FROM documents WHERE trim(text) <> ''),
c AS (SELECT doc_id, text, unnest(range(last + 1)) AS i FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 2380 AS INTEGER) AS start, sha256(substr(text, i * 2380 + 1, 2800)) AS chunk_sha,
       greatest(CAST(ceil(length(substr(text, i * 2380 + 1, 2800)) / 3.5) AS BIGINT), 1) AS tokens FROM c""")
def embedding_chunks(read):
    rows = read("documents").select("doc_id", F.explode(T.sliding_chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.chunk_index", "c.start", F.sha2("c.chunk", 256).alias("chunk_sha"), T.token_estimate(F.col("c.chunk")).alias("tokens"))


@query("""
SELECT conv_id, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS fingerprint, count(*) AS n FROM conversations GROUP BY conv_id""")
def session_fingerprint(read):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("\x1f"), "text").alias("t"))))
    return read("conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p.t), "\x1e"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source, 'project:' || substr(sha256('path:' || lower(source)), 1, 24) AS project_id FROM documents")
def project_identity(read):
    return read("documents").select("source", F.concat(F.lit("project:"), F.substring(F.sha2(F.concat(F.lit("path:"), F.lower("source")), 256), 1, 24)).alias("project_id")).distinct()


@query("""
SELECT doc_id, source || '/' || lang || '/' || substr(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9 ]+', '_', 'g'), 1, 40) || '-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS path FROM documents""")
def document_path(read):
    title = F.substring(F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z0-9 ]+", "_"), 1, 40)
    tail = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)
    return read("documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), title, F.lit("-"), tail).alias("path"))


@query("""
SELECT conv_id, sha256('# Session ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS markdown_sha FROM conversations GROUP BY conv_id""")
def render_markdown(read):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("t"))))
    body = F.array_join(F.transform(parts, lambda p: p.t), "\n\n")
    return read("conversations").groupBy("conv_id").agg(body.alias("b")).select("conv_id", F.sha2(F.concat(F.lit("# Session "), F.col("conv_id").cast("string"), F.lit("\n"), "b"), 256).alias("markdown_sha"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
g AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g)
SELECT doc_id, count(DISTINCT run) AS n_runs, count(*) AS n_lines, max(n) AS longest_run FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r) GROUP BY doc_id""")
def log_compaction(read):
    """Runs of equal adjacent lines, folded within each text."""
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("longest"))

    def step(s, x):
        same = F.coalesce(s.last == x, F.lit(False))
        n = F.when(same, s.n + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), (s.runs + F.when(same, 0).otherwise(1)).alias("runs"), n.alias("n"), F.greatest(s.longest, n).alias("longest"))

    rows = read("documents").filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return rows.withColumn("r", F.aggregate("l", begin, step)).select("doc_id", F.col("r.runs").alias("n_runs"), F.size("l").cast("long").alias("n_lines"), F.col("r.longest").alias("longest_run"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '<script')) AS n_scripts, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_matches(url, '/share/[A-Za-z0-9-]+') AS is_share FROM pages""")
def page_scripts(read):
    return read("pages").select("page_id", F.regexp_count("html", F.lit("<script")).cast("long").alias("n_scripts"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"), F.col("url").rlike("/share/[A-Za-z0-9-]+").alias("is_share"))


@query("""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '\\[(\\d+)\\]', 1) AS n FROM documents)
SELECT doc_id, len(n) AS n_citations, len(list_filter(n, lambda x: try_cast(x AS BIGINT) BETWEEN 1 AND 5)) AS n_valid FROM c""")
def citation_audit(read):
    found = F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))
    return read("documents").select("doc_id", F.size(found).cast("long").alias("n_citations"), F.size(F.filter(found, lambda x: x.try_cast("bigint").between(1, 5))).cast("long").alias("n_valid"))


SHOWN_SQL = "'**' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' WHEN 'tool' THEN '工具' END || '**: ' || text"


def _chunks_sql(tokens: int, most: int) -> str:
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, length({SHOWN_SQL}) AS c FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND text <> ''),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(greatest(ceil(c / 3.5), 1) AS BIGINT) AS k FROM t),
f AS (SELECT conv_id, turn, i, 0::BIGINT AS chunk, CASE WHEN k > {tokens} THEN 0 ELSE k END AS used, CASE WHEN k > {tokens} THEN 0 ELSE 1 END AS n, CASE WHEN k > {tokens} THEN CAST(ceil(c / {int(tokens * 3.5)}.0) AS BIGINT) ELSE 0 END AS pieces FROM m WHERE i = 1
  UNION ALL SELECT m.conv_id, m.turn, m.i,
    CASE WHEN f.pieces > 0 THEN f.chunk + f.pieces WHEN m.k > {tokens} THEN f.chunk + CASE WHEN f.n > 0 THEN 1 ELSE 0 END WHEN f.n > 0 AND (f.used + m.k > {tokens} OR f.n >= {most}) THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN m.k > {tokens} THEN 0 WHEN f.pieces > 0 OR (f.n > 0 AND (f.used + m.k > {tokens} OR f.n >= {most})) THEN m.k ELSE f.used + m.k END,
    CASE WHEN m.k > {tokens} THEN 0 WHEN f.pieces > 0 OR (f.n > 0 AND (f.used + m.k > {tokens} OR f.n >= {most})) THEN 1 ELSE f.n + 1 END,
    CASE WHEN m.k > {tokens} THEN CAST(ceil(m.c / {int(tokens * 3.5)}.0) AS BIGINT) ELSE 0 END
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, turn, chunk + p AS chunk, p AS piece FROM (SELECT *, unnest(range(greatest(pieces, 1))) AS p FROM f)"""


def _packed(read, **limits):
    shown = K.rendered(F.col("role"), F.col("text"))
    rows = read("conversations").select("conv_id", "turn", F.length(shown).alias("c")).filter("c is not null")
    return K.greedy_chunks(rows, "conv_id", "turn", "c", **limits)


@query(_chunks_sql(12_000, 80))
def greedy_chunks(read):
    """Rendered messages packed in order into chunks of at most 12 000 estimated tokens or 80 messages."""
    return _packed(read)


@query(_chunks_sql(120, 6))
def small_chunks(read):
    """The same for a model of a small context, where most messages are cut."""
    return _packed(read, tokens=120, most=6)


@query("SELECT doc_id, sha256(text) AS joined_sha, true AS all_fit FROM documents WHERE text IS NOT NULL")
def loss_free_split(read):
    """Documents split into parts of at most 1000 characters, put together again."""
    docs = read("documents")
    shipping.ship(docs.sparkSession)
    cut = docs.filter("text is not null").select("doc_id", K.loss_free_split(F.col("text"), 1000).alias("v"))
    return cut.select("doc_id", F.sha2(F.array_join("v", ""), 256).alias("joined_sha"), F.forall("v", lambda x: F.length(x) <= 1000).alias("all_fit"))


CANON_SQL = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, {CANON_SQL} AS canonical FROM pages")
def canonical_urls(read):
    return read("pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("""
WITH t AS (SELECT doc_id, lower(substr(text, 1, 60)) AS a, lower(substr(text, 31, 60)) AS b FROM documents),
g AS (SELECT doc_id, CASE WHEN length(a) > 1 THEN list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) ELSE [] END AS x, CASE WHEN length(b) > 1 THEN list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) ELSE [] END AS y FROM t)
SELECT doc_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0)::DOUBLE, 0), 6) AS similarity FROM g""")
def bigram_similarity(read):
    """Overlap of the character bigrams of two places of a text."""
    docs = read("documents").select("doc_id", F.lower(F.substring("text", 1, 60)).alias("a"), F.lower(F.substring("text", 31, 60)).alias("b"))
    return docs.select("doc_id", F.round(T.bigram_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 40) || chr(10) || '...[中间内容已截断]...' || chr(10) || right(text, 20) ELSE text END AS middle,
       CASE WHEN length(trim(text)) > 30 THEN substr(trim(text), 1, 30) || '…' ELSE trim(text) END AS preview FROM documents""")
def truncated_texts(read):
    return read("documents").select("doc_id", T.truncate_middle(F.col("text"), 40, 20).alias("middle"), T.safe_preview(F.col("text"), 30).alias("preview"))


@query("""
WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, length(text) AS c FROM conversations),
f AS (SELECT conv_id, n, turn, CASE WHEN c <= 1500 THEN c ELSE 0 END AS used, c <= 1500 AS kept FROM m WHERE n = 1
  UNION ALL SELECT m.conv_id, m.n, m.turn, CASE WHEN f.used + m.c <= 1500 THEN f.used + m.c ELSE f.used END, f.used + m.c <= 1500 FROM f JOIN m ON m.conv_id = f.conv_id AND m.n = f.n + 1)
SELECT conv_id, count(*) FILTER (kept) AS n_kept, CAST(max(used) AS BIGINT) AS n_chars FROM f GROUP BY conv_id""")
def context_budget(read):
    """The messages of a session that fit 1500 characters in order, skipping those that do not."""
    items = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("c"))))
    kept = R.fill_budget(F.col("items"), 1500, lambda x: x.c)
    rows = read("conversations").groupBy("conv_id").agg(items.alias("items")).withColumn("kept", kept)
    return rows.select("conv_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + x.c).alias("n_chars"))


@query("""
WITH c AS (SELECT lang, source, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT lang, source, n_items, first_id, most, n_contents, contents_sum FROM (SELECT lang, source, count(*) AS n_items, min(doc_id) AS first_id, max(n_chars) AS most FROM documents GROUP BY 1, 2)
JOIN (SELECT lang, source, count(*) AS n_contents, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS contents_sum FROM c GROUP BY 1, 2) USING (lang, source)""")
def extraction_merge(read):
    """Items of one (category, project) merged: the first item, the maxima, and a digest of the distinct whole contents that needs no order."""
    docs = read("documents")
    first = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_items"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("most"))
    once = docs.filter("text is not null").select("lang", "source", F.sha2("text", 256).alias("h")).distinct()
    number = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")
    contents = once.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_contents"), F.sum(number).cast("string").alias("contents_sum"))
    return first.join(contents, ["lang", "source"])


@query("""
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') WHERE n <= 4""")
def recent_history(read):
    """The last four turns of each session, for a prompt."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read("conversations").filter("role <> 'system'").withColumn("n", F.row_number().over(w)).filter("n <= 4").select("conv_id", "turn", "text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS p, coalesce(lang, '') || ':' || coalesce(source, '') AS key FROM documents),
i AS (SELECT key, doc_id, p, content FROM l UNION ALL SELECT coalesce(lang, '') || ':' || coalesce(source, ''), doc_id, 1 + len(string_split(text, chr(10))), text FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS n FROM i)
SELECT key, doc_id, p, sha256(content) AS content_sha FROM t a
WHERE n = 1 OR (t <> '' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.key = a.key AND b.n < a.n AND contains(b.t, a.t)))""")
def contents_kept(read):
    """What a merge of all lines and whole texts of a language and source keeps: contents that no earlier one contains."""
    docs = read("documents").filter("text is not null").select("doc_id", "text", F.concat_ws(":", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("key"), F.split("text", "\n", -1).alias("l"))
    parts = docs.select("key", "doc_id", F.posexplode(F.concat("l", F.array("text"))).alias("p", "content"))
    kept = containment.uncontained(parts, ["key"], ["doc_id", "p"], "content")
    return kept.select("key", "doc_id", (F.col("p") + 1).cast("long").alias("p"), F.sha2("content", 256).alias("content_sha"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
m AS (SELECT *, regexp_matches(line, '^\S{1,12}$') AS f, regexp_matches(line, '\S') AS may FROM l WHERE i < n OR line <> ''),
u AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 0 AND NOT f AND may AS free FROM m),
a AS (SELECT *, coalesce(free AND lag(free) OVER w AND line = lag(line) OVER w, false) AS again FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum((NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a),
k AS (SELECT doc_id, run, any_value(CASE WHEN NOT again THEN line || CASE WHEN i < n THEN chr(10) ELSE '' END END) AS line, count(*) - 1 AS repeats FROM r GROUP BY 1, 2),
t AS (SELECT doc_id, sum(repeats + 1) AS n_lines, sum(repeats) AS n_folded, string_agg(line || CASE WHEN repeats > 0 THEN '[' || repeats || ']' || chr(10) ELSE '' END, '' ORDER BY run) AS c FROM k GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_folded, 0) AS BIGINT) AS n_folded, sha256(coalesce(c, '')) AS compacted_sha FROM documents LEFT JOIN t USING (doc_id)""")
def folded_lines(read):
    """Any repeated line of a text folded outside blocks, which single short words open and close."""
    out = log_lines.compacted(read("documents"), "doc_id", "text", note=("[", "]\n"), repeatable=r"\S", fence=r"^\S{1,12}$")
    return out.select("doc_id", "n_lines", "n_folded", F.sha2("compacted", 256).alias("compacted_sha"))
