"""Search, fusion, deduplication and evidence over documents, embeddings and the benchmark's query set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blobs
from ..functions import text as T
from ..operators import evidence as E
from ..operators import index as I  # noqa: E741
from ..operators import rebuild as B
from ..operators import search as S
from ..operators.progressive import progressive
from ..operators import semantic as V
from .base import query, shared_folder
from .knowledge import LATEST_SQL, latest_kind

QUERY = "erentha license under the thonre"
TERMS = T.analyse(QUERY)

LINE_SQL = "(CASE WHEN trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = '' THEN '' ELSE ' ' || trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END)"
TOKENS_SQL = "list_filter(string_split(" + LINE_SQL + ", ' '), lambda w: w <> '')"
BM25_SQL = f"""
d AS MATERIALIZED (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS ws FROM documents),
t AS (SELECT id, unnest(ws) AS term FROM d),
p AS (SELECT term, id, CAST(count(*) AS DOUBLE) AS f FROM t GROUP BY term, id),
len AS (SELECT id, len(ws) AS length FROM d),
st AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM len),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.query_id, p.id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN len ON len.id = p.id CROSS JOIN st GROUP BY q.query_id, p.id)"""

_built: dict[tuple, str] = {}


def indexed(read) -> str:
    """The folder of the index of the documents' columns KNOWLEDGE, built when it is first asked for in an application."""
    docs = read("documents")
    key = docs.sparkSession.sparkContext.applicationId, *docs.inputFiles()
    if key not in _built:
        folder = shared_folder(docs.sparkSession, "index")
        I.add(docs.select("doc_id", *[c.alias(n) for n, c in zip(KNOWLEDGE, (T.first_line(F.col("text")), F.col("source"), F.col("text"), F.col("lang")), strict=True)]), folder, "doc_id", list(KNOWLEDGE))
        _built[key] = folder
    return _built[key]


KNOWLEDGE = {"title": 4.0, "source": 2.0, "text": 1.0, "lang": 1.0}
COLUMN = {name: i for i, name in enumerate(KNOWLEDGE)}


@query(f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark), {BM25_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def bm25_topk(read):
    """Each benchmark passage as a query; its ten best documents, from the index."""
    folder = indexed(read)
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(I.tokens(F.col("text")))).alias("term"))
    return I.top_terms(asked.sparkSession, folder, asked, COLUMN["text"], 10).select("query_id", "id", "score", "rank")


def lexical_sql(table: str, key: str, weighted: dict[str, float], phrases: list[str]) -> str:
    """BM25 of one query over weighted columns, as (id, score)."""
    names = [f"l{i}" for i in range(len(weighted))]
    count = lambda n, p: f"(length({n}) - length(replace({n}, '{p}', ''))) / {len(p)}.0::DOUBLE"
    lines = ", ".join(f"{LINE_SQL.format(c)} AS {n}" for c, n in zip(weighted, names, strict=True))
    f = ", ".join(" + ".join(f"{w} * {count(n, p)}" for n, w in zip(names, weighted.values(), strict=True)) + f" AS f{i}" for i, p in enumerate(phrases))
    has = ", ".join("(" + " + ".join(count(n, p) for n in names) + f") > 0 AS h{i}" for i, p in enumerate(phrases))
    score = " + ".join(f"greatest(ln((n_docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / avg_length))" for i in range(len(phrases)))
    return f"""(WITH ln AS (SELECT {key} AS id, {lines} FROM {table}), r AS (SELECT id, {f}, {has}, {" + ".join(count(n, " ") for n in names)} AS length FROM ln),
      st AS (SELECT count(*) AS n_docs, avg(length) AS avg_length, {", ".join(f"count(*) FILTER (h{i}) AS d{i}" for i in range(len(phrases)))} FROM r)
      SELECT id, round({score}, 6) AS score FROM r, st WHERE {" OR ".join(f"h{i}" for i in range(len(phrases)))})"""


PHRASES = T.search_phrases(QUERY, TERMS)
BEST_SQL = f"SELECT id, score FROM {lexical_sql('documents', 'doc_id', {'text': 1.0}, PHRASES)} ORDER BY score DESC, id LIMIT 30"


def _bm25(read, k):
    hits = I.search(read("documents").sparkSession, indexed(read), PHRASES, {COLUMN["text"]: 1.0}, len(COLUMN))
    return S.ranked(hits.orderBy(F.desc("score"), "id").limit(k))


def _titled(read):
    return read("documents").select("doc_id", T.first_line(F.col("text")).alias("title"), "text")


_HIT = " OR ".join(f"contains(w, '{t}')" for t in [QUERY.lower(), *TERMS])
_SCORE = " + ".join([f"(CASE WHEN contains(tl, '{QUERY.lower()}') THEN 12.0 ELSE 0.0 END)", f"(CASE WHEN contains(cl, '{QUERY.lower()}') THEN 6.0 ELSE 0.0 END)", *(f"(CASE WHEN contains(tl, '{t}') THEN 4.0 ELSE 0.0 END) + (CASE WHEN contains(cl, '{t}') THEN 1.0 ELSE 0.0 END)" for t in TERMS)])
SUBSTRING_SQL = f"""
SELECT doc_id AS id, CAST(greatest({_SCORE}, 0.001) AS DOUBLE) AS score FROM (
  SELECT doc_id, lower(substr(string_split(text, chr(10))[1], 1, 80)) AS tl, lower(text) AS cl, lower(substr(string_split(text, chr(10))[1], 1, 80) || chr(10) || text) AS w FROM documents)
WHERE {_HIT} ORDER BY score DESC, id LIMIT 30"""


@query(SUBSTRING_SQL)
def substring_topk(read):
    return S.substring_recall(_titled(read), QUERY, TERMS, "doc_id", "title", "text", 30).select("id", "score")


def _probe(read):
    """The stored vector of the smallest id as the query vector: one row."""
    return read("embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("probe"))


COS = "CAST(list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) AS DOUBLE) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
SEMANTIC_SQL = f"SELECT e.vec_id AS id, round({COS.format('e.embedding', 'p.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) p ORDER BY score DESC, id LIMIT 30"


@query(SEMANTIC_SQL)
def semantic_topk(read):
    rows = read("embeddings").join(F.broadcast(_probe(read)))  # one row
    return S.semantic(rows, F.col("probe"), "vec_id", "embedding", 30)


RRF_SQL = f"""
l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({BEST_SQL})),
u AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({SUBSTRING_SQL})),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({SEMANTIC_SQL})),
a AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS r, 'bm25' AS m FROM l UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank), 'substring' FROM u UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank), 'semantic' FROM v),
f AS (SELECT id, round(sum(r), 9) AS rrf, array_to_string(list_sort(list(DISTINCT m)), ',') AS match_types FROM a GROUP BY id)"""


@query(f"WITH {RRF_SQL} SELECT id, rrf, match_types FROM f")
def hybrid_rrf(read):
    lists = {"bm25": _bm25(read, 30), "substring": S.ranked(substring_topk(read)), "semantic": S.ranked(semantic_topk(read))}
    return S.fuse(lists)


#: Events about a document stand for feedback on it, so that items have a history of which the latest holds.
TOLD = {"signup": "useful", "click": "incorrect", "view": "outdated", "error": "duplicate", "purchase": "needs_detail"}
HELD_SQL = f"SELECT user_id AS doc_id, CASE kind {' '.join(f"WHEN '{e}' THEN '{k}'" for e, k in TOLD.items())} END AS kind FROM ({LATEST_SQL})"
FACTOR_SQL = f"CASE kind {' '.join(f"WHEN '{k}' THEN {x}" for k, x in S.FEEDBACK.items())} ELSE 1.0 END"


def _held(read):
    """(doc_id, kind): the latest feedback on each document, one row each."""
    kind = F.lit(None).cast("string")
    for event, told in TOLD.items():
        kind = F.when(F.col("kind") == event, told).otherwise(kind)
    return latest_kind(read).select(F.col("user_id").alias("doc_id"), kind.alias("kind"))


@query(f"""
WITH {RRF_SQL}, k AS ({HELD_SQL}),
x AS (SELECT f.id, coalesce(kind, 'none') AS kind, round(rrf * {FACTOR_SQL}, 9) AS score FROM f LEFT JOIN k ON k.doc_id = f.id)
SELECT id, kind, score FROM x ORDER BY score DESC, id LIMIT 20""")
def feedback_rerank(read):
    told = _held(read).withColumnRenamed("doc_id", "id")
    return S.rerank(hybrid_rrf(read), told, 20).select("id", F.coalesce("kind", F.lit("none")).alias("kind"), "score")


FOUND = [f"nullif(instr(lower(text), '{t}'), 0)" for t in TERMS]
SNIPPET_SQL = f"CASE WHEN least({', '.join(FOUND)}) IS NOT NULL THEN substr(text, greatest(least({', '.join(FOUND)}) - 50, 1), 220) WHEN length(text) > 220 THEN substr(text, 1, 220) || '…' ELSE text END"


@query(f"""
WITH {RRF_SQL}, k AS ({HELD_SQL}),
x AS (SELECT f.id, coalesce(kind, 'none') AS kind, round(rrf * {FACTOR_SQL}, 9) AS score FROM f LEFT JOIN k ON k.doc_id = f.id),
y AS (SELECT * FROM x ORDER BY score DESC, id LIMIT 20)
SELECT id, score, kind, substr(string_split(text, chr(10))[1], 1, 80) AS title, {SNIPPET_SQL} AS snippet FROM y LEFT JOIN documents ON doc_id = id""")
def hybrid_search(read):
    """The flagship: re-ranked hybrid hits with their snippets."""
    rows = feedback_rerank(read).join(_titled(read), F.col("id") == F.col("doc_id"), "left")
    return rows.select("id", "score", "kind", "title", S.snippet(F.col("text"), TERMS).alias("snippet"))


PAIRS_SQL = f"SELECT x.vec_id AS a, y.vec_id AS b, x.label, round({COS.format('x.embedding', 'y.embedding')}, 6) AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id"


@query(f"SELECT * FROM ({PAIRS_SQL}) WHERE cosine >= 0.87")
def dedup_candidates(read):
    return V.similar_pairs(read("embeddings"), 0.87)


@query(f"""
WITH p AS (SELECT * FROM ({PAIRS_SQL}) WHERE cosine >= 0.82), e AS (SELECT a AS item, b AS candidate, cosine FROM p UNION ALL SELECT b, a, cosine FROM p)
SELECT item, candidate, cosine FROM e QUALIFY row_number() OVER (PARTITION BY item ORDER BY cosine DESC, candidate) <= 3""")
def dedup_cross_capped(read):
    """The three closest candidates of each item; links only."""
    p = V.similar_pairs(read("embeddings"), 0.82)
    both = p.select(F.col("a").alias("item"), F.col("b").alias("candidate"), "cosine").unionByName(p.select(F.col("b").alias("item"), F.col("a").alias("candidate"), "cosine"))
    return S.top(both, ["item"], [F.desc("cosine"), F.asc("candidate")], 3).drop("rank")


@query(f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY a, b) AS n FROM ({PAIRS_SQL}) WHERE cosine >= 0.82 AND (a + b) % 3 <> 0),
r AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, CAST([] AS BIGINT[]) AS removed FROM p
  UNION ALL
  SELECT r.label, p.n, CASE WHEN list_contains(removed, a) OR list_contains(removed, b) THEN kept ELSE list_append(kept, a) END,
         CASE WHEN list_contains(removed, a) OR list_contains(removed, b) THEN removed ELSE list_append(removed, b) END
  FROM r JOIN p ON p.label = r.label AND p.n = r.n + 1)
SELECT label, unnest(kept) AS kept, unnest(removed) AS removed FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1)""")
def semantic_merge(read):
    """Near items of a label that a judge calls the same, merged in order."""
    pairs = V.similar_pairs(read("embeddings"), 0.82)
    return V.merge_in_order(pairs.filter(V.same(F.col("a"), F.col("b"))), "label")


@query(f"""
WITH p AS (SELECT * FROM ({PAIRS_SQL}) WHERE cosine >= 0.82), e AS (SELECT label, a AS item, b AS candidate, cosine FROM p UNION ALL SELECT label, b, a, cosine FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cosine DESC, candidate) AS nth FROM e QUALIFY nth <= 3)
SELECT label, item, candidate, cosine, row_number() OVER (PARTITION BY label ORDER BY item, nth) AS place FROM t QUALIFY place <= 24""")
def semantic_relations(read):
    """Each item's three closest candidates, 24 of a label in all."""
    p = V.similar_pairs(read("embeddings"), 0.82)
    both = p.select("label", F.col("a").alias("item"), F.col("b").alias("candidate"), "cosine").unionByName(p.select("label", F.col("b").alias("item"), F.col("a").alias("candidate"), "cosine"))
    return V.capped_relations(both, "label")


@query(f"""
WITH h AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS n FROM ({SUBSTRING_SQL}) QUALIFY n <= 10),
t AS (SELECT id, n, least(length(text), 1800) AS c FROM h JOIN documents ON doc_id = id)
SELECT id, c FROM (SELECT *, sum(c) OVER (ORDER BY n) AS used FROM t) WHERE n <= 5 AND used <= 8000""")
def rag_evidence(read):
    """The texts of the ten best hits, cut to 1800 characters, at most five and 8000 characters in all."""
    hits = S.ranked(substring_topk(read)).filter("rank <= 10")
    items = hits.join(read("documents"), F.col("id") == F.col("doc_id")).select("rank", "id", F.least(F.length("text"), F.lit(1800)).cast("long").alias("c"))
    listed = items.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "c"))).alias("x"))  # ten rows
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.slice("x", 1, 0).alias("kept"), F.lit(True).alias("open"))

    def step(s, x):
        fits = s.open & (s.used + x.c <= 8000) & (F.size(s.kept) < 5)
        return F.struct(F.when(fits, s.used + x.c).otherwise(s.used).alias("used"), F.when(fits, F.concat(s.kept, F.array(x))).otherwise(s.kept).alias("kept"), fits.alias("open"))

    return listed.select(F.explode(F.aggregate("x", begin, step).kept).alias("k")).select("k.id", "k.c")


TITLED_SQL = "(SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 80) AS title, source, text, lang FROM documents)"
SESSION = {"role": 1.0, "text": 1.0}
SESSIONS_SQL = "(SELECT conv_id, turn, role, text, conv_id * 100000 + turn AS id FROM conversations)"
SOUGHT = "thonre MIT license src1.x"
SOUGHT_TERMS = T.analyse(SOUGHT)
SOUGHT_PHRASES = T.search_phrases(SOUGHT, SOUGHT_TERMS)
EXCLUDED_SQL = "SELECT doc_id FROM labels WHERE toxic = 1"
KNOWLEDGE_SQL = f"SELECT id, score FROM {lexical_sql(TITLED_SQL, 'doc_id', KNOWLEDGE, SOUGHT_PHRASES)} WHERE id NOT IN ({EXCLUDED_SQL}) AND id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


def _knowledge(read):
    """Documents with title and fields, and whether they may be found: of the asked language, not excluded."""
    gone = read("labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("gone"))
    return read("documents").select("doc_id", T.first_line(F.col("text")).alias("title"), "source", "text", "lang").join(gone, "doc_id", "left")


def _shown():
    return F.col("gone").isNull() & (F.col("lang") == "en")


def _visible_hits(read, shown):
    hits = I.search(shown.sparkSession, indexed(read), SOUGHT_PHRASES, {COLUMN[c]: w for c, w in KNOWLEDGE.items()}, len(COLUMN))
    return hits.join(shown.select(F.col("doc_id").alias("id")), "id", "left_semi")


@query(f"SELECT id, score FROM ({KNOWLEDGE_SQL})")
def lexical_knowledge(read):
    """Weighted BM25 over four columns of the knowledge corpus, with a filter and exclusions that bear on no frequency."""
    return _visible_hits(read, _knowledge(read).filter(_shown()))


@query(f"SELECT id, score FROM {lexical_sql(SESSIONS_SQL, 'id', SESSION, SOUGHT_PHRASES)}")
def lexical_sessions(read):
    """BM25 over the session corpus with equal weights."""
    turns = read("conversations").withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    return S.lexical(turns, "id", SESSION, SOUGHT_PHRASES)


def _score_sql(query: str, terms: list[str], fields: dict[str, str]) -> str:
    weights = {"title": (12.0, 4.0), "secondary": (8.0, 2.0), "content": (6.0, 1.0), "metadata": (5.0, 1.0)}
    parts = [f"CASE WHEN contains(lower({c}), '{n}') THEN {g} ELSE 0.0 END" for f, c in fields.items() for n, g in [(query.lower(), weights[f][0]), *((t, weights[f][1]) for t in terms)]]
    return "CAST(greatest(" + " + ".join(parts) + ", 0.001) AS DOUBLE)"


WINDOW_SQL = f"substr(text, greatest(instr(lower(text), '{SOUGHT.lower()}') - 50, 1), 240)"
CHANNEL_SQL = f"""SELECT doc_id AS id, title, {_score_sql(SOUGHT, SOUGHT_TERMS, {'title': 'title', 'secondary': 'source', 'content': WINDOW_SQL, 'metadata': 'lang'})} AS score FROM {TITLED_SQL}
WHERE lang = 'en' AND doc_id NOT IN ({EXCLUDED_SQL}) AND ({" OR ".join(f"contains(lower(title || ' ' || source || ' ' || text || ' ' || lang), '{n}')" for n in [SOUGHT.lower(), *SOUGHT_TERMS])})"""


@query(f"""
WITH a AS ({KNOWLEDGE_SQL}), r AS (SELECT true OR count(*) < 30 AS run FROM a),
c AS (SELECT a.id, t.title, a.score FROM a JOIN {TITLED_SQL} t ON t.doc_id = a.id UNION ALL SELECT b.* FROM ({CHANNEL_SQL}) b, r WHERE run)
SELECT id, title, score FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, title) = 1 ORDER BY score DESC, title, id LIMIT 30""")
def lexical_merged(read):
    """Both channels of a query with technical characters on one scale, each document once."""
    docs = _knowledge(read)
    hits = _visible_hits(read, docs.filter(_shown()))
    found = hits.join(docs.select(F.col("doc_id").alias("id"), "title"), "id").select(F.lit("documents").alias("corpus"), "id", "title", "score")
    more = S.substrings(docs, SOUGHT, SOUGHT_TERMS, "doc_id", {"title": "title", "secondary": "source", "content": "text", "metadata": "lang"}, _shown())
    more = more.crossJoin(F.broadcast(S.needs_substrings(SOUGHT, hits, 30))).filter("run").select(F.lit("documents").alias("corpus"), "id", "title", "score")  # one row
    return S.merged_candidates([found, more], 30).select("id", "title", "score")


@query(f"""
SELECT page_id AS id, {_score_sql('example.com', T.analyse('example.com'), {'title': 'host', 'metadata': 'path'})} AS score FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) WHERE contains(lower(host || ' ' || path), 'example.com')""")
def metadata_fallback(read):
    """Recall from metadata alone, where there is no index of contents."""
    pages = read("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return S.substrings(pages, "example.com", T.analyse("example.com"), "page_id", {"title": "host", "metadata": "path"}).select("id", "score")


@query(f"""
WITH a AS (SELECT id FROM ({BEST_SQL})), b AS (SELECT id FROM ({SEMANTIC_SQL}))
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'hybrid' WHEN b.id IS NOT NULL THEN 'vector' ELSE 'fts' END AS match_type FROM a FULL JOIN b ON a.id = b.id""")
def match_types(read):
    """By which list a hit was found, in the older names."""
    a = _bm25(read, 30).select("id", F.lit(True).alias("a"))
    b = semantic_topk(read).select("id", F.lit(True).alias("b"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return a.join(b, "id", "full").select("id", S.match_type(yes("a"), yes("b")).alias("match_type"))


@query("""
SELECT vec_id, len(embedding) AS dims, CASE WHEN embedding IS NULL OR list_contains(list_transform(embedding, lambda x: x IS NULL), true) THEN 'missing' WHEN vec_id % 7 = 3 THEN 'odd' WHEN len(embedding) <> 64 THEN 'width' ELSE 'ok' END AS state,
       CASE WHEN vec_id % 7 <> 3 THEN CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1048576) AS BIGINT))) AS BIGINT) END AS total
FROM embeddings""")
def vector_blobs(read):
    """Vectors written as blobs, some with a byte too many, then audited and read back."""
    rows = read("embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), blobs.blob(F.col("embedding")).alias("b"))
    rows = rows.withColumn("b", F.when(F.col("vec_id") % 7 == 3, F.concat("b", F.lit(b"\0"))).otherwise(F.col("b"))).withColumn("v", blobs.floats(F.col("b")))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1048576))
    return rows.select("vec_id", "dims", blobs.blob_state(F.col("b"), F.lit(64)).alias("state"), total.alias("total"))


@query(f"""
WITH l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({SUBSTRING_SQL})), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({SEMANTIC_SQL})),
a AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS r FROM l UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM v)
SELECT 0 AS stage, id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf FROM l UNION ALL SELECT 1, id, round(sum(r), 9) FROM a GROUP BY id""")
def progressive_search(read):
    """What is published of a search: stage 0 the lexical hits, stage 1 those fused with the semantic ones; 30 hits a list."""
    docs = read("documents")
    spark, told = docs.sparkSession, []
    text = S.ranked(substring_topk(read))

    def recall(vector):
        near = S.semantic(read("embeddings"), F.lit(vector), "vec_id", "embedding", 30)
        return S.fuse({"substring": text, "semantic": S.ranked(near)}).select("id", "rrf")

    progressive(S.fuse({"substring": text}).select("id", "rrf"), QUERY, lambda _: [float(x) for x in _probe(read).first().probe], recall, told.append, 600, 600)
    rows = [(stage, r.id, r.rrf) for stage, outcome in enumerate(told) for r in outcome.rows]
    return spark.createDataFrame(rows, "stage int, id long, rrf double")


def _measured(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: characters, blanks and lines of a text; it refuses texts with a sharp s."""
    if any("ß" in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query("""
SELECT doc_id, CASE WHEN contains(text, 'ß') THEN 'failed' ELSE 'ok' END AS state,
       CASE WHEN NOT contains(text, 'ß') THEN length(text) END AS chars, CASE WHEN NOT contains(text, 'ß') THEN length(text) - length(replace(text, ' ', '')) END AS blanks, CASE WHEN NOT contains(text, 'ß') THEN length(text) - length(replace(text, chr(10), '')) END AS lines
FROM documents WHERE regexp_matches(text, '\\S')""")
def index_rebuild(read):
    """The vectors of all documents' chunks, written in parts; the sums over a document's chunks are those of its whole text."""
    docs = read("documents")
    folder = shared_folder(docs.sparkSession, "rebuild")
    B.rebuild(docs, folder, _measured, "doc_id", "text", parts=4)
    rows = B.vectors(docs.sparkSession, folder)
    sums = rows.groupBy("id").agg(*[F.sum(F.col("vector")[i].cast("double")).cast("long").alias(c) for i, c in enumerate(("chars", "blanks", "lines"))])
    whole = F.col("state") == "ok"
    return B.states(rows).join(sums, "id").select(F.col("id").alias("doc_id"), "state", *[F.when(whole, F.col(c)).alias(c) for c in ("chars", "blanks", "lines")])


ANCHOR = E.anchor(QUERY)
LABEL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '【{v}】' || chr(10)" for k, v in E.DISPUTED.items()) + " ELSE '' END"


@query(f"""
WITH k AS (SELECT doc_id AS id, kind FROM ({HELD_SQL})),
h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({SUBSTRING_SQL}) QUALIFY rank <= 10),
t AS (SELECT h.rank, h.id, substr(string_split(text, chr(10))[1], 1, 80) AS title, k.kind, regexp_replace(substr(text, CASE WHEN contains(lower(text), '{ANCHOR}') THEN greatest(1, instr(lower(text), '{ANCHOR}') - 700) ELSE 1 END, 3800), '^\\s+|\\s+$', '', 'g') AS body
  FROM h JOIN documents d ON d.doc_id = h.id LEFT JOIN k ON k.id = h.id),
c AS (SELECT *, row_number() OVER (ORDER BY rank) AS index, substr({LABEL_SQL} || body, 1, 1800) AS text FROM t WHERE body <> '' QUALIFY index <= 5),
u AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT index, id, title, kind, sha256(substr(text, 1, CAST(8000 - used AS BIGINT))) AS text_sha FROM u WHERE used < 8000""")
def rag_excerpts(read):
    """The evidence of one question: excerpts around its longest term, disputed ones labelled by their latest feedback."""
    hits = S.ranked(substring_topk(read)).filter("rank <= 10")
    told = _held(read).withColumnRenamed("doc_id", "id")
    rows = hits.join(_titled(read), F.col("id") == F.col("doc_id")).join(told, "id", "left")
    rows = rows.select(F.lit(0).alias("query_id"), "rank", F.lit("documents").alias("corpus"), "id", F.lit(None).cast("long").alias("chunk"), "title", "text", "kind")
    return E.evidence(rows, F.lit(ANCHOR)).select("index", "id", "title", "kind", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, CASE WHEN lower(trim(role)) = 'assistant' THEN '{E.ANSWERER}' ELSE '{E.ASKER}' END AS name, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS said FROM conversations QUALIFY back <= 4),
f AS (SELECT conv_id, max(back) + 1 AS back, '' AS h FROM m GROUP BY conv_id
  UNION ALL SELECT f.conv_id, m.back, CASE WHEN length(h) < 3000 AND said <> '' THEN h || name || '：' || substr(said, 1, 3000 - length(h)) || chr(10) ELSE h END FROM f JOIN m ON m.conv_id = f.conv_id AND m.back = f.back - 1)
SELECT conv_id, sha256(CASE WHEN h = '' THEN '{E.NONE}' ELSE regexp_replace(h, '\\s+$', '') END) AS history_sha FROM f WHERE back = 1""")
def talk_history(read):
    """The last four turns of every session in 3000 characters, as they precede a question."""
    return E.history(read("conversations"), "conv_id", "turn").select("conv_id", F.sha2("history", 256).alias("history_sha"))
