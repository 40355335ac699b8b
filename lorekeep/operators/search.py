"""Lexical, semantic and hybrid retrieval as joins and aggregations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, token_line, valid_vector, words

K1, B = 1.2, 0.75
FEEDBACK = {"useful": 1.15, "incorrect": 0.30, "outdated": 0.50, "duplicate": 0.75, "needs_detail": 0.85}


def postings(docs: DataFrame, id_col: str, weighted: dict[str, float], terms: DataFrame | None = None) -> DataFrame:
    """(term, id, f, length): f sums the column weights of a term's places, length counts a document's tokens; of terms(term) alone if given.

    Other terms are left out as soon as a text is cut, before anything is shuffled.
    """
    def weigh(column: str, weight: float) -> Column:
        return F.transform(words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("w")))

    each = F.concat(*[weigh(c, x) for c, x in weighted.items()])
    rows = docs.select(F.col(id_col).alias("id"), each.alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("t")).select("id", "length", "t.term", "t.w")
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id").agg(F.sum("w").alias("f"), F.first("length").alias("length"))


def corpus_stats(docs: DataFrame, text_cols: list[str]) -> DataFrame:
    """One row (n_docs, avg_length) over all documents."""
    length = sum((F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\p{L}\p{N}]+")) for c in text_cols), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("avg_length"))


def bm25(used: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best documents for each query of queries(query_id, term), from the postings of their terms.

    Document frequencies and averages are those of the whole index, whatever is filtered later.
    """
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_length")  # stats is one row
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    parts = used.join(weighed, "term").select("term", "id", part.alias("part"))
    hits = queries.join(parts, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(hits, ["query_id"], [F.desc("score"), F.asc("id")], k)


def lexical(docs: DataFrame, id_col: str, weighted: dict[str, float], phrases: list[str], visible: Column | None = None) -> DataFrame:
    """(id, score): BM25 of one query, an OR of phrases whose last token is a prefix, over weighted columns.

    phrases are token lines (see `search_phrases`).  A document's phrase counts need no postings:
    they are counted in its token lines in one scan.  Frequencies and lengths are those of all
    documents; `visible` filters what is returned.
    """
    count = lambda line, p: (F.length(line) - F.length(F.replace(line, F.lit(p), F.lit("")))) / float(len(p))

    def counted(lines: Column) -> Column:
        own = [lines[f"l{i}"] for i in range(len(weighted))]
        f = [sum((w * count(n, p) for n, w in zip(own, weighted.values(), strict=True)), F.lit(0.0)) for p in phrases]
        has = [sum((count(n, p) for n in own), F.lit(0.0)) > 0 for p in phrases]
        return F.struct(F.array(*f).alias("f"), F.array(*has).alias("has"), sum((count(n, " ") for n in own), F.lit(0.0)).alias("length"))

    # one expression, so that no rule of the optimizer cuts a text once for each phrase
    lines = F.struct(*[token_line(F.col(c)).alias(f"l{i}") for i, c in enumerate(weighted)])
    rows = docs.select(F.col(id_col).alias("id"), (F.lit(True) if visible is None else visible).alias("visible"), F.transform(F.array(lines), counted)[0].alias("r")).select("id", "visible", "r.*")
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"), F.array(*[F.count_if(F.col("has")[i]) for i in range(len(phrases))]).alias("df"))
    idf = F.transform("df", lambda n: F.greatest(F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(1e-6)))
    weighed = F.broadcast(stats.select("avg_length", idf.alias("idf")))  # one row
    score = F.aggregate(F.zip_with("idf", "f", lambda i, x: i * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))), F.lit(0.0), lambda s, x: s + x)
    hit = F.exists("has", lambda h: h) & F.col("visible")
    return rows.filter(hit).crossJoin(weighed).select("id", F.round(score, 6).alias("score"))


def needs_substrings(query: str, hits: DataFrame, limit: int, cap: int = 1024) -> DataFrame:
    """One row (run): whether the substring scan is wanted: too few hits, or technical characters in the query."""
    technical = any(c in "_./:+#-" for c in query)
    return hits.agg((F.lit(technical) | (F.count(F.lit(1)) < min(max(limit, 1), cap))).alias("run"))


def field_score(query: str, terms: list[str], fields: dict[str, Column]) -> Column:
    """Over the fields title, secondary, content and metadata: what the whole query and each term add where they are contained; 0.001 at least."""
    weights = {"title": (12.0, 4.0), "secondary": (8.0, 2.0), "content": (6.0, 1.0), "metadata": (5.0, 1.0)}
    total = F.lit(0.0)
    for name, text in fields.items():
        low, (whole, part) = F.lower(F.coalesce(text, F.lit(""))), weights[name]
        for needle, gain in [(query.lower(), whole), *((t, part) for t in terms)]:
            total = total + F.when(low.contains(needle), gain).otherwise(0.0)
    return F.greatest(total, F.lit(0.001))


def window_of(content: Column, query: str, before: int = 50, size: int = 240) -> Column:
    """The part of a text around the first place of the query; its beginning where there is none."""
    return F.substring(content, F.greatest(F.locate(query.lower(), F.lower(content)) - before, F.lit(1)), F.lit(size))


def substrings(docs: DataFrame, query: str, terms: list[str], id_col: str, fields: dict[str, str], visible: Column | None = None) -> DataFrame:
    """(id, title, score, snippet) of the documents that contain the query or a term in any field."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields.values()]))
    hit = F.greatest(*[whole.contains(n) for n in dict.fromkeys([query.lower(), *terms])], F.lit(False)) & (F.lit(True) if visible is None else visible)
    own = {name: window_of(F.col(c), query) if name == "content" else F.col(c) for name, c in fields.items()}
    second = F.coalesce(own.get("secondary", F.lit("")), F.lit(""))
    shown = F.when(F.trim(second) != "", second).otherwise(own.get("content", F.lit("")))
    return docs.filter(hit).select(F.col(id_col).alias("id"), F.col(fields["title"]).alias("title"), field_score(query, terms, own).alias("score"), snippet(shown, terms).alias("snippet"))


def merged_candidates(lists: list[DataFrame], k: int) -> DataFrame:
    """Candidates (corpus, id, title, score) of all channels on one scale: each entity where it first stands by score, then title."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    first = Window.partitionBy("corpus", "id").orderBy(F.desc("score"), F.asc("title"))
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy(F.desc("score"), "title", "corpus", "id").limit(k)


def match_type(lexical: Column, semantic: Column) -> Column:
    """hybrid for both, vector for the semantic list alone, else fts."""
    return F.when(lexical & semantic, "hybrid").when(semantic, "vector").otherwise("fts")


def validated(query: str, limit: int, corpora: list[str] | None = None, most: int = 4096) -> tuple[str, list[str]] | None:
    """The trimmed query and the corpora to search; None where there is nothing to find."""
    query = query.strip()
    if len(query) > most:
        raise ValueError(f"a query has at most {most} characters")
    return (query, corpora or ["documents", "sessions"]) if query and limit > 0 else None


def candidate_limit(limit: int) -> int:
    """Four times the limit, 256 at most, but no less than the limit."""
    return max(limit, min(4 * limit, 256))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def lexical_score(query: str, terms: list[str], title: Column, content: Column) -> Column:
    """Whole-query hits count 12 in the title and 6 in the content, each contained term 4 and 1."""
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    total = F.when(t.contains(query.lower()), 12.0).otherwise(0.0) + F.when(c.contains(query.lower()), 6.0).otherwise(0.0)
    for term in terms:
        total = total + F.when(t.contains(term), 4.0).otherwise(0.0) + F.when(c.contains(term), 1.0).otherwise(0.0)
    return F.greatest(total, F.lit(0.001))


def substring_recall(docs: DataFrame, query: str, terms: list[str], id_col: str, title_col: str, content_col: str, k: int) -> DataFrame:
    whole = F.lower(F.concat_ws("\n", title_col, content_col))
    hit = F.lit(False)
    for needle in [query.lower(), *terms]:
        hit = hit | whole.contains(needle)
    scored = docs.filter(hit).select(F.col(id_col).alias("id"), lexical_score(query, terms, F.col(title_col), F.col(content_col)).alias("score"), snippet(F.col(content_col), terms).alias("snippet"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def snippet(text: Column, terms: list[str], before: int = 50, size: int = 220) -> Column:
    """The window around the earliest term, else the head."""
    at = F.least(*[F.when(F.locate(t, F.lower(text)) > 0, F.locate(t, F.lower(text))) for t in [*terms, *terms]])
    head = F.substring(text, 1, size)
    return F.when(at.isNotNull(), F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size))).otherwise(F.when(F.length(text) > size, F.concat(head, F.lit("…"))).otherwise(head))


def semantic(vectors: DataFrame, query: Column, id_col: str, vector_col: str, k: int) -> DataFrame:
    good = vectors.filter(valid_vector(F.col(vector_col)) & (F.size(vector_col) == F.size(query)))
    scored = good.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), query), 6).alias("score")).filter("score is not null")
    return scored.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """hits(id, score) of a list already cut to k rows, with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(lists: dict[str, DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists(id, rank): id, rrf, match_types."""
    rows = None
    for name, hits in lists.items():
        part = hits.select("id", (1.0 / (constant + F.col("rank"))).alias("r"), F.lit(name).alias("m"))
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("id").agg(F.round(F.sum("r"), 9).alias("rrf"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("match_types"))


def rerank(fused: DataFrame, feedback: DataFrame, k: int) -> DataFrame:
    """Scores times the factor of each item's feedback, then the cut to k."""
    factor = F.lit(1.0)
    for kind, x in FEEDBACK.items():
        factor = F.when(F.col("kind") == kind, x).otherwise(factor)
    joined = fused.join(feedback, "id", "left").withColumn("score", F.round(F.col("rrf") * factor, 9))
    return joined.orderBy(F.desc("score"), "id").limit(k)
