"""What a model is shown of the hits of a question, and of the talk before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyse

# What is said of material that its latest feedback disputes, and the names of corpora and roles.
DISPUTED = {"incorrect": "用户标记为错误；未经人工核实不得作为可靠事实", "outdated": "用户标记为过时；不得当作当前生效方案", "needs_detail": "用户要求补充证据；需谨慎引用"}
CORPUS_NAMES = {"documents": "知识", "sessions": "AI 对话"}
ASKER, ANSWERER, NONE = "用户", "助手", "（无）"


def anchor(question: str) -> str:
    """The longest term of a question (the first of several), by which excerpts are placed; the question itself if no term has two characters."""
    longest = max(analyse(question.strip()), key=len, default="")
    return longest if len(longest) >= 2 else question.strip()


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _named(key: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for known, shown in names.items():
        out = F.when(key == known, shown).otherwise(out)
    return out


def excerpt(text: Column, term: Column, before: int = 700, size: int = 3800) -> Column:
    """`size` characters of a text from `before` ahead of a term's first place in either case; from its start where the term is not in it."""
    return F.substring(text, F.greatest(F.instr(F.lower(text), F.lower(term)) - before, F.lit(1)), F.lit(size))


def evidence(hits: DataFrame, term: Column, query: str = "query_id", items: int = 5, total: int = 8000, single: int = 1800) -> DataFrame:
    """(query, index, corpus, id, title, kind, text): the first `items` hits of each query whose texts fit `total` characters.

    hits has query, rank, corpus, id, title, text (the text as it is now), kind (the latest
    feedback) and, for a hit in a part, chunk, else null; other columns are left out.  A hit of a
    whole text shows an excerpt around term, one of a part the whole part.  Of one hit twice the
    better rank counts, hits with a null or blank text are passed over, and those of a document
    whose feedback disputes it begin with a label, which counts.  A text is cut to `single`
    characters and to what is left of all.  Ties of rank go by corpus, id and chunk.
    """
    order = ["rank", "corpus", "id", "chunk"]
    whole = _trim(F.when(F.col("chunk").isNull(), excerpt(F.col("text"), term)).otherwise(F.col("text")))
    label = F.when(F.col("corpus") == "documents", _named(F.col("kind"), DISPUTED))
    rows = hits.select(query, *order, "title", "kind", whole.alias("text")).filter("text <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(query, "corpus", "id", "chunk").orderBy(*order))).filter("_n = 1")
    rows = rows.withColumn("text", F.substring(F.concat(F.when(label.isNotNull(), F.concat(F.lit("【"), label, F.lit("】\n"))).otherwise(""), F.col("text")), 1, single))
    line = Window.partitionBy(query).orderBy(*order)
    rows = rows.withColumn("index", F.row_number().over(line)).filter(F.col("index") <= items)
    used = F.coalesce(F.sum(F.length("text")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_left", (total - used).cast("int")).filter("_left > 0")
    return kept.select(query, F.col("index").cast("long").alias("index"), "corpus", "id", "title", "kind", F.substring(F.col("text"), F.lit(1), F.col("_left")).alias("text"))


def formatted(kept: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, evidence): the evidence of each query as one text."""
    one = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] 类型："), _named(F.col("corpus"), CORPUS_NAMES), F.lit("\n标题："), F.coalesce("title", F.lit("")), F.lit("\n内容：\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("index", one.alias("t"))))  # `items` of a query
    return kept.groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x.t), "\n\n---\n\n").alias("evidence"))


def history(turns: DataFrame, session: str, order: str, role: str = "role", text: str = "text", last: int = 4, most: int = 3000) -> DataFrame:
    """(session, history): a line for each of the last `last` turns of a session, as far as `most` characters go.

    The turn that reaches the limit is cut, later ones are left out; a line's role and end count
    but are never cut.  Null and blank turns show nothing, yet count among the last.  A session
    without a line has a mark instead.
    """
    back = Window.partitionBy(session).orderBy(F.desc(order), F.desc(text), F.desc(role))
    some = turns.select(session, order, role, text).withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= last)
    name = F.when(F.lower(F.trim(role)) == "assistant", ANSWERER).otherwise(ASKER)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), name.alias("name"), _trim(F.coalesce(text, F.lit(""))).alias("said"))))  # `last` turns

    def add(out: Column, t: Column) -> Column:
        line = F.concat(out, t["name"], F.lit("："), F.substring(t.said, F.lit(1), F.lit(most) - F.length(out)), F.lit("\n"))
        return F.when((F.length(out) < most) & (t.said != ""), line).otherwise(out)

    lines = some.groupBy(session).agg(_trim(F.aggregate(listed, F.lit(""), add)).alias("history"))
    return lines.withColumn("history", F.when(F.col("history") == "", NONE).otherwise(F.col("history")))
