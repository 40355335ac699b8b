"""Quality by a sparse rule ensemble.

Statistics of each text are column expressions.  A random forest of shallow trees is fitted
to them, every path in it becomes a conjunctive rule, an L1-penalised logistic regression
weighs the rules and drops most, and those that stay are compiled into one column
expression.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .language import crc_part

FEATURES = ("chars", "words", "word_chars", "distinct", "repeats", "upper", "symbols", "digits", "exclaims", "stops", "bars", "lines", "line_repeats", "short_words")

Rule = tuple[tuple[int, bool, float], ...]  #: (feature, at most?, threshold) of each condition


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f): FEATURES of the whole text as an array of doubles; a null text is empty."""
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", r"\s+"), lambda x: x != "")).withColumn("l", F.filter(F.split("t", r"\n"), lambda x: F.trim(x) != ""))
    n, chars, lines = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("t"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))
    values = [
        F.log1p(F.length("t")), F.log1p(F.size("w")), F.length("t") / n, F.size(F.array_distinct("w")) / n,
        count(r"(?<!\S)(\S++) \1(?!\S)") / n, count(r"\p{Lu}") / chars, count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]") / n, count(r"\p{Nd}") / chars,
        count("!") / n, count(r"[.,]") / n, count(r"\|") / n, n / lines, 1 - F.size(F.array_distinct("l")) / lines, count(r"(?<!\S)\S{1,3}(?!\S)") / n,
    ]
    return rows.select("id", F.array(*[v.cast("double") for v in values]).alias("f"))


def tree_rules(described: str) -> set[Rule]:
    """The paths of every tree in a forest's debug string, from the root to each node below it."""
    found: set[Rule] = set()
    path: list[tuple[int, bool, float]] = []
    for line in described.splitlines():
        depth = (len(line) - len(line.lstrip())) - 4  # a tree's own lines are indented by four and more
        if m := re.match(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line.strip()):
            path[depth:] = [(int(m[2]), m[3] == "<=", float(m[4]))]
            found.add(tuple(path))
    return found


def holds(rule: Rule) -> Column:
    """1.0 where every condition of the rule holds."""
    on = F.lit(True)
    for i, most, at in rule:
        on = on & ((F.col("f")[i] <= at) if most else (F.col("f")[i] > at))
    return on.cast("double")


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights) from rows(f, label); none if the labels are all alike."""
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return (20.0 if 1.0 in seen else -20.0 if seen else 0.0), []
    lines = rows.select(array_to_vector("f").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, subsamplingRate=0.7, minInstancesPerNode=5).fit(lines)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: (len(r), r))
    named = [f"r{i}" for i in range(len(rules))]
    marked = rows.select("label", *[holds(r).alias(c) for r, c in zip(rules, named, strict=True)])
    lasso = LogisticRegression(maxIter=60, regParam=penalty, elasticNetParam=1.0, standardization=False)
    model = lasso.fit(scratch.table(VectorAssembler(inputCols=named, outputCol="features").transform(marked).select("features", "label"), "rules"))
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.lit(weight) * holds(rule)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Fitted on at most about `max_rows` labelled rows, by a hash of their id, whose crc32 of the
    id by 5 is not 0.  Null and empty texts have statistics like any other; very long ones are read
    whole.  Without labels the score is 0.5.  Repeated rows score alike, a score of exactly
    `threshold` counts as predicted, and a row with a null id is held out by the crc32 of 0.  An
    empty table gives an empty table; other columns are ignored, whatever their names.
    """
    stats = scratch.table(statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1)").filter(crc_part("id", 5) != 0)
    rate = min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(rate * 1_000_000) + (rate == 1))
    rows = scratch.table(stats.join(known, "id").select("f", "label"), "labelled")
    intercept, rules = fit(rows)
    p = compiled(intercept, rules)
    return stats.select(F.col("id").alias(id_col), (crc_part("id", 5) == 0).alias("held_out"), p.alias("score"), (p >= threshold).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
