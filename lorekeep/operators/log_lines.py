"""Repeated log lines outside fenced blocks, folded: a text of one segment in its own row, a longer one in segments by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The beginnings of lines that may be folded, those of fences, and the note that stands for the repeats.
REPEATABLE = r"^\s*(INFO |WARN |ERROR |DEBUG |TRACE |\[INFO\]|\[WARN\]|\[ERROR\]|\[DEBUG\]|\[TRACE\])"
FENCE = r"^\s*(```|~~~)"
NOTE = ("[以上完全相同的日志又连续出现 ", " 次；原始记录保留在会话中]\n")
SEGMENT = 1024  #: lines of a segment


def folded(texts: DataFrame, key: str, text: str, repeatable: str = REPEATABLE, fence: str = FENCE, segment: int = SEGMENT) -> DataFrame:
    """(key, run, line, repeats): the lines that stay, numbered from 1, with how many equal ones followed each and were left out.

    A line is left out if it and the one before are repeatable, equal but for a carriage return at
    the end, no fences and outside fenced blocks.  Lines keep their ends.  Keys must be unique and not
    null; null and empty texts have no lines.

    A text of at most `segment` line ends is folded where it is read.
    """
    short, long = _by_length(texts, key, text, segment)
    own = short.select("_key", F.posexplode(_runs("_t", repeatable, fence)).alias("_i", "_r"))
    own = own.select(F.col("_key").alias(key), (F.col("_i") + 1).cast("long").alias("run"), "_r.line", "_r.repeats")
    return own.unionByName(_folded(long, repeatable, fence, segment).withColumnRenamed("_key", key))


def _by_length(texts: DataFrame, key: str, text: str, segment: int) -> tuple[DataFrame, DataFrame]:
    """(_key, _t) of the texts of at most `segment` line ends, null ones among them, and of the longer ones."""
    each = texts.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    long = F.coalesce(F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))), F.lit(0)) > segment
    return each.filter(~long), each.filter(long)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(text: str, repeatable: str, fence: str) -> Column:
    """The lines of a text that stay, in order, with their repeats: array of (line, repeats)."""
    run = lambda line, repeats: F.struct(line.alias("line"), repeats.cast("long").alias("repeats"))

    def step(s, x):
        is_fence = x.bare.rlike(fence)
        free = ~is_fence & ~s.open & x.bare.rlike(repeatable)
        again = free & s.free & (s.bare == x.bare)
        return F.struct((s.open != is_fence).alias("open"), free.alias("free"), x.bare.alias("bare"), F.concat(s.marks, F.when(again, "1").otherwise("0")).alias("marks"))

    def folded_runs(lines):
        begin = F.struct(F.lit(False).alias("open"), F.lit(False).alias("free"), F.lit("").alias("bare"), F.lit("").alias("marks"))
        marks = F.aggregate(lines, begin, step).marks  # a character for each line: a string grows faster than an array
        repeats = lambda m: F.transform(F.split(F.substr(m, F.lit(2)), "0", -1), F.length)
        return _let(marks, lambda m: F.zip_with(F.filter(lines, lambda x, i: F.substr(m, i + 1, F.lit(1)) == "0"), repeats(m), lambda x, n: run(x.line, n)))

    def runs(lines):
        bare = F.transform(lines, lambda x: x.bare)
        equal = _let(bare, lambda b: F.exists(F.zip_with(b, F.slice(b, 2, F.size(b)), lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False))))
        return F.when(equal, folded_runs(lines)).otherwise(F.transform(lines, lambda x: run(x.line, F.lit(0))))

    def ended(parts):
        n = F.size(parts)
        lines = F.transform(parts, lambda l, i: F.struct(F.when(i < n - 1, F.concat(l, F.lit("\n"))).otherwise(l).alias("line"), F.regexp_replace(l, "\r$", "").alias("bare")))
        return F.filter(lines, lambda x: x.line != "")

    return _let(_let(F.split(F.coalesce(text, F.lit("")), "\n", -1), ended), runs)


def _folded(texts: DataFrame, repeatable: str, fence: str, segment: int) -> DataFrame:
    """The same, with _key, of texts(_key, _t) in segments.

    What a segment of a text needs to know of those before it is a few values: whether a block is
    open, the last line, and the number of lines kept.  Two sums over segments carry them.
    """
    each = texts.select("_key", F.posexplode(F.split("_t", "\n", -1)).alias("_i", "_l"), F.regexp_count("_t", F.lit("\n")).alias("_ends"))
    bare = F.regexp_replace("_l", "\r$", "")
    lines = each.filter("_i < _ends or _l <> ''").select(
        "_key", F.floor(F.col("_i") / segment).alias("_s"), "_i", F.when(F.col("_i") < F.col("_ends"), F.concat("_l", F.lit("\n"))).otherwise(F.col("_l")).alias("line"),
        bare.alias("_bare"), bare.rlike(fence).alias("_fence"), bare.rlike(repeatable).alias("_may"),
    )
    before = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    neighbour = Window.partitionBy("_key").orderBy("_s")
    inside = Window.partitionBy("_key", "_s").orderBy("_i")

    def carried(rows: DataFrame, *columns: Column) -> DataFrame:
        return rows.groupBy("_key", "_s").agg(*columns)

    ends = carried(lines, F.count_if("_fence").alias("_n"), F.max_by(F.struct("_bare", "_may", "_fence"), "_i").alias("_last"))
    ends = ends.select("_key", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) % 2).alias("_odd"), F.lag("_last").over(neighbour).alias("_last"))
    here = F.col("_odd") + F.sum(F.col("_fence").cast("int")).over(inside)  # fences up to this line
    own = F.struct("_bare", "_may", "_fence")
    prior = F.coalesce(F.lag(own).over(inside), F.col("_last"))
    again = F.col("_may") & ~F.col("_fence") & (F.col("_upto") % 2 == 0) & F.col("_prior._may") & ~F.col("_prior._fence") & (F.col("_prior._bare") == F.col("_bare"))
    marked = lines.join(ends, ["_key", "_s"]).withColumn("_upto", here).withColumn("_prior", prior).withColumn("_again", F.coalesce(again, F.lit(False)))

    kept = carried(marked, F.count_if(~F.col("_again")).alias("_n")).select("_key", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = marked.select("_key", "_s", "_i", "line", "_again").join(kept, ["_key", "_s"]).withColumn("run", F.col("_base") + F.sum((~F.col("_again")).cast("long")).over(inside))
    runs = numbered.groupBy("_key", "run").agg(F.any_value(F.when(~F.col("_again"), F.col("line")), ignoreNulls=True).alias("line"), F.count_if("_again").alias("repeats"))
    return runs.select("_key", "run", "line", "repeats")


def compacted(texts: DataFrame, key: str, text: str, note: tuple[str, str] = NOTE, repeatable: str = REPEATABLE, fence: str = FENCE, segment: int = SEGMENT) -> DataFrame:
    """(key, n_lines, n_folded, compacted): the texts with a note in place of the repeats; what has no lines is empty.  A compacted text is one value."""
    short, long = _by_length(texts, key, text, segment)
    kept = F.array_sort(F.collect_list(F.struct("run", F.struct("line", "repeats").alias("r"))))
    runs = short.select("_key", _runs("_t", repeatable, fence).alias("_r")).unionByName(_folded(long, repeatable, fence, segment).groupBy("_key").agg(kept.alias("_p")).select("_key", F.transform("_p", lambda p: p.r).alias("_r")))
    piece = lambda r: F.when(r.repeats > 0, F.concat(r.line, F.lit(note[0]), r.repeats.cast("string"), F.lit(note[1]))).otherwise(r.line)
    repeats = F.aggregate("_r", F.lit(0).cast("long"), lambda s, r: s + r.repeats)
    return runs.select(F.col("_key").alias(key), (F.size("_r") + repeats).alias("n_lines"), repeats.alias("n_folded"), F.array_join(F.transform("_r", piece), "").alias("compacted"))
