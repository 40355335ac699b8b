"""Where a pattern matches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, block: int = 128) -> Column:
    """The sums of an array of longs up to each element, in blocks, so that long arrays cost little more than short ones."""
    none = F.array().cast("array<bigint>")
    last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("bigint"))
    cut = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, F.lit(block)))).otherwise(F.array(none))
    ends = lambda blocks: F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)), none, lambda s, x: F.concat(s, F.array(last(s) + x)))

    def within(x, base):
        begin = F.struct(base.alias("at"), none.alias("out"))
        return F.aggregate(x, begin, lambda s, v: F.struct((s.at + v).alias("at"), F.concat(s.out, F.array(s.at + v)).alias("out"))).out

    def summed(blocks):
        return let(ends(blocks), lambda e: F.flatten(F.transform(blocks, lambda x, i: within(x, F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))))))

    return let(values, lambda v: let(cut(v), summed))


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost first and not overlapping: array of (start, end, match, before).

    start and end count code points, end exclusive; before is the text since the previous
    match.  The pattern must not match the empty string.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def placed(p):
        steps = F.transform(p["found"], lambda m, i: (F.length(F.get(p["between"], i)) + F.length(m)).cast("bigint"))
        return let(running(steps), lambda ends: F.transform(p["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), F.get(p["between"], i).alias("before"))))

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string>>"))
