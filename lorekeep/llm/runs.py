"""Periodic runs of words, found on a harmonic grid.

A run of period p that is at least 2 * p words long holds two grid places jp and (j + 1)p with
equal words from which the period goes on p words or more, forwards and backwards taken together.
So for each period the longest common extensions of these places in both directions give every
run; over all periods that is n log n queries.  They are answered in constant time each, by a
suffix array of the words and one of the reversed words, with range minima over the common
prefixes of neighbours.  All texts of a portion share the arrays: every text's words have names
of their own, so that no extension leaves its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shipping
from . import caches, words

#: Grid places that are looked at together.
PLACES = 1 << 20
_SHORT = 4096
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions to the right of places in a sequence of numbers whose least ends differ from all others."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        order = np.argsort(names, kind="stable")
        fresh = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        rank = np.empty(n, np.int64)
        levels = []  # ranks by the first 1, 2, 4, ... numbers
        slots = np.arange(n)
        while True:
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
            alone = fresh & np.concatenate([fresh[1:], [True]])
            slots = slots[~alone]
            if not len(slots):
                break
            here = order[slots]
            key = rank[here] * n + rank[here + (1 << (len(levels) - 1))]
            by = np.argsort(key)
            order[slots], key = here[by], key[by]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
        self.rank = levels[-1]
        common = np.zeros(max(n - 1, 1), np.int32)
        near = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
        a, b, far = order[near], order[near + 1], np.zeros(len(near), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            far += (levels[k][a + far] == levels[k][b + far]).astype(np.int64) << k
        common[near] = far
        self.least = [common]

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For x and y, different everywhere, how many numbers from there on are equal."""
        p, q = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        level = np.frexp(hi - lo)[1] - 1
        while len(self.least) <= level.max(initial=0):
            below, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(below[:-step], below[step:]))
        out = np.zeros(len(x), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out


def _grid(most: int, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later place, period) of all neighbouring grid places before `most`, for periods of `least` to most / 2."""
    p = least
    while p <= most // 2:
        periods = np.arange(p, min(most // 2, p + PLACES) + 1)
        count = (most - 1) // periods
        periods = periods[: max(1, int(np.searchsorted(np.cumsum(count), PLACES, "right")))]
        count = count[: len(periods)]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        yield np.repeat(periods, count) * nth, np.repeat(periods, count)
        p = int(periods[-1]) + 1


def _small_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grids of all short texts: places by their order, so that a shorter text's come first; and how many lie before each place."""
    place, period = (np.concatenate(x) for x in zip(*_grid(2 * _SHORT), strict=True))
    by = np.argsort(place, kind="stable")
    by = by[place[by] < _SHORT]
    place, period = place[by].astype(np.int32), period[by].astype(np.int32)
    return place, period, np.searchsorted(place, np.arange(_SHORT + 1))


def runs_of(names: np.ndarray, begin: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs in texts of named words, by text, start and period; begin as in `words.Cut`."""
    small = caches.also("grid", _small_grid)
    count = np.diff(begin)
    texts = len(count)
    # place 0, and the one after each text, hold a number that stands nowhere else
    offset = begin[:-1] + np.arange(texts) + 1
    owner = np.repeat(np.arange(texts), count)
    base = int(names.max(initial=0)) + 2
    line = np.empty(len(names) + texts + 1, np.int64)
    line[0] = -1
    line[offset + count] = np.arange(texts) * base
    line[np.arange(len(names)) + owner + 1] = names + owner * base + 1
    right, left, size = Extensions(line), Extensions(line[::-1].copy()), len(line)
    found = [[np.zeros(0, np.int64)] * 3]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def extend() -> None:
        y, p = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        x = y - p
        on, back = right.of(x, y), left.of(size - x, size - y)
        good = np.flatnonzero(on + back + p >= np.maximum(min_length, 2 * p))
        found.append([(x - back)[good], (y + on)[good], p[good]])

    waiting = 0
    for at, n in zip(offset.tolist(), count.tolist(), strict=True):
        if n < min_length:
            continue
        m = small[2][n] if n <= _SHORT else 0
        for place, period in [(small[0][:m], small[1][:m])] if n <= _SHORT else _grid(n):
            y = place.astype(np.int64) + at
            same = np.flatnonzero((line[y] == line[y - period]) & (2 * period <= n))  # elsewhere the extension to the right is empty, and another place of the run is met
            if len(same):
                held.append((y[same], period[same].astype(np.int64)))
                waiting += len(same)
            if waiting > PLACES:
                extend()
                waiting = 0
    if held:
        extend()
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, end, start))  # a run is also met at multiples of its period
    start, end, period = start[by], end[by], period[by]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    start, end, period = start[by], end[by], period[by]
    text = np.searchsorted(offset, start, "right") - 1
    return text, start - offset[text], end - start, period


def periodic_runs(docs: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, runs, collapsed.

    Words are runs of other characters than blanks (0x20, 0x09-0x0D).  runs holds (start, length,
    period) of every longest stretch of words with smallest period `period` that has at least
    min_length words and two periods, by start and period.  collapsed is the text, its words
    joined by one blank, without the words that any run holds after its first period.
    Null and empty texts have no words, no runs and an empty collapsed text.  Rows that repeat an
    id, or have none, are rows of their own.  A text is one task's work and takes some 100 bytes
    of memory a word, more where it repeats itself.  An empty table gives an empty table; other
    columns are ignored.
    """
    shipping.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.portions(batch.column(1), 2 << 20):
                part = batch.slice(lo, hi - lo)
                cut = words.cut(part.column(1))
                names, _ = cut.named()
                text, start, length, period = runs_of(names, cut.begin, min_length)
                head = cut.begin[text] + start
                over = np.zeros(len(names) + 1, np.int64)
                np.add.at(over, head + period, 1)
                np.add.at(over, head + length, -1)
                kept = cut.kept(np.cumsum(over[:-1]) == 0)
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
                ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cut.begin), pa.int64()), pa.ListArray.from_arrays(ends, each), kept], names=["id", "n_words", "runs", "collapsed"])
        caches.clear()

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(go, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents of every tenth checksum of their id go on with a period of their own from a place of their own."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    one = lambda x, f: F.transform(F.array(x), f)[0]

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    found = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), one(found, repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("a"), (-r.period).alias("b"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        "doc_id", "n_runs", (-F.col("best.a")).alias("start"), "best.length", (-F.col("best.b")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.b")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
