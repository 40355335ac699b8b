"""Contents of one key that no earlier content contains: what a merge appends, found by joins instead of a fold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from ..plans.base import shared_folder

K, W = 8, 8  #: an anchor is the least hash of W neighbouring grams of K characters
LONG = K + W - 1  #: the characters from which a text has an anchor
#: (k, w) for texts of k + w - 1 characters or more: the longer a text, the longer and rarer the grams by which it looks for others.
LEVELS = ((K, W), (16, 8), (32, 8), (64, 16), (128, 32), (256, 64))  # powers of 2; a gram is most of a text of its level, so that it is longer than a line that many texts share
ODD = np.uint64(0x9E3779B97F4A7C15)


BITS = 1 << 24  #: of the map of short contents, at any size; a fuller map only lets more pieces through to the join
HEAD, HEADS = 4, 1 << 18  #: the characters, and the bits of a map, of the short contents' beginnings
BLOCK = 1 << 15  #: the characters of the texts that are hashed together; a longer text is hashed alone


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * ODD


def anchors(text: str) -> np.ndarray:
    """The distinct anchors of a text of at least LONG characters; those of a part of it are among them."""
    points = _points(text)
    n = len(points) - K + 1
    grams = np.zeros(n, np.uint64)
    for j in range(K):
        grams = grams * ODD + points[j : j + n]
    return np.unique(np.lib.stride_tricks.sliding_window_view(_mixed(grams), W).min(axis=1)).view(np.int64)


def bits(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length up to `most`: the bit of each piece of it, in order of place."""
    points = _points(text)
    h = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, min(most, len(points)) + 1):
        h = h[: len(points) - n + 1] * ODD + points[n - 1 :]
        yield n, (_mixed(h) >> np.uint64(40)).astype(np.int64)


@dataclass
class _Block:
    """Some texts after each other: the number of the first, their code points, for each point its text and the points from it to that text's end, and where texts begin."""

    first: int
    points: np.ndarray
    text: np.ndarray
    room: np.ndarray
    starts: np.ndarray


def _blocks(texts: pd.Series) -> Iterator[_Block]:
    """All texts that are not empty, in order."""
    whole = texts.tolist()
    sizes = np.array([len(t) for t in whole], np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(whole):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        if ends[hi - 1] > before:
            at = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            end = ends[lo:hi] - before
            yield _Block(lo, _points("".join(whole[lo:hi])), at, end[at] - np.arange(len(at)), end - sizes[lo:hi])
        lo = hi


def _doubled(block: _Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each of LEVELS that any text is long enough for: k, w and the mixed grams of k points; grams are made of two halves."""
    grams, n, power = block.points, 1, np.array([ODD])  # an array wraps around without a warning
    longest = int(block.room.max())
    for k, w in LEVELS:
        if longest < k + w - 1:
            return
        while n < k:
            grams, n, power = grams[:-n] * power + grams[n:], 2 * n, power ** 2
        yield k, w, _mixed(grams)


def _grams(block: _Block, maps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level that has a map the texts' anchors, each the least hash of w neighbouring grams of k characters, the numbers of their texts, and the map; some more than once."""
    for (k, w, least), known in zip(_doubled(block), maps, strict=False):
        if not len(known):
            continue
        n = 1
        while n < w:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[block.starts[block.starts < len(new)]] = True
        at = np.flatnonzero(new & (block.room[: len(new)] >= k + w - 1))
        yield k, least[at], block.text[at], known


def _of_key(anchors: np.ndarray, k: int, seeds: np.ndarray) -> np.ndarray:
    """The lowest three bits tell the level."""
    return _mixed(anchors ^ seeds) & ~np.uint64(7) | np.uint64([level[0] for level in LEVELS].index(k))


def _asked(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """The anchor by which a text looks for those that contain it, of its longest grams; null for short ones."""
    own, out, asks = _mixed(seeds.to_numpy(np.int64).view(np.uint64)), np.zeros(len(texts), np.uint64), np.zeros(len(texts), bool)
    for block in _blocks(texts):
        n = np.diff(block.starts, append=len(block.points))
        for k, w, grams in _doubled(block):
            at = np.flatnonzero(n >= k + w - 1)  # a longer level takes the place of a shorter one
            if len(at):
                least = np.minimum.reduceat(grams, np.stack([block.starts[at], block.starts[at] + n[at] - k + 1], 1).ravel().clip(max=len(grams) - 1))[::2]
                least = np.minimum(least, grams[block.starts[at] + n[at] - k])
                out[block.first + at], asks[block.first + at] = _of_key(least, k, own[block.first + at]), True
    return pd.Series(pd.array(out.view(np.int64), "Int64")).mask(~asks)


PROBES = 4


def _probes(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """PROBES bits of each hash in a map of `size`, each worked out when it is asked for."""
    yield ((h >> np.uint64(3)) & np.uint64(size - 1)).astype(np.int64)
    for i in range(1, PROBES):
        yield (_mixed(h + np.array([i], np.uint64) * ODD) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _marked(asked: DataFrame) -> list[np.ndarray]:
    """For each of LEVELS the map of its asked anchors, 16 bits each, 2^30 in all at most, none if there are none: packed, as they reach the driver and the tasks.

    A fuller map only lets more anchors through to the join.
    """
    counts = dict(asked.groupBy((F.col("_h").bitwiseAND(F.lit(7))).cast("int")).count().collect())
    sizes = [1 << min(27, max(16, (16 * counts[i]).bit_length())) if counts.get(i) else 0 for i in range(len(LEVELS))]
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = batch["_h"].to_numpy().view(np.uint64)
            level = (h & np.uint64(7)).astype(np.int64)
            for i in np.unique(level).tolist():
                yield pd.DataFrame({"bit": np.concatenate(list(_probes(h[level == i], sizes[i]))) + int(starts[i]) + 1})

    rows = asked.select("_h").mapInPandas(probed, "bit long")
    packed = rows.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    marked = np.zeros(int(starts[-1]) // 8, np.uint8)
    for b, m in packed.collect():
        marked[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)[: len(marked) - (b - 1) * 4096]
    return np.split(marked, starts[1:-1] // 8)


def _posted(marked: Broadcast):
    def posted(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        """The anchors of a text that any text of its key asks for."""
        maps, own, out = marked.value, _mixed(seeds.to_numpy(np.int64).view(np.uint64)), [np.zeros(0, np.int64)] * len(texts)
        maps = maps if isinstance(maps, list) else [maps] * len(LEVELS)
        for block in _blocks(texts):
            found = []
            for k, anchors, at, known in _grams(block, maps):
                h = _of_key(anchors, k, own[block.first + at])
                for i in range(PROBES):
                    places = next(itertools.islice(_probes(h, len(known) * 8), i, None))
                    met = (known[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
                    h, at = h[met], at[met]
                found.append((at, h.view(np.int64)))
            at, h = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])])[: len(h)]
            at, h = at[new], h[new]
            for t, one in zip(np.unique(at), np.split(h, np.flatnonzero(np.diff(at)) + 1), strict=False):
                out[block.first + t] = one
        return pd.Series(out)

    return posted


def _heads(points: np.ndarray, n: int) -> np.ndarray:
    """The bit of each n neighbouring points in the map of beginnings."""
    h = np.zeros(len(points) + 1, np.uint64)
    for j in range(n):
        h = h[: len(points) - j] * ODD + points[j:]
    return (_mixed(h + np.uint64(n)) >> np.uint64(64 - HEADS.bit_length() + 1)).astype(np.int64)


def _beginnings(known: np.ndarray, short: list[str]) -> np.ndarray:
    """The map of the first HEAD characters of the short contents, or of all if they have fewer."""
    for t in short:
        n = min(HEAD, len(t))
        known[_heads(_points(t[:n]), n)] = True
    return known


def _cut(known: Broadcast):
    def cut(texts: pd.Series) -> pd.Series:
        """The distinct pieces of each text of fewer than LONG characters whose bit is known, but for the text itself."""
        bits, heads = known.value
        whole, found = texts.tolist(), [set() for _ in texts]
        for block in _blocks(texts):
            points, room = block.points, block.room
            for first in range(1, min(HEAD, len(points)) + 1):
                at = np.flatnonzero(heads[_heads(points, first)] & (room[: len(points) - first + 1] >= first))
                h = np.zeros(len(at), np.uint64)
                for n in range(1, LONG if first == HEAD else first + 1):
                    fits = room[at] >= n
                    at, h = at[fits], h[fits]
                    h = h * ODD + points[at + n - 1]
                    if n >= first:
                        for i in at[bits[(_mixed(h) >> np.uint64(40)).astype(np.int64)]].tolist():
                            t = int(block.text[i])
                            j, text = i - int(block.starts[t]), whole[block.first + t]
                            if n < len(text):
                                found[block.first + t].add(text[j : j + n])
        return pd.Series([sorted(f) for f in found])

    return cut


def _whole_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bits of short contents, and after BITS those of their beginnings; from 1."""
    for batch in batches:
        short = batch["_t"].tolist()
        own = [int(at[0]) + 1 for t in short for n, at in bits(t, len(t)) if n == len(t)]
        yield pd.DataFrame({"bit": own + (np.flatnonzero(_beginnings(np.zeros(HEADS, bool), short)) + BITS + 1).tolist()})


def _known(few: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The maps of the short contents' bits and of their beginnings: at most BITS + HEADS of them reach the driver, packed.  Spark's bitmaps count from 1."""
    rows = few.select("_t").mapInPandas(_whole_bits, "bit long")
    packed = rows.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    known = np.zeros(BITS + HEADS, bool)
    for b, m in packed.collect():
        known[(b - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little"))] = True
    return known[:BITS], known[BITS:]


def trimmed(c: Column) -> Column:
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def _table(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: what several steps read is not made again."""
    path = shared_folder(df.sparkSession, f"contents-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _may_be(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with `_may`: whether their _id meets the map of ids, of BITS bits at any size, so that most of the others need no shuffle."""
    at = F.pmod(F.xxhash64("_id"), F.lit(BITS))
    word, bit = F.shiftright(at, 6).cast("int"), (at % 64).cast("int")
    words = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    told = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return told.withColumn("_may", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))).drop("_word", "_bits")


def uncontained(items: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """(keys, order, content) of the items that a merge keeps: a key's first, and those whose content, trimmed, stands in no earlier one's.

    Containment is transitive, so items left out need not be told from those kept: an item goes if any
    earlier item of its key contains it.  Equal contents meet first, in an aggregation; the first
    stays.  A content of LONG characters or more then looks for its least anchor among those of the
    others, which post only anchors that a map of all asked ones holds; what is found is compared
    whole.  Of shorter ones a map of fixed size is made, by which pieces of other texts are chosen that may equal one.  Contents are compared one by one: one that spans two others and the rule between
    them is kept.

    Blank and null contents go, unless they come first in their key (a null one stays null).  Null
    keys are keys of their own.  Rows of equal order are ordered by content.  Other columns are not
    carried.  No rows give no rows.
    """
    spark = items.sparkSession
    shipping.ship(spark)
    key = F.sha2(F.to_json(F.struct(*keys)), 256) if keys else F.lit("")
    half = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)  # noqa: E731  128 bits
    own = lambda o: F.struct(*[F.col(f"{o}.{c}").alias(c) for c in order])
    rows = items.select(key.alias("_key"), F.struct(*order).alias("_by"), F.struct(*keys, *order, content).alias("_row"), trimmed(F.coalesce(F.col(content), F.lit(""))).alias("_t"))
    k = half(F.col("_key"))
    rows = rows.select(k.alias("_k"), half(F.concat("_key", "_t")).alias("_id"), F.struct("_by.*", half(F.col("_t")).alias("_tie")).alias("_o"), "_row", "_t")
    # a text goes to Python here and when pieces of it are sought
    few = F.when(F.length("_t").between(1, LONG - 1), F.col("_t"))
    asked = F.pandas_udf(_asked, "long")("_t", F.xxhash64("_k"))
    told = rows.select("_k", "_id", "_o", "_row", (F.col("_t") == "").alias("_blank"), F.when(F.col("_t") != F.coalesce(f"_row.{content}", F.lit("")), F.col("_t")).alias("_trimmed"), asked.alias("_h"), few.alias("_few"))
    told = _table(told, "rows")
    # only what is blank may be such a first one; the least order of the others tells whether it is
    blank = told.filter("_blank").groupBy("_k").agg(F.min_by("_row", "_o").alias("_row"), F.min("_o").alias("_o"))
    rows = told.filter("not _blank").withColumn("_t", F.coalesce("_trimmed", f"_row.{content}"))
    least = rows.groupBy("_k").agg(F.min(own("_o")).alias("_least"))
    first = blank.join(least, "_k", "left").filter(F.col("_least").isNull() | (own("_o") <= F.col("_least"))).select("_row.*")

    once = rows.groupBy("_id").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_k", "_h", "_few")])  # no long text is shuffled
    once = _table(once, "once")
    ask = once.filter("_h is not null").select("_h", "_id", "_k", "_o")
    few = once.filter("_few is not null").select("_id", "_k", "_o", F.col("_few").alias("_t"))
    marked = spark.sparkContext.broadcast(_marked(ask))
    known = spark.sparkContext.broadcast(_known(few))
    posted, cut = F.pandas_udf(_posted(marked), "array<long>")("_t", F.xxhash64("_k")), F.pandas_udf(_cut(known), "array<string>")("_t")
    hits = _table(rows.select("_id", "_k", "_o", posted.alias("_h"), cut.alias("_t")).filter("size(_h) > 0 or size(_t) > 0"), "hits")

    holds = hits.select(F.explode("_h").alias("_h"), F.col("_id").alias("_in"), F.col("_k").alias("_in_k"), F.col("_o").alias("_in_o"))
    found = _table(ask.join(holds, "_h").filter("_k = _in_k and _in_o < _o").select("_id", "_in").distinct(), "found")
    texts = lambda ids: _may_be(rows.select("_id", "_t"), ids).filter("_may").select("_id", "_t").join(ids, "_id", "left_semi").dropDuplicates(["_id"])
    contained = found.join(texts(found.select("_id")), "_id")
    long = contained.join(texts(found.select(F.col("_in").alias("_id"))).select(F.col("_id").alias("_in"), F.col("_t").alias("_in_t")), "_in").filter(F.expr("contains(_in_t, _t)")).select("_id")

    earliest = hits.select("_k", "_o", F.explode("_t").alias("_t")).groupBy("_k", "_t").agg(F.min("_o").alias("_in_o"))
    short = few.join(earliest, ["_k", "_t"]).filter("_in_o < _o").select("_id")
    gone = _table(long.unionByName(short).distinct(), "gone")

    # most rows are the only one of their content and stay
    kept = _may_be(rows, gone.unionByName(once.filter("_n > 1").select("_id")))
    stays = once.join(gone, "_id", "left_anti").select("_id", F.col("_o").alias("_first"))
    chosen = kept.filter("_may").join(stays, "_id").filter("_o = _first").groupBy("_id").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.filter("not _may").select("_row.*").unionByName(chosen).unionByName(first)
