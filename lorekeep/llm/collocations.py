"""Word collocations by hierarchical pair naming.

Words that are frequent in their language get ids.  Then, level by level, two neighbouring
frequent phrases of k - 1 words (which overlap in k - 2) are a pair, and the pairs that are
frequent get ids of their own, so that an id stands for a phrase of k words.  Ids are agreed on
by a join over all texts: texts lie in blocks, each of which knows its distinct pairs, and a
phrase's id is the least place (block, number in it) where it stands.  The two halves of a pair
are its parents; along them a phrase finds the counts of its beginnings and ends, for every cut,
and a phrase sees the longer ones that contain it.

What is shuffled are the distinct words and pairs of a block with their counts, and the blocks'
lines of numbers, pairs and lines in packed form; never single places of words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from . import caches, scratch, words
from .shingles import mix

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 12 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2

_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("code", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("line", pa.binary())])


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of their numbers, compressed."""
    n = len(columns[0])
    raw = np.ascontiguousarray(np.concatenate(columns).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return n.to_bytes(8, "little") + len(columns).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n, k = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    raw = pa.decompress(packed[16:], 8 * n * k, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(k, n)


def block_of(number: int, langs: pa.Array, texts: pa.Array) -> pa.Table:
    """A block's distinct words by language with their counts, and its line: their numbers in order, -1 between pieces."""
    data = _LOWER[np.frombuffer(b"".join(t + b"\n" for t in texts.cast(pa.large_binary()).to_pylist()), np.uint8)]
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], kind > 0]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    after = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    doc = np.searchsorted(after, starts, "right")
    names, spelled = words.Cut(data, starts, ends, np.zeros(1, np.int64)).named()
    coded = langs.dictionary_encode()
    key = coded.indices.to_numpy()[doc].astype(np.int64) * max(1, len(spelled)) + names
    distinct, line, n = np.unique(key, return_inverse=True, return_counts=True)
    fresh = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    line = np.insert(line, fresh, -1)
    m = len(distinct)
    lang = coded.dictionary.take(pa.array(distinct // max(1, len(spelled))))
    word = spelled.take(pa.array(distinct % max(1, len(spelled)))).cast(pa.binary()).cast(pa.string())
    columns = [np.full(m, number), np.arange(m), lang, word, n]
    rows = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(m, pa.binary())], schema=_BLOCK_SCHEMA)
    own = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, f.type) for f in list(_BLOCK_SCHEMA)[1:5]), pa.array([_packed(line)])], schema=_BLOCK_SCHEMA)
    return pa.Table.from_batches([rows, own])


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, code, lang, word, n) of the blocks' distinct words, and rows (block, line) of docs(lang, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size, made = 0, TaskContext.get().partitionId() << 12

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size, made
            if made >= (TaskContext.get().partitionId() + 1) << 12 or made >= 1 << 32:
                raise ValueError("a partition has at most 4096 blocks of texts, and a table 2 ** 20 partitions")
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from block_of(made, table.column(0).chunk(0), table.column(1).chunk(0)).to_batches(1 << 16)
            waiting, size, made = [], 0, made + 1

        for batch in batches:
            for lo, hi in words.portions(batch.column(1), BLOCK):
                part = batch.slice(lo, hi - lo)
                own = part.column(1).nbytes
                if waiting and size + own > BLOCK:
                    yield from flush()
                waiting.append(part)
                size += own
        if waiting:
            yield from flush()
        caches.clear()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(go, "block long, code long, lang string, word string, n long, line binary")


def named(rows: DataFrame, key: list[str], min_count: int, name: str) -> DataFrame:
    """The blocks' rows of what is frequent over all blocks, with its count f and its id, the least place of it."""
    own = F.shiftleft("block", 31) + F.col("code")  # a block has fewer than 2 ** 31 distinct phrases
    every = Window.partitionBy(*key)  # a row for each block at most
    told = rows.filter("line is null").withColumn("own", own).withColumn("f", F.sum("n").over(every)).withColumn("id", F.min("own").over(every))
    return scratch.table(told.filter(F.col("f") >= min_count).select("block", "code", *key, "own", "f", "id"), name)


def pairs(lines: DataFrame, names: DataFrame) -> DataFrame:
    """A row (block, line, pairs, ids) for each block: its distinct pairs of neighbouring frequent phrases, and the line of their numbers.

    pairs holds the pairs' parents, as steps between sorted numbers, and counts; ids the parents' ids.
    """

    def go(line: pa.Table, known: pa.Table) -> pa.Table:
        held = _unpacked(line.column("line")[0].as_py())[0]
        ids = np.full(max(1, int(held.max(initial=-1)) + 1), -1, np.int64)
        ids[known.column("code").to_numpy()] = known.column("id").to_numpy()
        frequent = (held >= 0) & (ids[held] >= 0)
        at = np.flatnonzero(frequent[:-1] & frequent[1:])
        distinct, inverse, n = np.unique(held[at] * len(ids) + held[at + 1], return_inverse=True, return_counts=True)
        new = np.full(len(held), -1, np.int64)
        new[at] = inverse
        return pa.table({"block": line.column("block").slice(0, 1), "line": [_packed(new)], "pairs": [_packed(np.diff(distinct, prepend=0), n)], "ids": [_packed(ids)]})

    both = lines.filter("line is not null").select("block", "line").groupBy("block").cogroup(names.select("block", "code", "id").groupBy("block"))
    return both.applyInArrow(go, "block long, line binary, pairs binary, ids binary")


def frequent_pairs(made: DataFrame, slices: int, min_count: int) -> DataFrame:
    """Rows (block, code, left, right, own, f, id) of the blocks' pairs that are frequent over all blocks.

    Pairs are dealt by a hash to `slices` slices, packed by block, and a slice adds up its own: a
    block has one entry for a pair, however often it stands there.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, ids in zip(*(batch.column(i) for i in range(3)), strict=True):
                steps, n = _unpacked(held.as_py())
                ids = _unpacked(ids.as_py())[0]
                key = np.cumsum(steps)
                left, right = ids[key // len(ids)], ids[key % len(ids)]
                to = (mix(left.view(np.uint64), 31) ^ mix(right.view(np.uint64), 32)) % np.uint64(slices)
                by = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[by], prepend=np.uint64(slices)))
                parts = np.split(by, cuts[1:])[: len(cuts)]
                rows = [_packed(left[p], right[p], np.diff(p, prepend=0), n[p]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(to[by][cuts].astype(np.int64)), pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["slice", "block", "packed"])
        caches.clear()

    def add(held: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py()) for x in held.column("packed")]
        left, right, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
        own = np.concatenate([(b.as_py() << 31) + np.cumsum(p[2]) for b, p in zip(held.column("block"), parts, strict=True)])
        by = np.lexsort((own, right, left))
        left, right, own, n = left[by], right[by], own[by], n[by]
        head = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        f, size = np.add.reduceat(n, head), np.diff(np.concatenate([head, [len(n)]]))
        f, id_ = np.repeat(f, size), np.repeat(own[head], size)
        good = f >= min_count
        columns = {"block": own >> 31, "code": own & ((1 << 31) - 1), "left": left, "right": right, "own": own, "f": f, "id": id_}
        return pa.table({name: pa.array(x[good], pa.int64()) for name, x in columns.items()})

    dealt = made.select("block", "pairs", "ids").mapInArrow(deal, "slice long, block long, packed binary")
    return dealt.groupBy("slice").applyInArrow(add, "block long, code long, left long, right long, own long, f long, id long")


def levels(docs: DataFrame, max_words: int, min_count: int) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words the frequent phrases, and (lang, n): all word places of a language.

    A phrase has id, lang, phrase, last (its last word), f, left and right (its parents' ids), and
    heads and tails: the counts of its first and of its last 1, 2, ... words.
    """
    rows = scratch.table(blocks(docs), "blocks")
    total = scratch.table(rows.filter("line is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    places = total.agg(F.sum("n")).first()[0] or 0
    slices = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), places >> 20)
    names = named(rows, ["lang", "word"], min_count, "names")
    none = F.array().cast("array<bigint>")
    words_ = names.filter("id = own").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("heads"), none.alias("tails"))
    found = [scratch.table(words_, "phrases")]
    for k in range(2, max_words + 1):
        made = pairs(rows, names)
        if k < max_words:
            new = scratch.table(made, "pairs")
            scratch.drop(rows)
            scratch.drop(names)
            rows, names = new, scratch.table(frequent_pairs(new, slices, min_count), "names")
            own = names
        else:
            own = frequent_pairs(made, slices, min_count)
        x = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.array_append("heads", F.col("f")).alias("heads"))
        y = found[-1].select(F.col("id").alias("right"), "last", F.array_append("tails", F.col("f")).alias("tails"))
        whole = own.filter("id = own").select("id", "left", "right", "f").join(x, "left").join(y, "right").select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "left", "right", "heads", "tails")
        found.append(scratch.table(whole, "phrases"))
    scratch.drop(rows)
    scratch.drop(names)
    return found, total


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, most: int = 2000, share: int = 50) -> DataFrame:
    """The `most` best phrases of 2 to max_words words for each language of docs(lang, text): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut at `[.,;:!?\\x0A-\\x0D]`, and these pieces into words at
    blanks and tabs.  A phrase is a candidate with a >= min_count places, overlaps included.  Of
    its cuts into l and r places of its parts the one of the least score floor(10^6 a a / (l r))
    counts, then the earliest.  A candidate goes that a longer one with at least `share` percent
    of its places contains.  Ties of score go to the larger a, then the phrase of smaller bytes.
    Null languages are `und`, null texts empty; rows that repeat count each; counts are exact
    below 10^15.  An empty table gives an empty table; other columns are ignored.
    """
    shipping.ship(docs.sparkSession)
    found, total = levels(docs, max_words, min_count)
    kept = None
    for level, longer in zip(found[1:], [*found[2:], None], strict=True):
        own = level.select("id", "lang", "phrase", "f", "heads", "tails")
        if longer is not None:
            # what contains a phrase and is longer by more words is no more frequent than what is longer by one
            inside = longer.select(F.col("left").alias("id"), F.col("f").alias("g")).union(longer.select("right", "f")).groupBy("id").agg(F.max("g").alias("g"))
            own = own.join(inside, "id", "left").filter(f"g is null or 100 * cast(g as decimal(18,0)) < {share} * cast(f as decimal(18,0))").drop("g")
        kept = own if kept is None else kept.union(own)
    d = lambda x: f"cast({x} as decimal(15,0))"
    l, r = "heads[j - 1]", "tails[size(heads) - j]"  # noqa: E741
    cuts = f"transform(sequence(1, size(heads)), j -> struct(cast(1000000 as decimal(7,0)) * ({d('f')} * {d('f')}) div ({d(l)} * {d(r)}) as score, j as k, {l} as l, {r} as r))"
    scored = kept.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    # a language's best are among the best of its 64 parts, so that no task sees more of it than 64 times `most` rows
    parted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    some = parted.withColumn("nth", best("lang", "part")).filter(F.col("nth") <= most)
    top = some.withColumn("rank", best("lang")).filter(F.col("rank") <= most)
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS (SELECT lang, a, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM t WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM t WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  WHERE NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.a = f2.a AND f3.b = f2.b AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.b = f2.a AND f3.c = f2.b AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 1, f3.f, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 2, f3.f, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
one AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
