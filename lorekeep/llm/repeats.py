"""Long passages that stand in more than one place, found in a compacted de Bruijn graph of words.

An edge of the graph is a window of `window` words, from its first to its last window - 1 words.
A text is a walk; it falls into paths, the stretches of edges whose least k-word piece (by a
hash) is one and the same place.  Equal edges have equal pieces at equal distances, so equal
edges lie in paths of one piece.  A piece with one path everywhere does not branch: its edges
repeat as often as the path does, and it is one row for each place.  Paths that are equal
compact into one; only where a piece has different paths are these taken apart into edges, each
path once with its number, and edges are counted.  Joins bring what repeats back to its places
in the texts (source coordinates), where edges grow together to the spans that go.

Paths and edges are compared by two independent 64-bit hashes together, of the piece and of
all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from . import caches, scratch, words
from .shingles import Stretches, mix, word_hashes

#: Bits of the maps that leave out pieces which stand in one place, and those which don't branch; they bear on the work only.
BITS = 26


def paths_of(cut: words.Cut, window: int, k: int) -> dict[str, np.ndarray]:
    """The paths of some texts: first window (number of its first word), how many windows, hashes of piece and path; windows' hashes one after another."""
    hashes = word_hashes(cut.data, cut.starts, cut.ends)
    n = len(hashes)
    owner = np.repeat(np.arange(len(cut.begin) - 1), np.diff(cut.begin))
    first = np.arange(n - window + 1) if n >= window else np.zeros(0, np.int64)
    inside = owner[first] == owner[first + window - 1]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return {"first": none, "size": none, "a": none, "s": none, "edges": none}
    at = np.arange(n - k + 1)
    piece = Stretches(hashes, 1).of(at, at + k)
    width, step, least = window - k + 1, 1, at

    def lesser(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(piece[y] < piece[x], y, x)  # the first of equal ones

    while 2 * step <= width:
        least = lesser(least[: len(least) - step], least[step:])
        step *= 2
    least = lesser(least[: len(first)], least[width - step :][: len(first)])
    first, least = first[inside], least[inside]
    head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([head, [len(first)]]))
    whole = Stretches(hashes, 2)
    lo, m = first[head], least[head]
    path = mix(whole.of(lo, lo + size + window - 1) + (m - lo).astype(np.uint64), 3)
    return {"first": lo, "size": size, "a": piece[m].view(np.int64), "s": path.view(np.int64), "edges": whole.of(first, first + window).view(np.int64)}


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each number that the last `bits` bits of hashes(a) take: 2 ** bits bits at any size."""
    at = F.pmod(F.col("a"), F.lit(1 << bits)) + 1
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in hashes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toLocalIterator():
        own = np.frombuffer(r.m, np.uint8)[: len(out)]
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return out


def _has(bitmap: np.ndarray, a: np.ndarray, bits: int) -> np.ndarray:
    at = a & ((1 << bits) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): docs with a number for each row: the id where it is one that no two rows share, else the table is written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if rows.schema["id"].dataType.simpleString() in ("bigint", "int"):
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("different")).first()
        if seen.n == seen.different:
            return rows.select(F.col("id").cast("long").alias("row"), "id", "text")
    return scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "rows")


def pieces(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(a, s): a row for each path of texts(row, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.portions(batch.column(0), 1 << 20):
                p = paths_of(words.cut(batch.column(0).slice(lo, hi - lo)), window, k)
                yield pa.RecordBatch.from_arrays([pa.array(p["a"]), pa.array(p["s"])], names=["a", "s"])
        caches.clear()

    return texts.select("text").mapInArrow(go, "a long, s long")


def places(texts: DataFrame, window: int, k: int, shared: np.ndarray, branching: np.ndarray, bits: int) -> DataFrame:
    """(row, first, size, a, s, edges): the paths whose piece is marked as shared; edges are null where it is not marked as branching."""
    marks = texts.sparkSession.sparkContext.broadcast((shared, branching))
    schema = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("size", pa.int32()), ("a", pa.int64()), ("s", pa.int64()), ("edges", pa.list_(pa.int64()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, forks = marks.value
        for batch in batches:
            for lo, hi in words.portions(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                cut = words.cut(part.column(1))
                p = paths_of(cut, window, k)
                open_ = _has(forks, p["a"], bits)
                ends = np.concatenate([[0], np.cumsum(np.where(open_, p["size"], 0))])
                edges = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.concatenate([~open_, [False]])), pa.array(p["edges"][np.repeat(open_, p["size"])]))
                doc = np.searchsorted(cut.begin, p["first"], "right") - 1
                columns = [part.column(0).take(pa.array(doc)), pa.array(p["first"] - cut.begin[doc]), pa.array(p["size"], pa.int32()), pa.array(p["a"]), pa.array(p["s"]), edges]
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(_has(some, p["a"], bits)))
        caches.clear()

    return texts.select("row", "text").mapInArrow(go, "row long, first long, size int, a long, s long, edges array<long>")


def repeated(texts: DataFrame, window: int, k: int, bits: int = BITS) -> DataFrame:
    """(row, start, length): stretches of words of texts(row, text) that windows which stand in two places or more cover; they may overlap."""
    met = pieces(texts, window, k).groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.min("s") < F.max("s")).alias("branching"))
    shared = scratch.table(met.filter("n > 1").select("a", "branching"), "pieces")
    found = scratch.table(places(texts, window, k, _bitmap(shared, bits), _bitmap(shared.filter("branching"), bits), bits), "places")
    scratch.drop(shared)
    # equal paths are one node, with one of their places and their number
    nodes = scratch.table(found.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row", "first", "edges"), F.struct("row", "first")).alias("of")), "nodes")
    whole = found.select("row", "first", "size", "a", "s").join(nodes.filter("n > 1").select("a", "s"), ["a", "s"], "left_semi")
    edges = nodes.filter("of.edges is not null").select("a", "n", "of.row", "of.first", F.posexplode("of.edges").alias("nth", "edge"))
    common = edges.groupBy("a", "edge").agg(F.sum("n").alias("places")).filter("places > 1")
    single = edges.filter("n = 1").join(common.select("a", "edge"), ["a", "edge"], "left_semi")
    length: Column = F.lit(window)
    return whole.select("row", F.col("first").alias("start"), (F.col("size") - 1 + length).cast("long").alias("length")).union(single.select("row", (F.col("first") + F.col("nth")).alias("start"), length.cast("long").alias("length")))


def without_repeats(docs: DataFrame, window: int = 35, k: int = 16, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, removed, kept.

    Words are runs of other characters than blanks (0x20, 0x09-0x0D), taken as they are.  Every
    word goes that a window of `window` words covers whose words also stand, in this order, at
    another place of any row, that one's own text included; no copy stays.  removed holds the
    spans (start, length) in words, in order, and kept the other words joined by one blank.
    Null and empty texts, and those of fewer words than a window, lose nothing.  Rows that repeat
    an id, or have none, are texts of their own with that id.  A text is one task's work at a
    time.  An empty table gives an empty table; other columns are ignored.
    """
    shipping.ship(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    spans = repeated(rows, window, k, bits).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))  # bounded by the row's own words
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.portions(batch.column(1), 4 << 20):
                part = batch.slice(lo, hi - lo)
                cut = words.cut(part.column(1))
                starts, lengths = part.column(2), part.column(3).flatten().to_numpy()
                count = np.array([0 if x is None else x for x in starts.value_lengths().to_pylist()], np.int64)
                head = np.repeat(cut.begin[:-1], count) + starts.flatten().to_numpy()
                over = np.zeros(cut.begin[-1] + 1, np.int64)
                np.add.at(over, head, 1)
                np.add.at(over, head + lengths, -1)
                gone = np.cumsum(over[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(gone)])[cut.begin]
                # spans end at the ends of texts
                edge = np.zeros(len(gone) + 1, bool)
                edge[cut.begin] = True
                begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
                ends = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                doc = np.searchsorted(cut.begin, begins, "right") - 1
                each = pa.StructArray.from_arrays([pa.array(begins - cut.begin[doc]), pa.array(ends - begins)], fields=list(span))
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cut.begin)), pa.array(np.diff(sums)), removed, cut.kept(~gone)], names=["id", "n_words", "n_removed", "removed", "kept"])
        caches.clear()

    kind = rows.schema["id"].dataType.simpleString()
    joined = rows.join(spans, "row", "left").select("id", "text", "starts", "lengths")
    out = joined.mapInArrow(go, f"id {kind}, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept string")
    return out.withColumnRenamed("id", id_col)


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY gram) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(35) AS t(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) AS x ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
