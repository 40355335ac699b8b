"""Packing documents into token sequences by vector best-fit.

Every bin has three residual capacities: tokens, documents and attention cost (the sum
of squared piece lengths, which is what attention within a document costs).  A piece of
length l demands (l, 1, l * l).  Pieces are taken longest first; among the bins in which
all three demands fit, the one of least weighted residual norm (or of greatest weighted
dot product of demand and residual) takes it.

Pieces of one length are alike, and so are bins of one residual vector, so the packing is
worked out on the histogram of lengths, which has at most `max_tokens` rows however large
the corpus is.  Its result is a list of placements (a run of ranks within a length goes to
a run of bins), and Spark joins the pieces to it by their rank within their length.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from . import caches, scratch
from .words import distinct, portions

CACHED_WORDS = 500_000
#: Latin letters that no normalisation but lower case changes, and a last run of marks.
STEM = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"


class _Words:
    """Ids of blank-separated words as little-endian 32-bit bytes; the tokenizer splits at every blank, so a text's ids are those of its words.

    A word of Latin letters and a last run of marks is the stem's ids and those of the marks: stems are encoded many at a time, as one text, and told apart by the ids that end
    a word.  All other words are encoded one by one.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}
        known = tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values()) + 1, bool)
        self.ends[[i for t, i in known.items() if t.endswith("</w>")]] = True

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, stems: list[str]) -> None:
        """Stems of lower-case letters become known."""
        for lo in range(0, len(stems), 256):
            some = stems[lo : lo + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                data, cut = ids.tobytes(), [0, *(4 * last).tolist()]
                self.known.update(zip(some, (data[a:b] for a, b in itertools.pairwise(cut)), strict=True))
            else:  # another tokenizer, whose words end otherwise
                self.known.update((w, self.one(w)) for w in some)

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        parts = pc.extract_regex(words, STEM)
        plain = parts.is_valid()
        coded = pc.utf8_lower(parts.filter(plain).field("stem")).dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.learn([w for w in own if w not in self.known])
        marks = parts.filter(plain).field("mark").dictionary_encode()
        mark = pa.array([self.one(m) for m in marks.dictionary.to_pylist()], pa.large_binary())
        found = pa.array([self.known[w] for w in own], pa.large_binary()).take(coded.indices)
        found = pc.binary_join_element_wise(found, mark.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        rest = pa.array([self.one(w) for w in words.filter(pc.invert(plain)).to_pylist()], pa.large_binary())
        at = np.cumsum(plain.to_numpy(zero_copy_only=False)) - 1
        others = np.arange(len(words)) - at - 1 + len(found)
        return pa.concat_arrays([found, rest]).take(pa.array(np.where(plain.to_numpy(zero_copy_only=False), at, others)))


def words_of(path: str) -> _Words:
    """The word cache of this worker, kept until other work needs its memory, for a tokenizer file whose normaliser, splitter and merges end at blanks."""
    from tokenizers import Tokenizer

    return caches.only(("words", path), lambda: _Words(Tokenizer.from_file(path)))


def token_bytes(texts: pa.Array, words: _Words) -> tuple[memoryview, np.ndarray]:
    """The ids of all texts one after another as little-endian 32-bit numbers, and the byte at which each text begins."""
    found, at, begin = distinct(texts)
    ids = words.ids(found).take(pa.array(at))
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
    return memoryview(ids.buffers()[2] or b""), ends[begin]


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of that length in the input partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_of(tokenizer_path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                out: list[tuple] = []
                ids, begin = token_bytes(batch.column(1).slice(lo, hi - lo), words)
                for i, doc in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    first, last = int(begin[i]), int(begin[i + 1])
                    total = (last - first + len(end)) // 4
                    for k, at in enumerate(range(0, total, max_tokens)):
                        n = min(max_tokens, total - at)
                        crc = zlib.crc32(ids[first + 4 * at : min(first + 4 * (at + n), last)])
                        if at + n == total:
                            crc = zlib.crc32(end, crc)
                        out.append((doc, k, at, n, crc, part, seen[n]))
                        seen[n] += 1
                columns = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                del ids
        caches.trim()

    kind = docs.select(id_col).schema[0].dataType
    arrow = pa.schema([("doc_id", pa.string() if kind.simpleString() == "string" else pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
    name = "string" if kind.simpleString() == "string" else "long"
    return docs.select(F.col(id_col).cast(name).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {name}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def best_fit(histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, rank_from, rank_to, first_bin, offset, per_bin) for counts by length.

    Ranks r of [rank_from, rank_to) go to bin first_bin + (r - rank_from) // per_bin, at
    offset + (r - rank_from) % per_bin * length.  A piece that exceeds a capacity on its own
    gets a bin of its own.  Each placement uses a set of equal bins up, or ends a length.
    """
    return filled(histogram, max_tokens, max_docs, max_cost, weights, rule)[0]


def filled(histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm") -> tuple[list[tuple[int, int, int, int, int, int]], int, list[int]]:
    """The placements of `best_fit`, the number of bins, and the most documents and cost that a bin holds."""
    capacity, w = np.array([max_tokens, max_docs, max_cost], float), np.array(weights, float)
    free, first, count, bins, placed, most = np.zeros((0, 3)), [], [], 0, [], [1, 1]
    for length in sorted(histogram, reverse=True):
        demand, left, rank = np.array([length, 1, length * length], float), histogram[length], 0

        def hold(residual: np.ndarray, demand: np.ndarray = demand) -> int:
            return int(min(residual // demand))

        def put(slots: int, at: int, of: int, length: int = length) -> int:
            """Fill bins at..at+n of `of` equal ones as deeply as the pieces allow; the number of bins used."""
            nonlocal left, rank
            per = min(slots, left)
            used = min(of, left // per)
            placed.append((length, rank, rank + used * per, at, None, per))
            rank, left = rank + used * per, left - used * per
            return used

        while left:
            fits = np.flatnonzero((free >= demand).all(axis=1)) if len(free) else []
            if len(fits):
                after = (free[fits] - demand) / capacity
                score = (w * after * after).sum(axis=1) if rule == "norm" else -(w * free[fits] / capacity * demand / capacity).sum(axis=1)
                g = int(fits[np.argmin(score)])
                residual, at, of = free[g].copy(), first[g], count[g]
            else:
                slots = max(1, hold(capacity))
                g, residual, at, of = None, capacity.copy(), bins, max(1, left // slots)
                bins += of
            used = put(max(1, hold(residual)), at, of)
            per = placed[-1][5]
            placed[-1] = (*placed[-1][:4], int(max_tokens - residual[0]), per)
            rest, moved = (at + used, of - used), residual - per * demand
            most = [max(m, int(c - r)) for m, c, r in zip(most, capacity[1:], moved[1:], strict=True)]
            if g is None:
                free = np.vstack([free, moved])
                first.append(at)
                count.append(used)
            else:
                free[g], first[g], count[g] = moved, at, used
            if rest[1]:
                free = np.vstack([free, residual])
                first.append(rest[0])
                count.append(rest[1])
        full = free[:, 0] < 1
        if full.sum() > 256:  # full bins take nothing more
            keep = np.flatnonzero(~full)
            free, first, count = free[keep], [first[i] for i in keep], [count[i] for i in keep]
    return placed, bins, most


def balanced(histogram: dict[int, int], max_tokens: int, tries: int = 3, **options) -> tuple[int, int]:
    """The tightest document and cost capacities found that need no more bins than tokens alone do.

    Each is sought by halving, in `tries` steps, between what a bin holds on average and the
    most that a bin holds: the documents first, then, with that capacity, the cost.
    """
    caps = [max_tokens, max_tokens**2]
    _, least, used = filled(histogram, max_tokens, *caps, **options)
    mean = [sum(histogram.values()) / max(1, least), sum(n * x * x for x, n in histogram.items()) / max(1, least)]
    for i in (0, 1):
        low, caps[i] = mean[i], used[i]
        for _ in range(tries):
            tried = [*caps]
            tried[i] = math.ceil(math.sqrt(low * caps[i]))
            _, bins, most = filled(histogram, max_tokens, *tried, **options)
            if bins <= least:
                caps, used = tried, most
            else:
                low = tried[i]
    return caps[0], caps[1]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, max_docs: int | None = None, max_cost: int | None = None, balance: bool = False, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are their end id alone (no row without an end id).  Only documents
    longer than max_tokens are cut, however long they are.  max_docs and max_cost left out do not
    bind, or, with `balance`, are the tightest that need no more sequences (see `balanced`).  Among
    pieces of equal length, and among bins that fit equally well, the order of the input and the
    first bin decide.  Repeated rows are documents like any other; an empty table gives an empty
    table; other columns are ignored.
    """
    shipping.ship(docs.sparkSession)
    rows = scratch.table(pieces(docs, tokenizer_path, max_tokens, end_id, id_col, text_col), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    if balance:
        tight = balanced(histogram, max_tokens, **options)
        max_docs, max_cost = max_docs or tight[0], max_cost or tight[1]
    plan = best_fit(histogram, max_tokens, max_docs or max_tokens, max_cost or max_tokens**2, **options)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    spark = docs.sparkSession
    places = spark.createDataFrame(plan, "of long, rank_from long, rank_to long, first_bin long, at long, per_bin long")
    # a placement ends a length or uses a set of bins up: their number follows max_tokens, not the corpus
    places = F.broadcast(places) if len(plan) <= 64 * max_tokens else places
    placed = ranked.join(places, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), balance=True)
