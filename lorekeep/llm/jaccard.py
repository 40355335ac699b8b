"""N-gram Jaccard join: a size-aware, heavy-light join on sets of word shingles.

Small sets are found by enumerating their subsets of the size that a partner must share;
large sets by scanning inverted lists of the tokens in their prefixes.  The boundary
between the two is where enumerating starts to cost more than scanning, by the measured
length of the lists.  Tokens are ordered heavy last (heavy: in many documents, counted
over all of them), then by hash, so prefixes hold light tokens and lists stay short; the
few heavy tokens that remain in prefixes are handled apart.

Copies never become pairs: equal sets are one node; nodes that share a min-hash bucket
are compared with one leader of the bucket only; and the exact join then looks for links
between different components alone.  Every link between different components is found
and compared on the full sets, so components are exact.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shipping
from . import caches, scratch
from .components import components
from .shingles import hashed_sets, mix

BITS, SLICE = 24, 1 << 16
BANDS, ROWS = 8, 3
#: Entries of a list that meet in one task.
BLOCK = 1024


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The shingles that sets of these sizes must share: den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def partner_sizes(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def subset_sizes(n: int, boundary: int, num: int, den: int) -> list[int]:
    """The subset sizes that a set of n shingles enumerates to meet partners within the boundary."""
    return sorted({least_overlap(n, b, num, den) for b in partner_sizes(n, num, den) if b <= boundary})


def choose_boundary(list_length: float, num: int, den: int, most: int = 40) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the lists of the prefix."""
    best = 0
    for n in range(1, most):
        enumerate_cost = sum(math.comb(n, c) for c in subset_sizes(n, n + n * (den - num) // num, num, den))
        scan_cost = (n - -(-num * n // den) + 1) * (1 + list_length)
        if enumerate_cost > scan_cost:
            break
        best = n
    return best


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def bands(s: np.ndarray) -> list[int]:
    """Min-hash bands: the least token of each of BANDS * ROWS classes of tokens, ROWS at a time."""
    least = np.zeros(BANDS * ROWS, np.uint64)
    which, first = np.unique(s % np.uint64(BANDS * ROWS), return_index=True)
    least[which.astype(np.int64)] = s[first]
    least = least.reshape(BANDS, ROWS)
    keys = mix((least * np.array([3, 5, 7], np.uint64)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys[least.any(axis=1)].astype(np.int64).tolist()


def _packed(counts: np.ndarray) -> bytes:
    """The counts of a slice below 2 ** 32, byte by byte of the numbers: the upper bytes are mostly none."""
    bytewise = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(bytewise[: 1 + max(np.flatnonzero(bytewise.any(axis=1)), default=0)].tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    bytewise = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(-1, SLICE)
    return sum(row.astype(np.int64) << 8 * i for i, row in enumerate(bytewise))


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, n, a, b, keys) and rows of token counts (part, slice, payload).

    a, b: 128 bits that stand for the set; keys: min-hash bands.  A payload holds the bucket
    counts of one slice, added up over the task, up to 65535.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int64())), ("part", pa.int32()), ("slice", pa.int32()), ("payload", pa.binary())])

    def add(counts: np.ndarray, seen: list[np.ndarray]) -> None:
        bucket, n = np.unique(np.concatenate(seen), return_counts=True)
        counts[bucket] = np.minimum(counts[bucket] + n, 65535)

    def counted(counts: np.ndarray) -> pa.RecordBatch:
        rows = [(s, _packed(n)) for s, n in enumerate(counts.reshape(-1, SLICE)) if n.any()]
        m, part = len(rows), TaskContext.get().partitionId()
        none = [pa.nulls(m, f.type) for f in schema][:5]
        return pa.RecordBatch.from_arrays([*none, pa.array([part] * m, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("shingles")
        counts, seen, size = np.zeros(1 << BITS, np.uint16), [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                sets = hashed_sets(batch.column(1).to_pylist(), k)
                a, b, keys = [], [], []
                for s in sets:
                    a.append(int(mix(s, 11).sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(mix(s, 12).sum(dtype=np.uint64).astype(np.int64)))
                    keys.append(bands(s))
                seen.append(np.concatenate([s & np.uint64((1 << BITS) - 1) for s in sets] or [np.zeros(0, np.uint64)]).astype(np.uint32))
                size += len(seen[-1])
                m = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
                if size > 2_000_000:
                    add(counts, seen)
                    seen, size = [], 0
        if size:
            add(counts, seen)
        yield counted(counts)
        del counts, seen
        caches.clear()

    return docs.mapInArrow(go, "doc_id long, n long, a long, b long, keys array<long>, part int, slice int, payload binary")


def heavy_tokens(counts: DataFrame) -> tuple[np.ndarray, float]:
    """A bit per token bucket (set: heavy) and the mean length of a light token's list.

    A bucket is heavy if it holds more than rare tokens fill a bucket with by chance (the mean
    and four times its root), and more than 8.  The result has 2 ** BITS bits at any size of the
    corpus; it sets an order of tokens, so it bears on the work only, never on the result.
    """

    def add(frames: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for raw in frames["payload"]:
            total += _unpacked(raw)
        payload = _packed(np.minimum(total, 2**32 - 1))  # counts beyond 32 bits are heavy anyway
        return pd.DataFrame({"part": [int(frames["part"].iloc[0]) // 64], "slice": [int(frames["slice"].iloc[0])], "payload": [payload], "n": [int(total.sum())], "squares": [float((total.astype(float) ** 2).sum())]})

    kind = "part int, slice int, payload binary, n long, squares double"
    some = counts.groupBy("slice", F.floor(F.col("part") / 64)).applyInPandas(add, kind)  # at most 64 tasks' payloads meet
    sums = scratch.table(some.select("part", "slice", "payload").groupBy("slice").applyInPandas(add, kind), "counts")
    tokens = sums.agg(F.sum("n")).first()[0] or 0
    mean = tokens / (1 << BITS)
    limit = max(8.0, mean + 4 * math.sqrt(mean))

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, raw in zip(f["slice"], f["payload"], strict=True):
                n = _unpacked(raw)
                light = n[n <= limit].astype(float)
                out.append((s, np.packbits(n > limit).tobytes(), float((light**2).sum()), float(light.sum())))
            yield pd.DataFrame(out, columns=["slice", "bits", "squares", "n"])

    heavy = np.zeros((1 << BITS) // 8, np.uint8)
    squares = total = 0.0
    for r in sums.mapInPandas(mark, "slice int, bits binary, squares double, n double").collect():  # 2 ** BITS bits in all
        heavy[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = np.frombuffer(r.bits, np.uint8)
        squares, total = squares + r.squares, total + r.n
    return np.unpackbits(heavy).astype(bool), squares / max(1.0, total)


def lists(docs: DataFrame, heavy, boundary: int, k: int, num: int, den: int) -> DataFrame:
    """(node, n, calm, keys, subsets): per set the tokens of its prefix, of which the first `calm` are light, and its enumerated subsets."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("calm", pa.int32()), ("keys", pa.list_(pa.int64())), ("subsets", pa.list_(pa.int64()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("shingles")
        marked = heavy.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                out = []
                for doc, s in zip(batch.column(0).to_pylist(), hashed_sets(batch.column(1).to_pylist(), k), strict=True):
                    n, calm, own, subsets = len(s), np.zeros(0, int), np.zeros(0, int), []
                    if not n or doc is None:
                        continue
                    for c in subset_sizes(n, boundary, num, den) if n <= boundary else []:
                        base = mix(s, 21)
                        subsets += [int(mix(base[list(sub)].sum(dtype=np.uint64, keepdims=True), 1000 + c).astype(np.int64)[0]) for sub in itertools.combinations(range(n), c)]
                    if den * n // num > boundary:
                        p = prefix_length(n, num, den)
                        h = marked[(s & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                        calm = np.flatnonzero(~h)[:p]
                        own = np.concatenate([calm, np.flatnonzero(h)[: p - len(calm)]])
                    out.append((doc, n, len(calm), s[own].astype(np.int64), subsets))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        caches.clear()

    return docs.mapInArrow(go, "node long, n int, calm int, keys array<long>, subsets array<long>")


def entries_of(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light and heavy list entries (key, pos, n, calm, node, comp); pos is the place in the order of tokens, -1 for a subset."""
    subsets = F.transform("subsets", lambda x: F.struct(F.lit(-1).alias("pos"), x.alias("key")))
    tokens = F.transform("keys", lambda x, i: F.struct(i.alias("pos"), x.alias("key")))
    light = F.concat(F.slice(tokens, F.lit(1), F.col("calm")), subsets)
    dark = F.slice(tokens, F.col("calm") + 1, F.size("keys"))
    return tuple(listed.filter(F.size(e) > 0).select(F.explode(e).alias("e"), "n", "calm", "node", "comp").select("e.key", "e.pos", "n", "calm", "node", "comp") for e in (light, dark))


def bitmap_of(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit per bucket of a hash of the ids: 2 ** bits bits at any size."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in ids.groupBy(F.floor((at - 1) / 32768).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect():
        own = np.frombuffer(r.m, np.uint8)
        out[r.b * 4096 : r.b * 4096 + len(own)] = own
    return np.unpackbits(out, bitorder="little").astype(bool)


def _short(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token: within a pair of sets these tell tokens apart as well as 64 bits for all purposes."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(short: bytes) -> np.ndarray:
    whole = np.zeros((len(short) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
    return whole.view(">u8").ravel().astype(np.uint64)


def linked(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (x, y, overlap, union) of pairs(x, y) whose full sets reach the threshold.

    Only the documents in a pair are hashed again; a bitmap of fixed size leaves most others out first.
    """
    spark = docs.sparkSession
    pairs = scratch.table(pairs, "pairs")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    kept = spark.sparkContext.broadcast(np.packbits(bitmap_of(ids)))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("shingles")
        bits = np.unpackbits(kept.value).astype(bool)
        for whole in batches:
            chosen = whole.filter(pa.array(bits[whole.column(2).to_numpy()]))
            for lo in range(0, chosen.num_rows, 500):
                batch = chosen.slice(lo, 500)
                sets = hashed_sets(batch.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_short(s) for s in sets], pa.binary())], schema=schema)
        caches.clear()

    hashed = docs.filter("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)))
    sets = scratch.table(hashed.mapInArrow(go, "id long, tokens binary"), "sets")
    left, right = (sets.select(F.col("id").alias(i), F.col("tokens").alias(t)).hint("merge") for i, t in (("x", "p"), ("y", "q")))
    both = pairs.join(left, "x").join(right, "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = _long(p), _long(q)
                same = len(np.intersect1d(p, q, assume_unique=True))
                whole = len(p) + len(q) - same
                if den * same >= num * whole:
                    rows.append((x, y, same, whole))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["x", "y", "overlap", "whole"])

    out = scratch.table(both.select("x", "y", "p", "q").mapInArrow(compare, "x long, y long, overlap long, whole long"), "links")
    scratch.drop(sets)
    return out


def similar_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two documents link when den * overlap >= num * union of their sets of k-word shingles.
    component_id is the least id reachable by links, nulls aside.  Null, empty and blank texts
    have 0 shingles and are their own component.  Rows that repeat an id, or have none, are
    documents of their own with that id.  Ids may be of any type that has an order.  A text's
    length is bounded by its task's memory alone.  An empty table gives an empty table; other
    columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    if kind in ("bigint", "int"):
        seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("distinct")).first()
        if seen.n == seen.distinct:
            own = _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), k, num, den)
            return own.select(F.col("doc_id").cast(kind).alias(id_col), "n_shingles", F.col("component").cast(kind).alias("component_id"))
    # rows have numbers of their own, and a component the least id of its rows
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), "rows")
    told = scratch.table(_components(rows.select(F.col("row").alias("doc_id"), "text"), k, num, den).join(rows.select(F.col("row").alias("doc_id"), "id"), "doc_id"), "told")
    least = told.filter("component <> doc_id").select("component").distinct().join(told, "component").groupBy("component").agg(F.min("id").alias("least"))
    out = told.join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"))


def _components(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component) of texts(doc_id long, text binary), whose ids are all different: the least id reachable."""
    spark = texts.sparkSession
    shipping.ship(spark)
    told = scratch.table(summaries(texts, k), "summaries")
    marked, list_length = heavy_tokens(told.filter("payload is not null").select("part", "slice", "payload"))
    heavy = spark.sparkContext.broadcast(marked)
    boundary = choose_boundary(list_length, num, den)
    rows = scratch.table(told.filter("payload is null").drop("part", "slice", "payload"), "summaries")
    scratch.drop(told)  # the counts
    sets = scratch.table(rows.filter("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")

    # one leader for each min-hash bucket: the set that meets the most others in its buckets, as copies lie around their original
    keyed = sets.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    keyed = scratch.table(keyed.join(shared, "key"), "keyed")
    fame = keyed.groupBy("node").agg(F.sum("met").alias("fame"))
    leaders = keyed.join(fame, "node").groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("fame", -F.col("node"))).alias("leader")).select("key", F.col("leader.node").alias("leader"), F.col("leader.n").alias("m"))
    near = keyed.join(leaders, "key").filter(f"node <> leader and {den} * least(n, m) >= {num} * greatest(n, m)").select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y")).distinct()
    first = linked(texts, near, k, num, den)
    known = components(first.select("x", "y"))

    # the exact join between different components
    named = sets.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    listed = scratch.table(lists(texts, heavy, boundary, k, num, den).join(named.hint("merge"), "node"), "lists")
    light, dark = entries_of(listed)
    mixed = scratch.table(dark.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("long")).filter("low < high").select("key", "long"), "mixed")
    some, many = (dark.join(mixed.filter(f"long {which} {BLOCK}").select("key"), "key", "left_semi") for which in ("<=", ">"))
    met = _pairs(light.union(some), num, den)
    if not mixed.filter(f"long > {BLOCK}").isEmpty():
        met = met.union(_heavy_pairs(many, num, den))
    second = linked(texts, _often(met), k, num, den)
    final = components(first.select("x", "y").union(second.select("x", "y")))
    scratch.drop(listed)

    named = sets.join(final, "node", "left").select(F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, (F.col("n") == F.col("n2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component"))


def _need(num: int, den: int):
    """The shingles that the sets of list entries x and y must share."""
    return F.ceil(F.lit(num) * (F.col("x.n") + F.col("y.n")) / F.lit(float(num + den)) - 1e-9)


def _rest(num: int, den: int):
    """At most so many more than they need can be shared if the token of entries x and y is the first shared one."""
    return F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - _need(num, den)


def _may_link(num: int, den: int):
    """Of list entries x and y: different components, sizes that can link, and a token worth a row.

    A light token is one, as shared ones are counted, and a subset; a heavy one only where it can be
    the first shared token, as those are not counted.
    """
    c = F.col
    sizes = den * F.least(c("x.n"), c("y.n")) >= num * F.greatest(c("x.n"), c("y.n"))
    return (c("x.comp") != c("y.comp")) & sizes & ((c("x.pos") < 0) == (c("y.pos") < 0)) & ((c("x.pos") < c("x.calm")) | (_rest(num, den) >= 0))


def _met(x, y, num: int, den: int) -> list:
    """The columns (x, y, light, rest, ask) of entries x and y that share a token or a subset.

    Shared tokens up to where the shorter of both prefixes ends stand in both prefixes, and at most
    the rest of that set can be shared beyond it.  So of the light tokens of their prefixes sets
    that link share `ask` at least, even if all heavy ones there are shared; a subset asks for none.
    """
    c, subset = F.col, F.col("x.pos") < 0
    beyond = [F.ceil(num * c(f"{i}.n") / F.lit(float(den)) - 1e-9) - 1 for i in "xy"]  # n less the prefix
    heavy = [c(f"{i}.n") - b - c(f"{i}.calm") for i, b in zip("xy", beyond, strict=True)]
    ask = _need(num, den) - F.greatest(*beyond) - F.least(*heavy)
    kinds = (c("x.pos") < c("x.calm"), F.when(subset, 0).otherwise(_rest(num, den)), F.when(subset, 0).otherwise(ask))
    return [x.alias("x"), y.alias("y"), *[k.cast("int").alias(i) for i, k in zip(("light", "rest", "ask"), kinds, strict=True)]]


def _often(met: DataFrame) -> DataFrame:
    """The pairs (x, y) that share enough of their prefixes to link, and can share enough after the first and the last light token there."""
    rest = F.when(F.col("light") == 1, F.col("rest"))
    told = met.groupBy("x", "y").agg(F.sum("light").alias("n"), F.max("rest").alias("first"), F.min(rest).alias("last"), F.min("ask").alias("ask"))
    return told.filter("first >= 0 and n >= ask and (last is null or n + last >= 1)").select("x", "y")


def _pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """What nodes of different components that share a list have in common there."""
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _may_link(num, den)
    return entries.alias("x").join(entries.alias("y"), on).select(*_met(F.col("x.node"), F.col("y.node"), num, den))


def _heavy_pairs(entries: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """The same of long heavy lists.

    A list is cut into classes of sizes so wide that partners are of one class or of neighbours,
    and only these meet; a class of many entries is cut into blocks, each one task's work.  Without
    `calm` no token of a prefix is light.
    """
    if "calm" not in entries.columns:
        entries = entries.withColumn("calm", F.lit(0))
    size = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9))).cast("int") if den > num else F.col("n")
    entries = entries.withColumn("size", size)
    parts = entries.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    x = entries.join(parts, ["key", "size"]).withColumn("part", F.pmod(F.hash("node"), "parts"))
    y = entries.withColumnRenamed("size", "own").withColumn("size", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    y = y.join(parts, ["key", "size"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.part") == F.col("y.part"))
    once = (F.col("x.size") < F.col("y.own")) | (F.col("x.node") < F.col("y.node"))
    return x.alias("x").join(y.alias("y"), same & once & _may_link(num, den)).select(*_met(F.least("x.node", "y.node"), F.greatest("x.node", "y.node"), num, den))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
