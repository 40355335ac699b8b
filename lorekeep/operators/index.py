"""A stored inverted index: postings with places, in blocks, sorted by term.

A segment is a Parquet table with a row for each term, column and block of documents: the
documents' ids with the term's number in each and the lengths of its column and of the whole
document, and the term's places.  A segment of FEW documents is sorted by term in files of term
ranges; postings of more are not shuffled: the tasks that read the documents write them in runs
of RUN bytes, each sorted by term, until `compact` sorts them all.  Row groups are small, so that
their statistics let a scan of exact terms or of prefixes skip most of them.  Each row
carries the greatest frequency and the least length in its block, which bounds the scores that
the block can give.  Rows of the term "" hold the lengths of all documents.  `top_terms` brings a
block's asked postings together and scores all queries on the block at once.

New documents become a new segment without touching the others; `compact` makes one of them all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions.text import folded

K1, B = 1.2, 0.75
#: Documents of a block.
BLOCK = 256
#: Bytes of a row group: what a scan skips or reads.
GROUP = 1 << 20
#: Documents of a segment that is sorted by term as a whole at once.
FEW = 1 << 15
#: Bytes of the rows that a task sorts by term before it writes them.
RUN = 96 << 20
#: Queries that are scored at once, about, and terms of a block that are multiplied at once.
QUERIES, TERMS = 512, 1024


def tokens(text: Column) -> Column:
    """The folded tokens of a text, in order."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def _inverted(block: int, ids: pa.Array, columns: list[pa.Array]) -> Iterator[dict]:
    counts = [np.diff(c.offsets.to_numpy()).astype(np.int64) for c in columns]
    total = sum(counts)
    entries = lambda i, *x: pa.StructArray.from_arrays([i, *(pa.array(v, pa.int32()) for v in x)], names=["id", "f", "l", "d"])
    for number, (column, count) in enumerate(zip(columns, counts, strict=True)):
        values = column.flatten().dictionary_encode()
        code = values.indices.to_numpy()
        doc = np.repeat(np.arange(len(ids)), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        by = np.argsort(code, kind="stable")  # documents and places stay in order
        code, doc, place = code[by], doc[by], place[by]
        pair = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))[: len(code)]
        f = np.diff(np.concatenate([pair, [len(code)]]))
        term = np.flatnonzero(np.concatenate([[True], code[pair][1:] != code[pair][:-1]]))[: len(pair)]
        own, ends = doc[pair], np.concatenate([term, [len(pair)]])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)  # noqa: B023, E731
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([pair, [len(code)]]), pa.int32()), pa.array(place, pa.int32()))
        if len(term):
            yield {
                "term": values.dictionary.take(pa.array(code[pair][term])), "col": [number] * len(term), "block": [block] * len(term), "n": np.diff(ends), "most": np.maximum.reduceat(f, term), "least": np.minimum.reduceat(count[own], term),
                "docs": lists(entries(ids.take(pa.array(own)), f, count[own], total[own])), "places": lists(places),
            }
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x)
        yield {"term": [""], "col": [number], "block": [block], "n": [len(ids)], "most": [0], "least": [int(count.min(initial=0))], "docs": whole(entries(ids, 0 * count, count, total)), "places": pa.array([[]], pa.list_(pa.list_(pa.int32())))}


def add(docs: DataFrame, folder: str, id_col: str, columns: list[str]) -> None:
    """Write docs as a new segment of the index in folder.  Null texts are empty; ids may be of any type, and two rows of one id are two documents."""
    spark = docs.sparkSession
    shipping.ship(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    at_once = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < at_once:  # a small table in few files
        docs = docs.repartition(at_once)
    rows = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])

    names = ["term", "col", "block", "n", "most", "least", "docs", "places"]

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                part = whole.slice(lo, BLOCK)
                for r in _inverted(block, part.column(0), part.columns[1:]):
                    small = {"col", "n", "most", "least"}
                    arrays = [pa.array(r[c], pa.int32()) if c in small else pa.array(r[c], pa.int64()) if c == "block" else r[c] if isinstance(r[c], pa.Array) else pa.array(r[c]) for c in names]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                block += 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = [], 0
        for part in inverted(batches):
            run.append(part)
            held += part.nbytes
            if held >= RUN:
                yield from _in_order(run)
                run, held = [], 0
        if run:
            yield from _in_order(run)

    shape = f"term string, col int, block long, n int, most int, least int, docs array<struct<id:{kind},f:int,l:int,d:int>>, places array<array<int>>"
    inverted_rows, segment = rows.mapInArrow(go, shape), f"{folder}/segment-{uuid.uuid4().hex}"
    if docs.count() > FEW:
        _written(inverted_rows, segment)
        return
    raw = f"{folder}/raw-{uuid.uuid4().hex}"
    inverted_rows.write.parquet(raw)
    _sorted(spark.read.schema(shape).parquet(raw), segment)
    _delete(spark, raw)


def _in_order(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some blocks by term, column and block, in batches."""
    rows = pa.Table.from_batches(run)
    by = pc.sort_indices(rows.select(["term", "col", "block"]), sort_keys=[("term", "ascending"), ("col", "ascending"), ("block", "ascending")])
    for lo in range(0, len(by), 4096):
        yield from rows.take(by.slice(lo, 4096)).combine_chunks().to_batches()


def _sorted(rows: DataFrame, path: str) -> None:
    """Terms by ranges of files; the blocks of a frequent term may lie in several."""
    _written(rows.repartitionByRange("term", "col", "block").sortWithinPartitions("term", "col", "block"), path)


def _written(rows: DataFrame, path: str) -> None:
    rows.write.option("parquet.block.size", GROUP).option("compression", "zstd").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def segments(spark: SparkSession, folder: str) -> list[str]:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/segment-*/_SUCCESS")
    return [str(s.getPath().getParent()) for s in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)]


def compact(spark: SparkSession, folder: str) -> None:
    """One segment of all; the old ones go when it is whole."""
    old = segments(spark, folder)
    _sorted(spark.read.parquet(*old), f"{folder}/segment-{uuid.uuid4().hex}")
    for path in old:
        _delete(spark, path)


def postings(spark: SparkSession, folder: str, exact: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """The rows of these terms and prefixes in all segments: what the scan's statistics rule out is not read."""
    rows = spark.read.parquet(*segments(spark, folder))
    wanted = F.col("term").isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("term").startswith(p)
    return rows.filter(wanted)


def lengths(spark: SparkSession, folder: str, col: int | None) -> DataFrame:
    """One row (n_docs, avg_length) over all documents: of one column, or of them all."""
    own = spark.read.parquet(*segments(spark, folder)).filter("term = ''").filter(F.col("col") == (col or 0))
    summed = F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + (x.l if col is not None else x.d))
    return own.agg(F.sum("n").alias("n_docs"), (F.sum(summed) / F.sum("n")).alias("avg_length"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def part(f: Column, length: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def search(spark: SparkSession, folder: str, phrases: list[str], weights: dict[int, float], n_columns: int) -> DataFrame:
    """(id, score): BM25 of one query, an OR of phrases whose last token is a prefix, over the weighted columns of the index.

    phrases are token lines.  A phrase counts at every place where it begins, overlapping ones
    too.  Only the postings of the phrases' tokens are read.  weights are of all columns or of
    one, whose lengths then count.
    """
    cut = [p.split() for p in phrases]
    rows = postings(spark, folder, sorted({t for p in cut for t in p[:-1]}), sorted({p[-1] for p in cut}))
    rows = rows.filter(F.col("col").isin(*weights)).select("term", "col", F.explode(F.arrays_zip("docs", "places").alias("x")).alias("x"))
    rows = rows.select("term", "col", "x.docs.id", "x.places", F.col("x.docs.d" if len(weights) == n_columns else "x.docs.l").alias("length"))
    slot = lambda p, i, t: F.when(F.col("term").startswith(t) if i == len(cut[p]) - 1 else F.col("term") == t, F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")))
    slots = F.filter(F.array(*[slot(p, i, t) for p, own in enumerate(cut) for i, t in enumerate(own)]), lambda s: s.isNotNull())
    each = rows.select("id", "col", "length", "places", F.explode(slots).alias("s"))
    begins = each.select("id", "col", "length", "s.p", F.struct("s.i", F.transform("places", lambda x: x - F.col("s.i")).alias("at")).alias("b"))
    met = begins.groupBy("id", "p", "col").agg(F.collect_list("b").alias("b"), F.max("length").alias("length"))  # bounded by the document

    def begin(i: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter("b", lambda x: x.i == i), lambda x: x["at"])))

    def count(n: int) -> Column:
        common = begin(0)
        for i in range(1, n):
            common = F.array_intersect(common, begin(i))
        return F.size(common)

    n = F.lit(0)
    for p, own in enumerate(cut):
        n = F.when(F.col("p") == p, count(len(own))).otherwise(n)
    weight = F.lit(0.0)
    for c, w in weights.items():
        weight = F.when(F.col("col") == c, float(w)).otherwise(weight)
    counted = met.select("id", "p", "length", n.alias("n"), (weight * n).alias("f")).filter("n > 0").groupBy("id", "p").agg(F.sum("f").alias("f"), F.max("length").alias("length"))
    df = counted.groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    only = next(iter(weights)) if len(weights) == 1 and n_columns > 1 else None
    known = df.join(F.broadcast(lengths(spark, folder, only)))  # a row for each phrase
    scored = counted.join(F.broadcast(known), "p").select("id", (idf(F.col("n_docs"), F.col("df")) * part(F.col("f"), F.col("length"), F.col("avg_length"))).alias("s"))
    return scored.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))


def top_terms(spark: SparkSession, folder: str, queries: DataFrame, col: int, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best documents for each query of queries(query_id, term), scored in one column.

    The asked postings are dealt by block, once for each QUERIES queries.  A block's task scores all
    of its documents for all of these queries and passes on those that can be among a query's k
    best, so no row is shuffled for each query and document.  Documents of one id are added up.
    """
    shipping.ship(spark)
    queries = queries.select("query_id", "term").distinct()
    index = spark.read.parquet(*segments(spark, folder)).filter(F.col("col") == col)
    kept = lambda df, name: (df.write.parquet(path := f"{folder}/{name}-{uuid.uuid4().hex}"), spark.read.schema(df.schema).parquet(path))[1]
    queries = kept(queries, "queries")  # from here on Spark knows the size
    df = index.select("term", "n").join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    known = df.join(F.broadcast(lengths(spark, folder, col))).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_length")
    groups = -(-queries.select("query_id").distinct().count() // QUERIES)
    deal = F.pmod(F.xxhash64("query_id"), F.lit(max(1, groups))).cast("int")
    asked = kept(queries.groupBy("term", deal.alias("part")).agg(F.collect_list(F.struct("query_id")).alias("q")).join(known, "term"), "asked")
    own = index.join(asked, "term").select("part", "block", "q.query_id", "idf", "avg_length", F.col("docs.id").alias("id"), F.col("docs.f").alias("f"), F.col("docs.l").alias("l"))

    # ids of several documents: rows of ids alone name them to the tasks of their blocks
    listed = index.filter("term = ''").select("block", F.explode("docs.id").alias("id"))
    twice = kept(listed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "twice")
    several = not twice.isEmpty()
    if several:
        named = listed.alias("x").join(twice.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id"))).groupBy("block").agg(F.collect_list(F.struct("x.id")).alias("ids"))
        none = {f.name: F.lit(None).cast(f.dataType) for f in own.schema if f.name not in ("part", "block", "id")}
        own = own.unionByName(named.select("block", F.col("ids.id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(max(1, groups) - 1))).alias("part")).withColumns(none))

    types = {f.name: f.dataType for f in own.schema}
    shape = f"query_id {types['query_id'].elementType.simpleString()}, id {types['id'].elementType.simpleString()}, score double"
    out = own.groupBy("part", "block").applyInArrow(lambda rows: _best(rows, k), shape)
    hits = out.groupBy("query_id", "id").agg(F.sum("score").alias("score")) if several else out
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def _best(rows: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score) of one block: all that can be among a query's k best, and the ids of several documents.

    rows(query_id, idf, avg_length, id, f, l) has a row for each term, with the queries that ask it
    and the documents that hold it; a row without queries names ids of several documents.
    """
    coded = lambda c: pc.dictionary_encode(c.combine_chunks().flatten(), null_encoding="encode")
    owner = lambda c: pc.list_parent_indices(c.combine_chunks()).to_numpy()
    asked = rows.filter(pc.is_valid(rows["query_id"]))
    queries, ids = coded(asked["query_id"]), coded(rows["id"])
    n, m = len(queries.dictionary), len(ids.dictionary)
    single = np.ones(m, bool)
    named = rows.filter(pc.is_null(rows["query_id"]))
    if len(named):
        single[pc.index_in(named["id"].combine_chunks().flatten(), ids.dictionary).to_numpy()] = False
    doc = pc.index_in(asked["id"].combine_chunks().flatten(), ids.dictionary).to_numpy()
    f, length = (asked[c].combine_chunks().flatten().to_numpy().astype(float) for c in ("f", "l"))
    term, average, weight = owner(asked["id"]), asked["avg_length"].to_numpy(), asked["idf"].to_numpy()
    value = part(f, length, average[term])
    asks, query = owner(asked["query_id"]), queries.indices.to_numpy()
    scores = np.zeros((n, m))
    for lo in range(0, len(asked), TERMS):
        hi = min(lo + TERMS, len(asked))
        a, b = np.searchsorted(asks, [lo, hi])
        weights = np.zeros((n, hi - lo))
        weights[query[a:b], asks[a:b] - lo] = weight[asks[a:b]]
        a, b = np.searchsorted(term, [lo, hi])
        scores += weights @ np.bincount((term[a:b] - lo) * m + doc[a:b], value[a:b], (hi - lo) * m).reshape(hi - lo, m)
    kept = scores > 0
    if m > k:  # scores are rounded later
        kept &= (scores >= np.partition(scores, m - k, axis=1)[:, m - k, None] - 2e-6) | ~single
    x, y = np.nonzero(kept)
    return pa.table({"query_id": queries.dictionary.take(pa.array(x)), "id": ids.dictionary.take(pa.array(y)), "score": scores[x, y]})
