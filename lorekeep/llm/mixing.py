"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are laid on a line in an order permuted by a keyed hash; the
line is read in blocks of `block_words` words, and read again where the target exceeds
the source.  A source's quota is the blocks it takes.  The shards share all blocks evenly.
A binary tree over the sources deals these out: at each node the shards' blocks are split,
by a multivariate hypergeometric draw, into those of the left half's sources and those of
the right half's, so every node keeps the sources' quotas and the shards' sizes exactly.
A source's blocks are permuted, a shard owns a run of the permuted blocks, disjoint from
all others, and is shuffled within itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .spans import let

WORD = r"[^\x20\x09-\x0D]+"


def uniform(*keys: Column | int | str) -> Column:
    """A number in [0, 1) from a hash of the keys: the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), 11) / F.lit(float(1 << 53))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with nth, their place in the order from 0, and the sums of columns over the rows before.  Ranges are summed apart, so many rows are many tasks' work."""
    cut = scratch.table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    begin = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    bases = bases.select("_part", *[F.coalesce(F.sum(f"_{c}").over(begin), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)])
    own = Window.partitionBy("_part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("nth", F.row_number().over(own) - 1).select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in sums.items()])
    placed = placed.join(F.broadcast(bases), "_part")
    return placed.select(*rows.columns, (F.col("nth") + F.col("_n")).cast("long").alias("nth"), *[(F.col(name) + F.col(f"_{c}")).alias(name) for c, name in sums.items()])


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, n_docs, weight, target) per source of sizes(source, size).

    Sources by code point, null last, take the weights in turn.  The total is `share` of all
    words; no target exceeds `most` times its source, the excess going to the others by weight.
    That fixed point is found at once: with sources in order of the level at which they fill up,
    the level of those not yet full falls below their own exactly once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = running(per, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("nth", "sid")
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.element_at(w, (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    per = running(per, [F.col("full_at"), F.col("sid")], {"cap": "filled", "weight": "passed"})
    whole = F.broadcast(per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")))  # one row
    per = per.crossJoin(whole).withColumn("rate", (share * F.col("words") - F.col("filled")) / (F.col("weights") - F.col("passed")))
    fits = F.col("rate") <= F.col("full_at")
    level = F.broadcast(per.agg(F.min_by(F.when(fits, F.col("rate")), F.when(fits, F.struct("full_at", "sid"))).alias("reached")))  # one row
    target = F.when(F.col("rate") > F.col("full_at"), F.col("cap")).otherwise(F.least("cap", F.coalesce("reached", "rate") * F.col("weight")))
    return per.crossJoin(level).withColumn("target", target).select("sid", "source", "source_size", "n_docs", "weight", "target")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` are among `drawn` draws, by inversion.

    The weights of the support follow from their ratios; beyond 12 standard deviations
    of the mean they are below the precision of a double.
    """

    def support(p):
        mean = p.drawn * p.marked / F.greatest(p.total, F.lit(1))
        wide = 12 * F.sqrt(mean * (1 - p.marked / F.greatest(p.total, F.lit(1)))) + 20
        low, high = F.greatest(F.lit(0), p.drawn + p.marked - p.total, F.floor(mean - wide)), F.least(p.drawn, p.marked, F.ceil(mean + wide))
        return F.struct(p.total, p.marked, p.drawn, p.u, low.cast("long").alias("low"), high.cast("long").alias("high"))

    def pick(p):
        steps = F.when(p.high > p.low, F.sequence(p.low, p.high - 1)).otherwise(F.array().cast("array<bigint>"))
        up = lambda x: F.log((p.marked - x) * (p.drawn - x) / ((x + 1.0) * (p.total - p.marked - p.drawn + x + 1)))  # noqa: E731  weight(x + 1) / weight(x)
        zero = F.lit(0.0)
        top = F.aggregate(steps, F.struct(zero.alias("w"), zero.alias("max")), lambda s, x: let(s.w + up(x), lambda w: F.struct(w.alias("w"), F.greatest(w, s.max).alias("max"))))
        start = lambda m: F.struct((-m).alias("w"), F.exp(-m).alias("sum"), p.low.alias("at"))

        def chosen(m):
            total = F.aggregate(steps, start(m), lambda s, x: let(s.w + up(x), lambda w: F.struct(w.alias("w"), (s.sum + F.exp(w)).alias("sum"), s.at.alias("at")))).sum
            return let(total * p.u, lambda goal: F.aggregate(steps, start(m), lambda s, x: let(s.w + up(x), lambda w: F.struct(w.alias("w"), (s.sum + F.exp(w)).alias("sum"), F.when(s.sum <= goal, x + 1).otherwise(s.at).alias("at")))).at)

        return let(top.max, chosen)

    given = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"))
    return let(let(given, support), pick)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, alloc) from quotas(key, blocks), keys 0, 1, ...: alloc[s] of the key's blocks are shard s's.

    The shards' even shares stand at the root.  A node's row holds each shard's blocks among
    the node's sources; the left half's are drawn from them without replacement, shard by
    shard: of the blocks not yet looked at, a shard's part is hypergeometric, which together
    is the multivariate draw.  Sources are rows, so their number is not bounded by a task.
    """
    total, last = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0)).cast("long"), F.max("key")).first()
    levels = (last or 0).bit_length()
    even = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    nodes = quotas.sparkSession.createDataFrame([(0, even)], "node long, alloc array<long>")
    for level in range(levels):
        lefts = quotas.filter(F.shiftright("key", levels - level - 1) % 2 == 0).groupBy(F.shiftright("key", levels - level).alias("node")).agg(F.sum("blocks").cast("long").alias("take"))
        nodes = nodes.join(lefts, "node", "left").withColumn("take", F.coalesce("take", F.lit(0)))
        begin = F.struct(F.aggregate("alloc", F.lit(0).cast("long"), lambda s, x: s + x).alias("rest"), F.col("take").alias("draws"), F.array().cast("array<bigint>").alias("left"))

        def one(s, x):
            u = uniform(seed, level, F.col("node"), F.size(s.left))  # noqa: B023
            return let(hypergeometric(s.rest, x, s.draws, u), lambda n: F.struct((s.rest - x).alias("rest"), (s.draws - n).alias("draws"), F.concat(s.left, F.array(n)).alias("left")))

        nodes = nodes.withColumn("left", F.aggregate("alloc", begin, one).left)
        halves = F.array(F.col("left"), F.zip_with("alloc", "left", lambda a, b: a - b))
        nodes = nodes.select("node", F.posexplode(halves).alias("side", "alloc")).select((F.col("node") * 2 + F.col("side")).alias("node"), "alloc")
        nodes = scratch.table(nodes.filter(F.exists("alloc", lambda x: x > 0)), "nodes")
    return nodes.select(F.col("node").alias("key"), "alloc")


#: Prime, and half of it less one too: as a multiplier it permutes the numbers below any other.
STEP = 712544676150175139


def permuted(block: Column, blocks: Column, sid: Column, seed: int) -> Column:
    """The place of a block among a source's blocks after a permutation."""
    wide = lambda c: c.cast("decimal(19,0)")
    blocks = F.greatest(blocks, F.lit(1).cast("long"))
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), sid), blocks)
    return F.pmod(wide(block) * wide(F.lit(STEP) % blocks) + wide(shift), wide(blocks)).cast("long")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, block_words: int = 1024, shards: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """Per row of docs: id, size, source_size, target, and draws: array of (epoch, shard, word_from, word_to); with `whole` also doc, the row itself.

    The words drawn from a source are its target, rounded; only the document at the end of a
    quota is cut.  A null or blank text has size 0 and no draws; a null source is a source of its
    own; repeated rows, and rows with a null id, are documents like any other.  A very long text
    is drawn in as many parts as it has blocks.  An empty table gives an empty table; other
    columns of the input are ignored.
    """
    text = F.coalesce(text_col, F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if whole else []),
    )
    sizes = scratch.table(sized.drop("doc"), "sizes")
    per = scratch.table(targets(sizes, share, weights, most), "targets").withColumn("quota", F.round("target").cast("long"))
    per = per.withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    dealt = split_quotas(per.select(F.col("sid").alias("key"), "blocks"), shards, seed)
    # the end of each shard's run of the source's permuted blocks
    ends = F.aggregate("alloc", F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))
    per = per.join(dealt.select("key", ends.alias("ends")), per.sid == F.col("key"), "left").drop("key")
    per = scratch.table(per.withColumn("buckets", F.greatest(F.ceil(F.least(F.col("n_docs") / 512, F.lit(200_000.0))), F.lit(1))).withColumnRenamed("source", "of"), "quotas")

    # prefix sums along the permuted line, in buckets so that a hot source is spread
    bucket = F.floor(F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53)) * F.col("buckets")).cast("int")
    place = lambda rows: rows.join(per.select("of", "sid", "buckets"), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket).drop("source", "of", "buckets")
    sums = place(sizes).groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    line = Window.partitionBy("sid", "bucket").orderBy(F.shiftrightunsigned("h", 11), "h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = place(sized if whole else sizes).withColumn("within", F.coalesce(F.sum("size").over(line), F.lit(0)))
    rows = rows.join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    rows = rows.join(per.select("sid", "source_size", "target", "quota", "blocks", "ends"), "sid")

    def epoch(e: Column) -> Column:
        first = e * F.col("source_size") + F.col("start")  # where the document begins on the repeated line
        last = F.least(first + F.col("size"), F.col("quota"))
        spans = F.transform(F.sequence(F.floor(first / block_words).cast("long"), F.floor((last - 1) / block_words).cast("long")), lambda j: F.struct(
            e.cast("int").alias("epoch"),
            let(permuted(j, F.col("blocks"), F.col("sid"), seed), lambda at: F.size(F.filter("ends", lambda x: x <= at))).cast("long").alias("shard"),
            (F.greatest(j * block_words, first) - first).alias("word_from"),
            (F.least((j + 1) * block_words, last) - first).alias("word_to"),
        ))
        return F.when(last > first, spans).otherwise(F.array().cast("array<struct<epoch:int,shard:bigint,word_from:bigint,word_to:bigint>>"))

    draws = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most) - 1).cast("long")), epoch))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", draws.alias("draws"), *(["doc"] if whole else []))


def drawn(draws: Column) -> Column:
    return F.aggregate(draws, F.lit(0).cast("long"), lambda s, d: s + d.word_to - d.word_from)


def mixed_documents(docs: DataFrame, seed: int = 17, most: float = 2.0, shards: int = 64, shard_col: str | None = None, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them; shard after shard, in each in shuffled order.  shard_col names a column for the shard.

    Documents stay whole: the one at the end of a quota is taken if at least half of it was drawn,
    and goes to the shard that drew its first words.  Each row has draws of its own, whatever its
    id: null and repeated ids are kept apart.
    """
    mixed = mix(docs, seed=seed, most=most, shards=shards, whole=True, **options)
    of = lambda e: F.filter("draws", lambda d: d.epoch == e)
    each = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda e: F.struct(e.alias("epoch"), drawn(of(e)).alias("words"), F.get(of(e), F.lit(0)).shard.alias("shard")))
    takes = F.filter(each, lambda t: (t.words > 0) & (2 * t.words >= F.col("size")))
    fixed = [F.col(f"doc.{c}") for c, kind in docs.dtypes if kind in ("string", "int", "bigint")]
    out = mixed.select("doc", F.explode(takes).alias("take")).withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *fixed, "take.epoch"), 11) / F.lit(float(1 << 53)))
    # a shard's rows go to partitions of its own, in ranges of the order
    pieces = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.col("take.shard") * pieces + F.floor(F.col("order") * pieces)
    out = out.repartitionById(shards * pieces, part.cast("int")).sortWithinPartitions("take.shard", "order")
    return out.select("doc.*", *([F.col("take.shard").alias(shard_col)] if shard_col else []))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Beside what the mix takes: draws, as epoch:shard:from:to of each, in words of the document, as the tree dealt them out."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", *(d[c].cast("string") for c in ("epoch", "shard", "word_from", "word_to")))), ",")
    return mixed.select("doc_id", "size", "source_size", "target", drawn(F.col("draws")).alias("taken"), F.size("draws").cast("long").alias("n_draws"), places.alias("draws"))
