"""Pairs of near vectors, their merge in order, and capped relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions.text import valid_vector

PIVOTS = 256
#: Numbers of a tile's vectors, and of the products that are held at once: 8 and 32 MB.
TILE, PRODUCTS = 1 << 20, 1 << 22


def _tiled(unit: DataFrame, pivots: int, tile: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """unit(id, g, v) with width, home, far and tile: tiles of a group and width have about `tile` numbers and lie in the order of homes, the nearest pivots."""
    some = unit.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()  # `pivots` vectors
    centres = {n: np.unique(np.array([r.v for r in some if len(r.v) == n]), axis=0) for n in {len(r.v) for r in some}}

    def home(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"width": vectors.map(len).astype("int32"), "home": -1, "far": 0.0})  # a width without a pivot is one home
        for n, part in vectors.groupby(out["width"].to_numpy()):
            if len(c := centres.get(n, ())):
                x = np.stack(part.to_numpy())
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))
                out.loc[part.index, "home"], out.loc[part.index, "far"] = far.argmin(1), far.min(1)
        return out

    rows = unit.select("*", F.pandas_udf(home, "width int, home int, far double")("v").alias("h")).select("id", "g", "v", "h.*")
    counts = rows.groupBy("g", "width", "home").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("g", "width").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("g").alias("g_"), F.col("width").alias("width_"), F.col("home").alias("home_"), "n", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    rows = rows.join(counts, F.col("g").eqNullSafe(F.col("g_")) & (F.col("width") == F.col("width_")) & (F.col("home") == F.col("home_")))
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) / float(1 << 20)
    at = F.floor((F.col("before") + F.col("n") * spread) / F.greatest(F.lit(64), F.floor(F.lit(tile) / F.col("width"))))
    return rows.select("id", "g", "v", "width", "home", "far", at.cast("int").alias("tile")), centres


def compared(vectors: DataFrame, threshold: float, id_col: str, group: str, vector_col: str, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(group, a, b, cosine): the pairs a < b of one group whose matrix product is within 1e-6 of `threshold` or above; their cosines are summed component by component.

    Unit vectors so close lie within w = sqrt(2 - 2 t) of each other.  The vectors of a group are
    dealt to tiles in the order of their homes, the nearest of at most `pivots` vectors chosen by a
    hash.  Two tiles meet if a ball around a home of the one and a ball around a home of the other
    are no more than w apart.  A task multiplies two tiles, of whose products it holds a slice; a
    vector is sent once for each tile that its own one meets.
    """
    spark = vectors.sparkSession
    shipping.ship(spark)
    w = float(np.sqrt(2 - 2 * (threshold - 1e-6))) + 1e-9
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    kind = vectors.schema[id_col].dataType.simpleString(), vectors.schema[group].dataType.simpleString()
    unit = vectors.filter(valid_vector(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.transform(vector_col, lambda x: x.cast("double") / norm).alias("v"))
    rows, centres = _tiled(unit, pivots, tile)

    def near(balls: pa.Table) -> pa.Table:
        n, tiles, home, far = balls["width"][0].as_py(), *(balls[c].to_numpy() for c in ("tile", "home", "far"))
        met = set()
        for t, h, r in zip(tiles, home, far, strict=True):
            between = np.sqrt(np.maximum(((centres[n][home] - centres[n][h]) ** 2).sum(1), 0)) if h >= 0 else np.zeros(len(home))
            met |= {(t, u) for u in np.unique(tiles[(between <= far + r + w + 1e-6) & (tiles >= t)])}
        one, two = (pa.array([m[i] for m in met], pa.int32()) for i in (0, 1))
        return pa.table({"g_": pa.concat_arrays([balls["g"].combine_chunks()[:1]]).take(pa.array([0] * len(met))), "width_": pa.array([n] * len(met), pa.int32()), "one": one, "two": two})

    balls = rows.groupBy("g", "width", "tile", "home").agg(F.max("far").alias("far"))
    meets = balls.groupBy("g", "width").applyInArrow(near, f"g_ {kind[1]}, width_ int, one int, two int")
    meets = meets.select("g_", "width_", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile_"))
    sent = rows.join(meets, F.col("g").eqNullSafe(F.col("g_")) & (F.col("width") == F.col("width_")) & (F.col("tile") == F.col("tile_")))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()  # two tiles
        n = whole["width"][0].as_py()
        v = whole["v"].combine_chunks().flatten().to_numpy().reshape(-1, n)
        x, y = (np.flatnonzero(whole["tile"].to_numpy() == whole[c][0].as_py()) for c in ("one", "two"))
        same, b, ids = whole["one"][0] == whole["two"][0], v[y], whole["id"].combine_chunks()
        step = max(1, PRODUCTS // len(y)) if len(y) else 1
        for lo in range(0, len(x), step):
            i, j = np.nonzero(v[x[lo : lo + step]] @ b.T >= threshold - 1e-6)
            keep = i + lo < j if same else slice(None)
            i, j = x[i[keep] + lo], y[j[keep]]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                dot = np.zeros(len(p))
                for c in range(n):
                    dot += v[p, c] * v[q, c]
                yield pa.RecordBatch.from_arrays([whole["g"].combine_chunks().take(pa.array(p)), ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(dot)], names=["g", "x", "y", "cosine"])

    parts = sent.select("id", "g", "v", "width", "tile", "one", "two").groupBy("g", "width", "one", "two")
    pairs = parts.applyInArrow(products, f"g {kind[1]}, x {kind[0]}, y {kind[0]}, cosine double").filter("x <> y")
    return pairs.select(F.col("g").alias(group), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", group: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(a, b, group, cosine) of one group with cosine >= threshold, to six places.  Vectors that are null, empty, zero or not finite have no partner, nor have those of other widths."""
    return compared(vectors, threshold, id_col, group, vector_col).select("a", "b", group, F.round("cosine", 6).alias("cosine")).filter(F.col("cosine") >= threshold)


def merge_in_order(pairs: DataFrame, session: str) -> DataFrame:
    """(session, kept, removed) of pairs(session, a, b) that are judged the same, taken in the order of (a, b): a removed item neither takes in nor is removed again.

    A session's pairs stream through one task in order; what is remembered are its removed items.
    """
    shipping.ship(pairs.sparkSession)
    kind = [pairs.schema[c].dataType.simpleString() for c in (session, "a", "b")]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gone = None, set()
        for f in frames:
            out = []
            for s, a, b in zip(f["s"], f["a"], f["b"], strict=True):
                if s != now:
                    now, gone = s, set()
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append((s, a, b))
            yield pd.DataFrame(out, columns=["s", "kept", "removed"])

    rows = pairs.select(F.col(session).alias("s"), "a", "b").repartition("s").sortWithinPartitions("s", "a", "b")
    return rows.mapInPandas(fold, f"s {kind[0]}, kept {kind[1]}, removed {kind[2]}").withColumnRenamed("s", session)


def capped_relations(pairs: DataFrame, session: str, each: int = 3, most: int = 24) -> DataFrame:
    """Of pairs(session, item, candidate, cosine) each item's `each` closest candidates (ties to the smaller), and of a session the first `most` in the order of items."""
    close = Window.partitionBy(session, "item").orderBy(F.desc("cosine"), F.asc("candidate"))
    some = pairs.withColumn("nth", F.row_number().over(close)).filter(F.col("nth") <= each)
    line = Window.partitionBy(session).orderBy("item", "nth")
    return some.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= most).select(session, "item", "candidate", "cosine", F.col("place").cast("long").alias("place"))


def same(a: Column, b: Column) -> Column:
    """A stand-in for a judge of two items: two of three pairs are the same."""
    return (a + b) % 3 != 0
