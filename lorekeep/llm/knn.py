"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot, and a pivot's group is cut into rings by the
distance to it.  A ring's summary is its size, its radius and its greatest norm; as
|q . x - q . p| <= |q| |x - p|, it bounds the scores within the ring from above.  Pivots are
rows themselves, so the products with them, and the pivots' nearest members, give each
query a score that k others reach at least, and rings whose bound is lower are not asked.
Neighbouring rings are put together, and large ones cut, into tiles of about equal size;
queries of neighbouring groups form bunches.  A query goes to the tiles that hold a ring it
asks, a tile's rows go only to the bunches that sent it a query, and each pair is solved
locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from . import scratch

SCALE = 256.0
#: Numbers that the pivots which are worked with at once may have: 32 MB.
PIVOT_NUMBERS = 1 << 22
LONG = 2**63


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, x as double; from 2^53 on doubles are whole numbers anyway."""

    def whole(x):
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, also times 256."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    cell = far.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _chained(points: np.ndarray) -> np.ndarray:
    """The points in an order in which neighbours stand together: always the nearest of those left."""
    order, left = [0], np.ones(len(points), bool)
    left[0] = False
    for _ in range(len(points) - 1):
        far = ((points - points[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return points[order]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while they hold every partial sum, Python integers beyond."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T


def _wide(score: int) -> str | None:
    """A text that orders the scores which no long holds: null for all others."""
    if -LONG <= score < LONG:
        return None
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if score > 0 else f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def bunches(queries: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """group: (first, number) of the bunches that its queries go to.

    A bunch holds neighbouring groups' queries, about `most` in all, as these need the same
    data; a group with more queries is split over bunches of its own.
    """
    out, at, held = {}, 0, 0
    for cell in sorted(queries):
        n = queries[cell]
        if held and held + n > most:
            at, held = at + 1, 0
        parts = max(1, -(-n // most))
        out[cell] = (at, parts)
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def _blocks(widths: list, pivots: int) -> list[list[tuple[int, int, float, float]]]:
    """All widths as blocks of (width, number of pivots, scale, share) whose pivots fit PIVOT_NUMBERS; pivots grow with the root of a width's rows.

    share is the part of a width's rows among which its pivots are sought: some four times as many as wanted.
    """
    out, held = [[]], 0
    for r in sorted(widths):
        n = max(1, min(pivots, math.ceil(math.sqrt(r.n)), PIVOT_NUMBERS // r.w))
        if held and held + n * r.w > PIVOT_NUMBERS:
            out.append([])
            held = 0
        out[-1].append((r.w, n, 2.0 ** -math.frexp(r.most)[1], min(1.0, (4 * n + 64) / r.n)))
        held += n * r.w
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 512, rings: int = 4, tile_rows: int = 2048, tile_queries: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: each query row's k highest scores among all other rows, ties to the smaller id.

    Vectors that are null, empty or not finite (also times 256), and rows with a null id, take
    no part; vectors of another width than the query's are never its partners.  A query's own
    row is the only one left out: rows that repeat an id are candidates, and queries, each of
    its own.  Scores are ranked exactly at any size; those beyond 64 bits are returned as the
    nearest number of 64 bits.  An empty table gives an empty table.
    """
    shipping.ship(vectors.sparkSession)
    valid = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = valid.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("w", F.size("v"))
    widths = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("queries"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).filter("queries > 0 and n > 1").collect()
    parts = [_solved(_asked(rows, block, k, rings, tile_rows, tile_queries), k) for block in _blocks(widths, pivots) if block]
    if not parts:
        kind = rows.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def candidates(own: DataFrame) -> DataFrame:
    """(w, h, v): the rows of own(w, id, v, share) of the least hashes h, about `share` of each width but one at least, repeated rows once."""
    hashed = own.select("w", "v", "share", F.xxhash64("id", "v", F.lit(5)).alias("h"))
    some = hashed.filter(F.shiftrightunsigned("h", 11) < F.col("share") * float(1 << 53)).groupBy("w", "h").agg(F.first("v").alias("v"))
    least = hashed.groupBy("w").agg(F.min(F.struct("h", "v")).alias("x")).select("w", "x.h", "x.v")
    return some.select("w", "h", "v").union(least).distinct()


def _asked(rows: DataFrame, block: list[tuple[int, int, float, float]], k: int, rings: int, tile_rows: int, tile_queries: int) -> tuple[DataFrame, DataFrame]:
    """The queries as sent, (tile, bunch, row, id, v), and the data as sent, of the same columns."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(w, share) for w, _, _, share in block], "w int, share double"))  # within PIVOT_NUMBERS
    own = rows.join(wanted, "w")
    chosen = candidates(own).collect()  # some 4 * PIVOT_NUMBERS
    points, base, at = {}, {}, 0
    scale = {w: s for w, _, s, _ in block}
    for w, n, s, _ in block:
        least = sorted((r.h, tuple(r.v)) for r in chosen if r.w == w)[:n]
        points[w] = _chained(np.unique(np.array([v for _, v in least], float) * s, axis=0))
        base[w], at = at, at + len(points[w])
    given = spark.sparkContext.broadcast((points, base, scale))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, begin, small = given.value
        for f in frames:
            for w, part in f.groupby("w"):
                x = _stacked(part["v"]) * small[w]
                cell, far = _nearest(x, centres[w])
                yield part.assign(cell=(begin[w] + cell).astype(np.int32), far=far, norm=np.sqrt((x * x).sum(1)))

    placed = own.select("id", "v", "q", "w").mapInPandas(place, f"id {kind}, v array<double>, q boolean, w int, cell int, far double, norm double")
    placed = scratch.table(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    # one row a pivot, and `rings` rows a pivot: sizes, radii, norms, and the k + 1 members nearest to it (one may be the query itself)
    stats = placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count_if("q").alias("queries"))
    stats = spark.createDataFrame(stats.collect(), stats.schema)
    ring = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("far") - F.col("low")) / (F.col("high") - F.col("low")) * rings), F.lit(rings - 1))).otherwise(0)
    ringed = placed.join(F.broadcast(stats), "cell").withColumn("ring", ring.cast("int"))
    summary = sorted(ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect())
    close = Window.partitionBy("cell", "salt").orderBy("far")
    near = placed.select("cell", "far", F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt")).withColumn("nth", F.row_number().over(close)).filter(F.col("nth") <= k + 1)
    near = {r.cell: r.near for r in near.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("far")), 1, k + 1).alias("near")).collect()}
    tiles, tile, held = [], -1, tile_rows
    begins = set(base.values())
    for g in summary:
        if g.ring == 0 and g.cell in begins:  # a tile holds one width
            held = tile_rows
        if g.n > tile_rows:
            tiles.append((g.cell, g.ring, tile + 1, -(-g.n // tile_rows)))
            tile, held = tile + tiles[-1][3], tile_rows
            continue
        if held + g.n > tile_rows:
            tile, held = tile + 1, 0
        tiles.append((g.cell, g.ring, tile, 1))
        held += g.n
    cells = np.array([g.cell for g in summary])
    asks = {}
    for w in points:
        its = np.flatnonzero((cells >= base[w]) & (cells < base[w] + len(points[w])))
        nears = np.full((len(points[w]), k + 1), np.inf)
        for j in range(len(points[w])):
            some = near.get(base[w] + j, [])
            nears[j, : len(some)] = some
        asks[w] = (cells[its] - base[w], np.array([summary[i].radius for i in its]), np.array([summary[i].norm for i in its]), [np.arange(tiles[i][2], tiles[i][2] + tiles[i][3]) for i in its], nears)
    known = spark.sparkContext.broadcast(asks)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _, small = given.value
        for whole in frames:
            for w, part in whole.groupby("w"):
                of, radius, norm, its_tiles, nears = known.value[w]
                for lo in range(0, len(part), 512):
                    f = part.iloc[lo : lo + 512]
                    q = _stacked(f["v"]) * small[w]
                    mid, size = q @ centres[w].T, np.sqrt((q * q).sum(1))
                    slack = 1e-9 * size * (norm.max() + 1)
                    sure = -np.sort(-mid, axis=1)[:, k] if mid.shape[1] > k else np.full(len(f), -np.inf)
                    members = (mid[:, :, None] - size[:, None, None] * nears[None]).reshape(len(f), -1)
                    least = -np.partition(-members, k, axis=1)[:, k] if members.shape[1] > k else np.full(len(f), -np.inf)
                    sure = np.maximum(sure, least) - slack
                    most = np.minimum(mid[:, of] + size[:, None] * radius[None], size[:, None] * norm[None])
                    need = most + slack[:, None] >= sure[:, None]
                    to = [np.unique(np.concatenate([its_tiles[j] for j in np.flatnonzero(n)])) for n in need]
                    at = np.repeat(np.arange(len(f)), [len(t) for t in to])
                    yield f.iloc[at][["bunch", "row", "id", "v"]].assign(tile=np.concatenate(to).astype(np.int32))[["tile", "bunch", "row", "id", "v"]]

    sent = f"tile int, bunch int, row long, id {kind}, v array<double>"
    spread = [(c, a, n) for c, (a, n) in bunches({r.cell: r.queries for r in stats.collect()}, tile_queries).items()]
    spread = F.broadcast(spark.createDataFrame(spread, "cell int, first int, parts int"))  # one row a pivot
    bunch = F.col("first") + F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts").cast("long")).cast("int")
    asked = placed.filter("q").join(spread, "cell").select("w", "row", "id", "v", bunch.alias("bunch"))
    asked = scratch.table(asked.mapInPandas(send, sent), "asked")
    needed = asked.groupBy(F.col("tile").alias("of")).agg(F.collect_set("bunch").alias("bunches"))  # one row a tile
    cut = F.broadcast(spark.createDataFrame(tiles, "cell int, ring int, first int, parts int"))  # `rings` rows a pivot
    tile_of = F.col("first") + F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts").cast("long")).cast("int")
    data = ringed.join(cut, ["cell", "ring"]).withColumn("tile", tile_of)
    return asked, data.join(needed, F.col("tile") == F.col("of")).select("tile", F.explode("bunches").alias("bunch"), "row", "id", "v")


def _solved(sent: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    asked, data = sent
    kind = asked.schema["id"].dataType.simpleString()

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({n: [] for n in ("row", "query_id", "id", "score", "wide")})
        if not len(q) or not len(x):
            return none
        x = x.sort_values("id", kind="stable")
        ids, rows, v, out = x["id"].to_numpy(), x["row"].to_numpy(), _stacked(x["v"]), []
        for lo in range(0, len(q), 256):
            some = q.iloc[lo : lo + 256]
            score = _products(_stacked(some["v"]), v)
            for s, row, name in zip(score, some["row"], some["id"], strict=True):
                others = rows != row
                s, who = s[others], ids[others]
                if len(s) > k:  # ids ascend, so ties go to the smaller
                    edge = np.sort(s)[-k] if s.dtype == object else np.partition(s, len(s) - k)[len(s) - k]
                    best = np.flatnonzero(s >= edge)
                    best = best[np.argsort(-s[best], kind="stable")][:k]
                else:
                    best = np.argsort(-s, kind="stable")
                out += [(row, name, i, min(max(int(x), -LONG), LONG - 1), _wide(int(x))) for i, x in zip(who[best], s[best], strict=True)]
        return pd.DataFrame(out, columns=none.columns) if out else none

    found = asked.groupBy("tile", "bunch").cogroup(data.groupBy("tile", "bunch")).applyInPandas(solve, f"row long, query_id {kind}, id {kind}, score long, wide string")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.desc_nulls_last("wide"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.r <> x.r AND len(q.e) = len(x.e)),
n AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM n WHERE n <= 5
"""
