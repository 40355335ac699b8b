"""A semantic index built anew part by part, so that a broken-off run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from .chunks import loss_free_split

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Progress:
    """Where a rebuild stands: parts written of all, and over these the chunks embedded and failed."""

    parts: int
    of: int
    embedded: int = 0
    failed: int = 0


def _checked(vectors: list, n: int) -> list[list[float]]:
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    out = [np.asarray(v, dtype=np.float32) for v in vectors]
    if any(v.ndim != 1 or not len(v) or not np.isfinite(v).all() for v in out):
        raise ValueError("a vector is empty or not finite")
    return [v.tolist() for v in out]


def embedded(chunks: DataFrame, embed: Embedder, batch: int = 64) -> DataFrame:
    """chunks(..., text) with vector and error instead of text: `batch` texts at a time are handed to embed.

    Where a batch fails, its texts are asked for one by one, so that one bad text fails alone.
    embed is sent to the executors; a service's client should be opened inside it.
    """
    shipping.ship(chunks.sparkSession)
    names = [c for c in chunks.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, vectors, errors = frame["text"].tolist(), [], []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    vectors += _checked(embed(some), len(some))
                    errors += [None] * len(some)
                except Exception:  # whatever the injected function raises
                    for text in some:
                        try:
                            vectors += _checked(embed([text]), 1)
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield frame[names].assign(vector=vectors, error=errors)

    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in names)
    return chunks.select(*names, "text").mapInPandas(run, f"{kinds}, vector array<float>, error string")


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to path has committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _counts(vectors: DataFrame) -> tuple[int, int]:
    got = vectors.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    return got.ok, got.bad


def rebuild(items: DataFrame, folder: str, embed: Embedder, id_col: str, text_col: str, budget: int = 2000, parts: int = 64, batch: int = 64, listen: Callable[[Progress], None] | None = None) -> Progress:
    """Writes the vectors of all items' chunks under folder; called again with the same folder it goes on after the last whole part.

    The chunks are written once, dealt to `parts` folders by a hash of (id, chunk), so that a long
    text meets many parts; each part is then read from its own folder, embedded and written by a
    job of its own, and counts once that job has committed.  Items whose id is null, or whose text
    is null or blank, are left out; rows that repeat an id are one item with the chunks of them
    all; other columns are not read.  What is resumed are the first call's chunks and parts: a
    changed corpus wants a new folder.  listen hears of the start and of each part.
    """
    spark = items.sparkSession
    staged, plan = f"{folder}/chunks", f"{folder}/plan"
    kind = items.schema[id_col].dataType.simpleString()
    if not _whole(spark, staged):
        kept = items.filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        rows = kept.select("id", F.posexplode(loss_free_split(F.col("t"), budget)).alias("chunk", "text")).withColumn("h", F.xxhash64("id", "chunk"))
        dealt = rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        spark.range(parts).coalesce(1).write.mode("overwrite").parquet(plan)
        # a part's chunks come from a sixteenth of the hashes each, so that no task writes a whole part
        dealt.repartition("part", F.pmod(F.shiftright("h", 32), F.lit(16))).drop("h").write.mode("overwrite").partitionBy("part").parquet(staged)
    parts = spark.read.parquet(plan).count()
    chunks = spark.read.schema(f"id {kind}, chunk int, text string, part int").parquet(staged)
    now = Progress(0, parts)
    tell = listen or (lambda _: None)
    tell(now)
    for n in range(parts):
        path = f"{folder}/vectors/part={n}"
        if _whole(spark, path):
            ok, bad = _counts(spark.read.schema(f"id {kind}, chunk int, vector array<float>, error string").parquet(path))
        else:
            seen = Observation()
            told = embedded(chunks.filter(F.col("part") == n).drop("part"), embed, batch)
            told.observe(seen, F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).write.mode("overwrite").parquet(path)
            ok, bad = seen.get["ok"], seen.get["bad"]
        now = Progress(now.parts + 1, parts, now.embedded + ok, now.failed + bad)
        tell(now)
    return now


def vectors(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(id, chunk, vector, error) of the parts written so far."""
    return spark.read.schema(f"id {id_type}, chunk int, vector array<float>, error string, part int").parquet(f"{folder}/vectors").drop("part")


def states(rows: DataFrame) -> DataFrame:
    """(id, chunks, failed, state) of vectors: an item has failed where a chunk has no vector."""
    per = rows.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return per.withColumn("state", F.when(F.col("failed") > 0, "failed").otherwise("ok"))
