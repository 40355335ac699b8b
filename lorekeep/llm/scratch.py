"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_owner: ContextVar[set[str] | None] = ContextVar("owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master that has none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors, gives the optimizer sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lorekeep/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (owner := _owner.get()) is not None:
        owner.add(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that nothing reads any more."""
    spark = df.sparkSession
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in [p for p in known if any(p.split("/")[-1] in f for f in df.inputFiles())]:
        _delete(spark, path)
        known.remove(path)


@contextmanager
def owned() -> Iterator[set[str]]:
    """The paths of the tables that this thread writes within the block; an outer block doesn't get them."""
    paths: set[str] = set()
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def hand_over(paths: set[str]) -> None:
    """Give tables to the block around, if there is one."""
    if (owner := _owner.get()) is not None:
        owner |= paths


def drop_unread(spark: SparkSession, paths: set[str], by: DataFrame) -> None:
    """Delete those of the tables that `by` does not read, and take them out of paths."""
    read = {m[1] for f in by.inputFiles() if (m := re.search(r"/lorekeep/([0-9a-f]{32}-[^/]+)/", f))}
    known = _written.get(spark.sparkContext.applicationId, [])
    gone = {p for p in paths if p.split("/")[-1] not in read}
    for path in gone & set(known):
        _delete(spark, path)
        known.remove(path)
    paths -= gone


def drop_all(spark: SparkSession) -> None:
    """Delete every table of this application; only when no DataFrame that reads them is still to run."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
