"""Registration of named queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read), read(table) giving a DataFrame, under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; a temporary one only on a local master that has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"
