"""Search whose lexical hits are shown before the semantic ones are there."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession


@dataclass(frozen=True)
class Outcome:
    """The hits so far, what went wrong, and whether more is to come."""

    rows: list[Row]
    warnings: tuple[str, ...] = ()
    final: bool = False


def within(seconds: float, call: Callable[[], object], spark: SparkSession | None = None):
    """What call gives, or its error; TimeoutError when its time is over, and its Spark jobs are interrupted by their tag."""
    tag, got = f"within-{uuid.uuid4().hex}", {}

    def run() -> None:
        try:
            if spark is not None:
                spark.sparkContext.addJobTag(tag)
            got["value"] = call()
        except Exception as e:  # handed to the caller
            got["error"] = e

    thread = InheritableThread(run) if spark is not None else threading.Thread(target=run)
    thread.daemon = True  # a stalled call must not keep the driver alive
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(tag)
        raise TimeoutError(f"no answer in {seconds:g} seconds")
    if "error" in got:
        raise got["error"]
    return got["value"]


def progressive(lexical: DataFrame, query: str, embed: Callable[[str], list[float]], recall: Callable[[list[float]], DataFrame], publish: Callable[[Outcome], None], embedding_seconds: float = 8.0, recall_seconds: float = 60.0) -> Outcome:
    """Publishes lexical's rows, then those of recall(vector of the query), and returns the last outcome.

    lexical and recall's DataFrame must be cut to the hits that are shown, as they are collected.
    The lexical rows are published before the query is embedded.  Embedding and recall have a time
    each; where one fails, is late or gives no valid vector, the lexical rows are final and a
    warning says why.  An error of the lexical action itself is the caller's.
    """
    first = Outcome(lexical.collect())
    publish(first)
    stage = "query embedding"
    try:
        vector = within(embedding_seconds, lambda: embed(query))
        if not len(vector) or not all(math.isfinite(x) for x in vector):
            raise ValueError("the query's vector is empty or not finite")
        stage = "semantic recall"
        last = Outcome(within(recall_seconds, lambda: recall(vector).collect(), lexical.sparkSession), (), True)
    except Exception as e:  # whatever the injected functions raise: the search degrades
        last = Outcome(first.rows, (f"{stage}: {e}",), True)
    publish(last)
    return last
