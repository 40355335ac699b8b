"""An index built in parts and resumed; a search that shows what it has."""

import time

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import progressive as P
from lorekeep.operators import rebuild as B

ROWS = [(1, "a short text", 0), (2, "x\n" * 3000, 0), (3, None, 0), (4, "  \n", 0), (None, "no id", 0), (5, "bad one", 0), (6, "twice", 0), (6, "twice again", 0), (7, "", 0), (8, "y" * 4500, 0)]
KIND = "id long, text string, vector int"


def _functions():
    """Local functions travel to the executors by value, as this module is not there."""

    def measured(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    def too_many(texts):
        return [[1.0]] * (len(texts) + 1)

    def of_nothing(texts):
        return [[float("nan")] for _ in texts]

    return measured, too_many, of_nothing


measured, too_many, of_nothing = _functions()


def rows_of(spark, folder):
    return sorted(tuple(r) for r in B.vectors(spark, folder).select("id", "chunk", F.col("vector").cast("string"), "error").collect())


def test_all_items_in_parts(spark, tmp_path):
    told = []
    folder = f"file://{tmp_path}/a"
    last = B.rebuild(spark.createDataFrame(ROWS, KIND), folder, measured, "id", "text", parts=3, batch=2, listen=told.append)
    assert [p.parts for p in told] == [0, 1, 2, 3] and told[-1] == last
    got = rows_of(spark, folder)
    assert sorted({(r[0], r[1]) for r in got}) == [(1, 0), (2, 0), (2, 1), (2, 2), (5, 0), (6, 0), (8, 0), (8, 1), (8, 2)]
    assert (last.embedded, last.failed) == (len(got) - 1, 1)
    assert [r[3] for r in got if r[3]] == ["ValueError: refused"]
    assert {tuple(r) for r in B.states(B.vectors(spark, folder)).select("id", "chunks", "state").collect()} == {(1, 1, "ok"), (2, 3, "ok"), (5, 1, "failed"), (6, 2, "ok"), (8, 3, "ok")}


def test_broken_off_and_resumed(spark, tmp_path):
    items = spark.createDataFrame(ROWS, KIND)
    whole, half = f"file://{tmp_path}/whole", f"file://{tmp_path}/half"
    last = B.rebuild(items, whole, measured, "id", "text", parts=4)

    def stop(p):
        if p.parts == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        B.rebuild(items, half, measured, "id", "text", parts=4, listen=stop)
    assert len(list((tmp_path / "half" / "vectors").glob("part=*"))) == 2
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "half" / "vectors").glob("part=*/_SUCCESS")}
    (tmp_path / "half" / "vectors" / "part=2").mkdir()  # a part that was not committed is written again
    assert B.rebuild(items, half, measured, "id", "text", parts=9) == last
    assert rows_of(spark, half) == rows_of(spark, whole)
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())


@pytest.mark.parametrize("embed", [too_many, of_nothing])
def test_a_model_that_answers_wrongly(spark, tmp_path, embed):
    last = B.rebuild(spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/x", embed, "id", "text", parts=2)
    assert (last.embedded, last.failed) == (0, 10)


def test_nothing_to_embed(spark, tmp_path):
    last = B.rebuild(spark.createDataFrame([], KIND), f"file://{tmp_path}/e", measured, "id", "text", parts=2)
    assert last == B.Progress(2, 2) and B.vectors(spark, f"file://{tmp_path}/e").count() == 0


def hits(spark):
    return spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, rrf double")


def test_lexical_hits_come_before_the_query_is_embedded(spark):
    told, seen = [], []

    def embed(query):
        seen.append((query, len(told)))
        return [1.0]

    last = P.progressive(hits(spark), "q", embed, lambda v: hits(spark).limit(1), told.append)
    assert seen == [("q", 1)] and [o.final for o in told] == [False, True]
    assert told[1] is last and len(told[0].rows) == 2 and len(last.rows) == 1 and last.warnings == ()


@pytest.mark.parametrize(("embed", "warning"), [(lambda q: time.sleep(30), "no answer in 0.3 seconds"), (lambda q: 1 / 0, "division by zero"), (lambda q: [], "empty or not finite"), (lambda q: [float("inf")], "empty or not finite")])
def test_without_a_vector_the_lexical_hits_are_final(spark, embed, warning):
    told = []
    began = time.time()
    last = P.progressive(hits(spark), "q", embed, lambda v: 1 / 0, told.append, embedding_seconds=0.3)
    assert time.time() - began < 15 and last.final and last.rows == told[0].rows
    assert len(last.warnings) == 1 and last.warnings[0].startswith("query embedding: ") and warning in last.warnings[0]


def test_a_late_recall_is_interrupted(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(20)
        return x

    last = P.progressive(hits(spark), "q", lambda q: [1.0], lambda v: spark.range(1).select(slow("id")), lambda o: None, recall_seconds=1.5)
    assert last.warnings == ("semantic recall: no answer in 1.5 seconds",) and [r.id for r in last.rows] == [1, 2]
    until = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < until:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
