"""Vectors in blobs: round trips and what is no vector."""

import struct

from pyspark.sql import functions as F

from lorekeep.functions import blobs


def test_round_trip_and_audit(spark):
    rows = [(1, [1.5, -2.0, 3.25]), (2, []), (3, None), (4, [1.0, None, 2.0]), (5, [float("inf"), 0.0, 1.0]), (6, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("b", blobs.blob(F.col("v")))
    got = {r.id: r for r in df.select("id", "v", "b", blobs.floats(F.col("b")).alias("w"), blobs.blob_state(F.col("b"), F.lit(3)).alias("state")).collect()}
    assert bytes(got[1].b) == struct.pack("<3f", 1.5, -2.0, 3.25)
    assert all(got[i].w == got[i].v for i in (1, 2, 3, 5, 6))
    assert got[4].b is None and got[4].w is None
    assert {i: r.state for i, r in got.items()} == {1: "ok", 2: "width", 3: "missing", 4: "missing", 5: "not_finite", 6: "width"}


def test_odd_lengths_are_flagged_beside_whole_ones(spark):
    raw = [struct.pack("<2f", i, i + 0.5) + b"x" * (i % 3) for i in range(100)] + [None, b""]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)], "id int, b binary")
    got = df.select("id", blobs.floats(F.col("b")).alias("v"), blobs.blob_state(F.col("b"), F.lit(2)).alias("state")).orderBy("id").collect()
    assert [r.v for r in got] == [[float(i), i + 0.5] if i % 3 == 0 else None for i in range(100)] + [None, []]
    assert [r.state for r in got] == ["ok" if i % 3 == 0 else "odd" for i in range(100)] + ["missing", "width"]
    assert df.limit(0).select(blobs.floats(F.col("b"))).count() == 0
