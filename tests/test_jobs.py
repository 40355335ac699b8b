from lorekeep.streaming.jobs import job_states, step


def after(*events):
    job = None
    for generation, event, at in events:
        job = step(job, generation, event, at)
    return job and (job.generation, job.status, job.attempts)


def test_states():
    assert after((1, "claim", 0)) is None
    assert after((1, "submit", 0), (1, "submit", 1), (1, "claim", 2)) == (1, "RUNNING", 1)
    assert after((1, "submit", 0), (1, "claim", 0), (1, "claim", 29)) == (1, "RUNNING", 1)
    assert after((1, "submit", 0), (1, "claim", 0), (1, "claim", 30)) == (1, "RUNNING", 2)
    assert after((1, "submit", 0), (1, "claim", 0), (1, "heartbeat", 20), (1, "claim", 40)) == (1, "RUNNING", 1)
    assert after((1, "submit", 0), (1, "claim", 0), (1, "done", 1), (1, "fail", 2)) == (1, "DONE", 1)


def test_failures_wait_and_end():
    failed = [(1, "submit", 0), (1, "claim", 0), (1, "fail", 1)]
    assert after(*failed, (1, "claim", 5)) == (1, "PENDING", 1)
    failed += [(1, "claim", 6), (1, "fail", 7)]
    assert after(*failed, (1, "claim", 36)) == (1, "PENDING", 2)
    assert after(*failed, (1, "claim", 37), (1, "fail", 38)) == (1, "FAILED", 3)


def test_generations_fence():
    old = [(1, "submit", 0), (1, "claim", 0), (2, "submit", 1)]
    assert after(*old, (1, "done", 2)) == (2, "PENDING", 0)
    assert after(*old, (1, "submit", 2)) == (2, "PENDING", 0)
    assert after(*old, (2, "cancel", 3), (2, "claim", 4)) == (2, "CANCELLED", 0)


def test_stream(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, "session_id string, generation long, event string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        got = {}

        def put(batch, _):
            got.update({r.session_id: (r.generation, r.status, r.attempts) for r in batch.collect()})

        stream = spark.readStream.schema("session_id string, generation long, event string, at double").parquet(str(tmp_path / "in"))
        job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination(90)
        return got

    add([("a", 1, "claim", 1.0), ("a", 1, "submit", 0.0), ("b", 1, "submit", 0.0), (None, 1, "submit", 0.0)])
    assert run() == {"a": (1, "RUNNING", 1), "b": (1, "PENDING", 0)}
    add([("a", 1, "done", 2.0)])
    assert run() == {"a": (1, "DONE", 1)}
