import json

from pyspark.sql import functions as F

from lorekeep.sources import jsonl
from lorekeep.streaming.latest import write_latest


def test_jsonl(spark, tmp_path):
    rows = [
        {"type": "user", "uuid": "a", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "human", "content": "Hi there"}},
        {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "one"}, {"type": "thinking", "thinking": "two"}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    got = jsonl.messages(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.role, r.text) for r in got] == [("user", "Hi there"), ("assistant", "one\ntwo")]
    s = jsonl.sessions(jsonl.messages(spark, str(tmp_path))).first()
    assert (s.title, s.n_messages, s.input_tokens, s.output_tokens) == ("Hi there", 2, 3, 4)
    q = jsonl.quality(spark, str(tmp_path)).first()
    assert (q.lines, q.malformed) == (3, 1)


def test_latest_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    write_latest(stream, ["user_id"], ["ts", "event_id"], ["event_id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
