"""Log dialects against written-out files."""

import json

from pyspark.sql import functions as F

from lorekeep.sources import jsonl, logs


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def event(kind, what, **payload):
    return {"type": kind, "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": what, **payload}}


def usage(i, o):
    return event("event_msg", "token_count", info={"last_token_usage": {"input_tokens": i, "output_tokens": o}})


def test_event_log(spark, tmp_path):
    say = lambda t: event("response_item", "message", role="assistant", content=[{"type": "output_text", "text": t}])
    write(
        tmp_path / "a.jsonl", {"type": "session_meta", "payload": {"id": "s1", "cwd": "/x"}}, event("event_msg", "user_message", message="hi"), event("event_msg", "item_completed", item={"type": "UserMessage", "content": [{"type": "text", "text": "hi"}]}),
        usage(9, 9), say("one"), "{broken", event("response_item", "function_call", name="ls", arguments="{}", call_id="c"), event("response_item", "function_call_output", call_id="c", output="files"), usage(1, 2), usage(3, 4), usage(5, 6), event("event_msg", "error", message="oops"),
    )
    write(tmp_path / "b.jsonl", event("event_msg", "item_completed", item={"type": "UserMessage", "content": [{"type": "text", "text": "new"}]}), event("event_msg", "user_message", message="new"))
    got = [(r.session_id, r.ordinal, r.role, r.text, r.input_tokens, r.output_tokens) for r in logs.event_log(spark, str(tmp_path)).orderBy("session_id", "ordinal").collect()]
    assert got == [("b", 0, "user", "new", None, None), ("s1", 0, "user", "hi", None, None), ("s1", 1, "assistant", "one", 3, 4), ("s1", 2, "assistant", "ls({})", 1, 2), ("s1", 3, "tool", "files", None, None), ("s1", 4, "system", "oops", None, None)]


def test_patch_log(spark, tmp_path):
    write(
        tmp_path / "p.jsonl", {"kind": 0, "v": {"sessionId": "p", "requests": [{"message": {"text": "first"}}, {"message": {"text": "gone"}}]}}, {"kind": 1, "k": ["requests", 0, "response"], "v": [{"value": "a"}]},
        {"kind": 2, "k": ["requests", 0, "response"], "v": [{"value": "b"}, {"value": "c"}]}, {"kind": 2, "k": ["requests", 0, "response"], "i": 2}, {"kind": 3, "k": ["requests", 1]}, {"kind": 1, "k": ["requests", 1, "message", "text"], "v": "late"},
    )
    write(tmp_path / "bad.jsonl", {"kind": 1, "k": ["x"], "v": 1})
    write(tmp_path / "unknown.jsonl", {"kind": 0, "v": {"sessionId": "u", "requests": [{"message": {"text": "x"}}]}}, {"kind": 7, "k": ["requests"], "v": []})
    got = [(r.session_id, r.ordinal, r.role, r.text) for r in logs.patch_log(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("p", 0, "user", "first"), ("p", 1, "assistant", "a\nb"), ("p", 2, "user", "late")]


def test_steps_and_discovery(spark, tmp_path):
    step = lambda i, **more: {"type": "USER_INPUT", "source": "USER_EXPLICIT", "step_index": i, "content": f"t{i}", **more}
    write(tmp_path / "steps" / "c1" / "s.jsonl", step(0), step(1, conversationId="c1"))
    write(tmp_path / "steps" / "c2" / "s.jsonl", step(0), step(0))
    write(tmp_path / "steps" / "c3" / "s.jsonl", step(0, conversationId="other"))
    read = lambda: logs.step_log(spark, str(tmp_path / "steps/*/*.jsonl"))
    assert sorted((r.session_id, r.id, r.text) for r in read().collect()) == [("c1", "step-0", "t0"), ("c1", "step-1", "t1")]
    assert sorted((r.repeated, r.foreign) for r in logs.ambiguous_steps(spark, str(tmp_path / "steps/*/*.jsonl")).collect()) == [(0, 1), (1, 0)]
    found, failed = logs.discover({"steps": read, "none": lambda: logs.agent_log(spark, str(tmp_path / "missing"))})
    assert {r.source for r in found.collect()} == {"steps"} and list(failed) == ["none"]


def test_quality_and_usage(spark, tmp_path):
    line = {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": "x", "usage": {"input_tokens": 1, "cache_read_input_tokens": 20, "cache_creation_input_tokens": 300, "output_tokens": 5}}}
    write(tmp_path / "tail.jsonl", line, '{"half')
    write(tmp_path / "broken.jsonl", line, '{"half', line)
    told = jsonl.quality(spark, str(tmp_path))
    assert sorted((r.path.split("/")[-1], r.lines, r.malformed, r.partial_tail) for r in told.collect()) == [("broken.jsonl", 3, 1, False), ("tail.jsonl", 2, 1, True)]
    rows = jsonl.whole(jsonl.messages(spark, str(tmp_path)), told).collect()
    assert [(r.path.split("/")[-1], r.input_tokens, r.output_tokens) for r in rows] == [("tail.jsonl", 321, 5)]


def test_collected_logs_are_read_as_their_files_are(spark, tmp_path):
    texts = {f"s{i}": [json.dumps({"role": "user", "content": f"{i} asks\t{n}"}) for n in range(i % 5 + 1)] for i in range(40)}
    for name, rows in texts.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{name}.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "part.txt").write_text("".join(f"{name}.txt\t{r}\n" for name, rows in texts.items() for r in rows) + "no name\n")
    told = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.ordinal, r.role, r.text) for r in df.collect())
    want = told(logs.agent_log(spark, str(tmp_path / "files")))
    assert told(logs.agent_log(spark, logs.collected(spark, str(tmp_path / "all")))) == want and len(want) == sum(map(len, texts.values()))


def test_transcripts_are_written_to_few_files(spark):
    from lorekeep.plans import transcripts

    turns = spark.range(3000).selectExpr("id % 1000 as conv_id", "id as turn")
    lines = transcripts._written(turns, F.concat_ws("\n", F.col("turn").cast("string"), F.lit("more")))
    assert len(lines.inputFiles()) <= 8
    got = [(r.path, r.value) for r in lines.orderBy("path", "block", "line").collect()]
    assert got == [(f"conv_id={c}/log.txt", v) for c in sorted(range(1000), key=lambda c: f"conv_id={c}/log.txt") for t in (c, c + 1000, c + 2000) for v in (str(t), "more")]
