import json
import sqlite3
from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep import shipping
from lorekeep.functions import documents as D
from lorekeep.operators import sinks
from lorekeep.sources import sqlite, transcripts


@given(st.text(alphabet="a\n# é漢😀", max_size=60), st.integers(4, 12))
def test_volumes_lose_nothing(text, most):
    parts = D._volumes(text, most)
    assert "".join(parts) == text
    assert all(len(p.encode()) <= most for p in parts)
    assert parts == [""] or all(parts)


def test_volumes_prefer_headings_then_lines():
    assert D._volumes("aaaaaa\n## b\nccc", 14) == ["aaaaaa\n", "## b\nccc"]
    assert D._volumes("aaaaaa\nbbbbb", 10) == ["aaaaaa\n", "bbbbb"]
    assert D._volumes("a\nbbbbbbbbbbbb", 10) == ["a\nbbbbbbbb", "bbbb"]


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_line_diff_is_exact(a, b):
    rows = D._diff(a, b)
    assert [t for k, t in rows if k != "added"] == a
    assert [t for k, t in rows if k != "removed"] == b
    common = max(bin(m).count("1") for m in range(1 << len(a)) if _within([x for i, x in enumerate(a) if m >> i & 1], b))
    assert sum(k == "same" for k, _ in rows) == common


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_line_counts_are_those_of_the_difference(a, b):
    assert D._common(a, b) == sum(k == "same" for k, _ in D._diff(a, b))


def test_line_diff_counts_whole_texts(spark):
    shipping.ship(spark)
    many = [f"line {i}" for i in range(1000)]
    texts = [("\n".join(many), "\n".join([*many[:400], "other", *many[401:]])), ("\n".join(many[:320]), "\n".join(f"x{i}" for i in range(320))), ("a\r\nb", "a\nb"), (None, "a"), ("a", "b" * 801)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string")
    got = rows.select("i", D.line_diff(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in got] == [(999, 1, 1, True, False, None), (0, 320, 320, True, False, None), (2, 0, 0, False, True, None), (0, 1, 1, False, False, None), (0, 1, 1, True, False, None)]
    shown = rows.select("i", D.line_diff(F.col("a"), F.col("b"), preview=True).alias("d")).orderBy("i").collect()
    assert [tuple(r.d)[:5] for r in shown] == [tuple(r.d)[:5] for r in got] and [len(r.d.rows) for r in shown] == [320, 500, 2, 2, 2]


def _within(some, of):
    rest = iter(of)
    return all(x in rest for x in some)


REPLY = '{"title": "a \\"b\\"", "tags": ["x", "y"], "score": 0.25, "ok": true}'


@pytest.mark.parametrize("cut", range(1, len(REPLY) + 1))
def test_truncated_replies_close(cut):
    got = json.loads(D._object_in("Sure: " + REPLY[:cut]))
    whole = json.loads(REPLY)
    assert got.keys() <= whole.keys()
    for k in ("score", "ok"):
        assert got.get(k, whole[k]) in (whole[k], 0, 0.2)


def test_reply_json(spark):
    shipping.ship(spark)
    cases = ['{"a": 1}', '<think>{"b": 2}</think>\n```json\n{"a": 1}\n```', '{"a": 1,}', 'text {"a": 1} more', '{"a": 1', "nothing", "", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", D.reply_json(F.col("c")).alias("r")).orderBy("i").collect()
    assert [json.loads(r.r.json) if r.r.json else None for r in rows] == [{"a": 1}] * 5 + [None] * 3
    assert [r.r.repaired for r in rows][:3] == [False, False, True]


def test_content_key(spark):
    values = [None, "", "a", "b", "ab", "1:a"]
    rows = spark.createDataFrame(list(product(values, values)), "a string, b string")
    assert rows.select(D.content_key(F.col("a"), F.col("b"))).distinct().count() == len(values) ** 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "assistant", "two"), ("s", 0, "user", "one"), (None, 0, "user", None)], "session_id string, ordinal int, role string, text string")
    sinks.write_archive(rows, str(tmp_path / "a"))
    assert all(f.suffix == ".gz" for f in (tmp_path / "a").glob("part-*"))
    assert sorted(map(str, sinks.read_archive(spark, str(tmp_path / "a"), rows.schema).collect())) == sorted(map(str, rows.collect()))
    texts = {r.session_id: r.markdown for r in sinks.session_markdown(rows).collect()}
    assert texts == {"s": "# Session s\n\n## User\n\none\n\n## Assistant\n\ntwo\n", None: "# Session \n\n## User\n\n\n"}
    item = spark.range(1).select(sinks.item_markdown(F.lit("T"), F.lit(" a\nb "), F.lit("c"), {"Tags": F.array(F.lit("x"), F.lit("y")), "None": F.array().cast("array<string>")}).alias("m")).first().m
    assert item == "# T\n\n> a\n> b\n\nc\n\n## Tags\n\n- x\n- y\n"


def test_json_transcripts(spark, tmp_path):
    (tmp_path / "g").mkdir()
    doc = {"sessionId": "s", "messages": [
        {"type": "user", "id": "1", "timestamp": "2024-01-01T00:00:00Z", "content": "hi"},
        {"type": "gemini", "id": "2", "model": "m", "content": [{"text": "a"}, {"inlineData": {"data": "x"}}], "toolCalls": [{"id": "c", "name": "ls", "args": {"p": 1}}], "thoughts": [{"subject": "T", "description": "d"}], "tokens": {"input": 3, "output": 4}},
    ]}
    (tmp_path / "g" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "g" / "broken.json").write_text("{")
    got = transcripts.gemini(spark, str(tmp_path / "g")).orderBy("ordinal").collect()
    assert [(r.role, r.text, r.input_tokens) for r in got] == [("user", "hi", None), ("assistant", 'T: d\na\nls({"p":1})', 3)]

    for name, text in (("api_conversation_history.json", "api"), ("ui_messages.json", "ui")):
        (tmp_path / "t" / "7").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / "7" / name).write_text(json.dumps([{"role": "user", "content": text, "ts": 1000}]))
    got = transcripts.task_arrays(spark, str(tmp_path / "t" / "*")).collect()
    assert [(r.session_id, r.text, r.role) for r in got] == [("7", "api", "user")]

    (tmp_path / "h").mkdir()
    call = {"toolCall": {"id": "c", "function": {"name": "run", "arguments": "x"}}}
    (tmp_path / "h" / "a.json").write_text(json.dumps({"sessionId": "s", "history": [{"message": {"role": "assistant", "content": "a"}, "toolCallStates": [call, call]}]}))
    assert [r.text for r in transcripts.history(spark, str(tmp_path / "h")).collect()] == ["a\nrun(x)"]


def test_aider(spark, tmp_path):
    head = "# aider chat started at 2024-01-01 10:00:00"
    (tmp_path / "log.md").write_text(f"stray\n{head}\n\n#### one\n#### more\n\n> ran\nanswer\n```\n#### not a prompt\n```\n{head}\n#### again\n")
    got = transcripts.aider(spark, str(tmp_path)).orderBy("session_id", "ordinal").collect()
    by = {}
    for r in got:
        by.setdefault(r.session_id, []).append((r.role, r.text))
    assert sorted(by.values(), key=len) == [[("user", "again")], [("user", "one\nmore"), ("tool", "ran"), ("assistant", "answer\n```\n#### not a prompt\n```")]]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE session (id TEXT, title TEXT)")
    con.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
    con.execute("CREATE TABLE part (id TEXT, message_id TEXT, time_created INTEGER, data TEXT)")
    con.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, value TEXT)")
    con.execute("INSERT INTO session VALUES ('s', 'T')")
    con.execute("INSERT INTO message VALUES ('m', 's', 1000, ?)", (json.dumps({"role": "assistant", "modelID": "x"}),))
    con.executemany("INSERT INTO part VALUES (?, 'm', ?, ?)", [("b", 2, json.dumps({"type": "tool", "tool": "ls", "state": {"input": "i", "output": "o"}})), ("a", 1, json.dumps({"type": "text", "text": "hey"}))])
    con.executemany("INSERT INTO kv VALUES (?, ?)", [(f"composerData:{i}", str(i)) for i in range(50)] + [("other:1", "x")])
    con.commit()
    con.close()
    ms = sqlite.parts_messages(sqlite.table(spark, path, "session", "id string, title string"), sqlite.table(spark, path, "message", "id string, session_id string, time_created long, data string"), sqlite.table(spark, path, "part", "id string, message_id string, time_created long, data string"))
    assert [(r.title, r.role, r.model, r.text) for r in ms.collect()] == [("T", "assistant", "x", "hey\nls: i\no")]
    kv = sqlite.table(spark, path, "kv", "key string, value string", partitions=4)
    assert kv.rdd.getNumPartitions() == 4
    assert sorted(int(r.id) for r in sqlite.keyed(kv, "composerData").collect()) == list(range(50))
