"""Replay of wire logs, a fixture for each kind of record."""

import json

import pytest

from lorekeep.sources import wire


def say(text, who="user", i=None, **more):
    return {"type": "context.append_message", "time": 1000, "message": {"id": i or text, "role": who, "content": text, **more}}


def step(kind, **more):
    return {"type": "context.append_loop_event", "time": 2000, "event": {"type": kind, **more}}


def call(i):
    return step("tool.call", toolCallId=i, name="ls", args={"p": i})


def result(i):
    return step("tool.result", toolCallId=i, result={"output": f"out {i}", "isError": False})


def part(text):
    return step("content.part", part={"type": "text", "text": text})


def turn(i):
    return [say(f"q{i}"), step("step.begin"), part(f"a{i}"), step("step.end")]


UNDO = lambda n=None: {"type": "context.undo", **({} if n is None else {"count": n})}
CLEAR = {"type": "context.clear"}
INJECTED = {"kind": "injection", "ownerPromptId": "q2"}
CASES = {
    "plain": ([{"type": "profile.bind", "modelAlias": "m1"}, *turn(1), {"type": "usage.note"}, *turn(2)], ["q1", "a1", "q2", "a2"]),
    "clear": ([*turn(1), CLEAR, *turn(2)], ["q2", "a2"]),
    "undo": ([*turn(1), *turn(2), UNDO()], ["q1", "a1"]),
    "undo_two": ([*turn(1), *turn(2), *turn(3), UNDO(2), *turn(4)], ["q1", "a1", "q4", "a4"]),
    "undo_none": ([*turn(1), UNDO(0)], ["q1", "a1"]),
    "undo_too_many": ([*turn(1), UNDO(2)], ["q1", "a1"]),
    "undo_injected": ([*turn(1), say("note", origin=INJECTED), say("other", origin={"kind": "injection", "ownerPromptId": "x"}), say("hint", origin=INJECTED), *turn(2), UNDO()], ["q1", "a1", "note", "other"]),
    "undo_skill": ([*turn(1), say("/s", origin={"kind": "skill_activation", "trigger": "user-slash"}), say("auto", origin={"kind": "skill_activation", "trigger": "model"}), UNDO()], ["q1", "a1"]),
    "undo_summary": ([*turn(1), {"type": "context.apply_compaction", "count": 2, "summary": "sum"}, *turn(2), UNDO(2), UNDO(1)], ["sum"]),
    "legacy": ([*turn(1), *turn(2), {"type": "context.apply_compaction", "compactedCount": 3, "summary": "sum"}, *turn(3)], ["sum", "a2", "q3", "a3"]),
    "kept": ([*turn(1), *turn(2), *turn(3), *turn(4), {"type": "context.apply_compaction", "compactedCount": 8, "contextSummary": {"role": "user", "content": "sum"}, "keptUserMessageCount": 3, "keptHeadUserMessageCount": 1}], ["q1", "q3", "q4", "sum"]),
    "calls": ([say("q"), step("step.begin"), part("t"), call("c1"), call("c2"), result("c1"), say("late"), result("c2"), step("step.end")], ["q", 't\nls({"p":"c1"})\nls({"p":"c2"})', "out c1", "out c2", "late"]),
    "interrupted": ([say("q"), step("step.begin"), call("c1"), say("late"), step("step.begin"), part("b")], ["q", 'ls({"p":"c1"})', "late", "b"]),
    "orphan": ([say("q"), result("c9")], ["q", "out c9"]),
    "empty_step": ([say("q"), step("step.begin"), step("step.end"), say("r")], ["q", "r"]),
    "undo_waiting": ([*turn(1), say("q2"), step("step.begin"), call("c1"), say("late"), UNDO(), say("q3")], ["q1", "a1", "q3"]),
}
FAILED = {
    "unknown": [say("q"), {"type": "context.twist"}],
    "no_type": [say("q"), {"kind": 1}],
    "outside": [say("q"), part("x")],
    "twice": [step("step.begin"), call("c"), call("c")],
    "boundary": [say("q"), {"type": "context.apply_compaction", "count": 2, "summary": "s"}],
    "no_summary": [say("q"), {"type": "context.apply_compaction", "count": 1}],
    "kept_more": [say("q"), {"type": "context.apply_compaction", "count": 1, "summary": "s", "keptUserMessageCount": 2}],
    "event": [step("step.begin"), step("step.jump")],
    "half": [say("q"), '{"type": "context.cl'],
}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wire")
    for name, rows in {**{k: v[0] for k, v in CASES.items()}, **FAILED, "blank": ["", ""]}.items():
        (folder / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def got(spark, logs):
    return wire.wire_log(spark, logs).orderBy("session_id", "ordinal").collect()


@pytest.mark.parametrize("name", CASES)
def test_history(got, name):
    rows = [r for r in got if r.session_id == name]
    assert [r.text for r in rows] == CASES[name][1]
    assert [r.ordinal for r in rows] == list(range(len(rows)))


def test_what_cannot_be_replayed_gives_no_rows(got):
    assert {r.session_id for r in got} == set(CASES)


def test_roles_models_and_times(got):
    rows = [r for r in got if r.session_id == "plain"]
    assert [(r.role, r.model, r.ts.second) for r in rows] == [("user", None, 1), ("assistant", "m1", 2), ("user", None, 1), ("assistant", "m1", 2)]
    assert [r.role for r in got if r.session_id == "calls"] == ["user", "assistant", "tool", "tool", "user"]


def test_states(spark, logs):
    rows = {r.path.rsplit("/", 1)[1].split(".")[0]: r for r in wire.wire_states(spark, logs).collect()}
    assert {n for n, r in rows.items() if r.state == "failed"} == set(FAILED)
    assert {n for n, r in rows.items() if r.interrupted} == {"interrupted"}
    assert {n for n, r in rows.items() if r.orphans} == {"orphan"}
    assert all(rows[n].messages == len(want) for n, (_, want) in CASES.items())
