"""Share pages: calls, flat tables with circles, the older form and what each kind of content shows."""

import json

import pytest

from lorekeep.sources import share


def message(kind, role="assistant", mid="m-1", metadata=None, **content):
    return {"id": mid, "author": {"role": role}, "create_time": 100.5, "content": {"content_type": kind, **content}, "metadata": metadata or {}}


def page(messages, **extra):
    data = {"title": "T", "model": {"slug": "m"}, "update_time": 7.5, "linear_conversation": [{"id": str(i), "message": m} for i, m in enumerate(messages)], **extra}
    table = [{"_1": 2}, "loaderData", {share.ROUTE: {"sharedConversationId": "s1", "serverResponse": {"data": data}}}]
    return f"<script>x.streamController.enqueue({json.dumps(json.dumps(table))});</script>"


def texts(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    return [(r.page_id, r.ordinal, r.role, r.text) for r in share.share_pages(df).orderBy("page_id", "ordinal").collect()]


def test_arguments_end_where_their_bracket_closes():
    script = r'''streamController.enqueue("a)\"(" + f(1)); streamController.enqueue('x)'); streamController.enqueue(`)`); streamController.enqueue("open'''
    assert list(share.arguments(script)) == [r'"a)\"(" + f(1)', "'x)'", "`)`"]


@pytest.mark.parametrize(("argument", "table"), [('[1, 2]', [1, 2]), ('((" [1]"))', [1]), ('"text"', None), ("'[1]'", None), ('"[1"', None), ("", None), ("{}", None)])
def test_tables_of_arguments(argument, table):
    assert share.table_of(argument) == table


def test_places_names_and_circles():
    table = [0, "a", {"_3": 4, "_99": -5, "n": 1000, "yes": True}, "key", ["x", 5, 6], "five", {"back": 4, "on": 7}, 5, "a", "second"]
    assert share.unflattened(table) == {"a": {"key": ["x", "five", {"back": None, "on": "five"}], "_99": -5, "n": 1000, "yes": True}, "key": ["x", "five", {"back": None, "on": "five"}], "five": {"back": ["x", "five", {"back": None, "on": "five"}], "on": "five"}}


def test_a_long_chain_of_places():
    table = [0, "a", [3], *[[n + 1] for n in range(3, 5000)], "end"]
    got = share.unflattened(table)["a"]
    for _ in range(4998):
        got = got[0]
    assert got == "end"


def test_kinds_of_content(spark):
    messages = [
        message("text", role="user", parts=["\nhi there\n", {"no": "string"}, '{"response": "inner"}', '{"content": 1}', ""]),
        message("code", text="a = `b` ``` c\n\n", language="python"),
        message("code", text='{"search_query": [{"q": " one "}, "two", {"q": ""}], "z": 3, "a": "w", "response_length": "short", "deep": {"x": 1}}', language="unknown"),
        message("code", text='{"z": true}'),
        message("code", text='{"response_length": "short"}'),
        message("thoughts", thoughts=[{"summary": "s", "content": "c"}, {"summary": "", "content": "only"}, 3]),
        message("reasoning_recap", content=" recap "),
        message("model_editable_context", model_set_context=" ctx "),
        message("multimodal_text", mid="ab-c", parts=["look", {"content_type": "image_asset_pointer", "asset_pointer": "file://1", "mime_type": "image/png"}, {"type": "file", "asset_pointer": "https://x/2"}, {"type": "text", "text": ["p", 99, "q"]}, {"type": "file"}]),
        message("tool_response", role="tool", output="out"),
        message("other", parts=["p", 99, False, None, "0", "q"]),
        message("text", role="system", parts=["hidden"]),
        message("text", parts=["seen citeturn0search1, here turn3x  \nnext"]),
        message("text", parts=["with"], mid="q", metadata={"attachments": [{"name": "n.pdf", "file_url": "HTTP://a"}, {"download_url": "sandbox:/i", "mime_type": "image/gif", "type": "Image", "title": "t"}, {"name": "no url"}]}),
        {"id": "x", "author": {"role": "user"}, "content": None},
        message("text", role=None, parts=["nobody"]),
    ]
    got = texts(spark, page(messages))
    assert [g[1] for g in got] == list(range(len(got)))
    assert [(g[2], g[3]) for g in got] == [
        ("user", 'hi there\n\ninner\n\n{"content": 1}'),
        ("assistant", "````python\na = `b` ``` c\n````"),
        ("assistant", "Search tool invoked with queries:\n- one\n- two\n- z: 3\n- a: w"),
        ("assistant", "Tool parameters:\n- z: true"),
        ("assistant", "_s: c_\n\n_only_"),
        ("assistant", "_recap_"),
        ("assistant", "ctx"),
        ("assistant", "look\n\n*Image 'ab-0.png' not included in export (source: file://1).*\n\n[ab-1.bin](attachments/ab-1.bin)\n\np\n\nq"),
        ("tool", "out"),
        ("assistant", "p\n\n99\n\n0\n\nq"),
        ("assistant", "seen here\nnext"),
        ("assistant", "with\n\n[n.pdf](attachments/n.pdf)\n*Image 't' not included in export (source: sandbox:/i).*"),
        ("assistant", "nobody"),
    ]


def test_older_pages_names_and_broken_ones(spark):
    data = {"conversation_id": "c9", "author_name": "Ann", "title": "Old", "linear_conversation": [{"id": "a", "message": message("text", parts=["of the line"])}, {"id": "b"}], "mapping": {"a": {"message": message("text", role="user", parts=["of the map"])}}}
    old = f"<SCRIPT type='x' ID={share.LEGACY_ID}>{json.dumps({'props': {'pageProps': {'other': [data]}}})}</script>"
    broken = f'<script id="{share.LEGACY_ID}">{{</script>'
    both = '<script>streamController.enqueue("[0]")</script>' + old
    df = spark.createDataFrame([(1, old, "mine", 5), (2, broken, "", 0), (3, None, "", 0), (4, "", "", 0), (5, "<p>", "", 0), (6, both, "", 0)], "page_id long, html string, title string, _c int")
    rows = share.share_pages(df).orderBy("page_id").collect()
    assert [(r.page_id, r.form, r.share_id, r.title, r.author, r.text, r["_c"]) for r in rows] == [(1, "legacy", "c9", "Old", "Ann", "of the map", 5), (6, "legacy", "c9", "Old", "Ann", "of the map", 0)]
    assert share.share_pages(df.limit(0)).collect() == []
    new = share.share_pages(spark.createDataFrame([(page([message("text", parts=["x"])]),)], "html string")).first()
    assert (new.form, new.share_id, new.model, new.title, new.updated.timestamp() % 60, new.ts.timestamp() % 60) == ("table", "s1", "m", "T", 7.5, 40.5)
