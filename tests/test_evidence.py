"""Excerpts, labels and budgets of evidence, and of the talk before a question, against loops."""

import random

from pyspark.sql import functions as F

from lorekeep.operators import evidence as E

HITS = "query_id int, rank int, corpus string, id long, chunk long, title string, text string, kind string, extra int"


def of(spark, hits, term="needle", **limits):
    rows = spark.createDataFrame([(*h, 1) for h in hits], HITS)
    return [tuple(r) for r in E.evidence(rows, F.lit(term), **limits).orderBy("query_id", "index").collect()]


def test_anchors():
    assert E.anchor("fix the parse_json error") == "parse_json"
    assert E.anchor(" ? ") == "?" and E.anchor("") == ""
    assert E.anchor("aa bb") == "aa"


def test_excerpts_are_placed_by_the_term(spark):
    text = "a" * 1000 + "NEEDLE" + "b" * 9000
    got = of(spark, [(1, 1, "sessions", 1, None, "t", text, None), (1, 2, "sessions", 2, None, None, "c" * 5000, None), (1, 3, "sessions", 3, 7, "t", "part " + text, None)], single=20000, total=100000)
    assert [g[6] for g in got] == [text[300:4100], "c" * 3800, "part " + text]


def test_labels_repeats_blanks_and_budgets(spark):
    hits = [(1, 1, "documents", 1, None, "t", "one", "incorrect"), (1, 2, "documents", 1, None, "t", "again", None), (1, 3, "documents", 2, None, "t", " \n", None), (1, 4, "documents", 3, None, "t", None, None),
            (1, 5, "sessions", 4, None, "t", "four", "incorrect"), (1, 6, "documents", 5, None, "t", "  " + "x" * 50, "useful"), (1, 7, "documents", 6, None, "t", "y" * 50, None), (1, 8, "documents", 7, None, "t", "z", None), (2, 1, "documents", 1, None, "t", "two", "outdated")]
    first = "【" + E.DISPUTED["incorrect"] + "】\none"
    got = of(spark, hits, single=40, total=len(first) + 4 + 40 + 5)
    assert [(g[0], g[1], g[3], g[6]) for g in got] == [(1, 1, 1, first), (1, 2, 4, "four"), (1, 3, 5, "x" * 40), (1, 4, 6, "y" * 5), (2, 1, 1, "【" + E.DISPUTED["outdated"] + "】\ntwo")]
    assert [g[1] for g in of(spark, hits, items=2)] == [1, 2, 1]
    assert of(spark, []) == []
    shown = E.formatted(E.evidence(spark.createDataFrame([(*h, 1) for h in hits], HITS), F.lit("q"), items=2)).filter("query_id = 1").first().evidence
    assert shown == "[1] 类型：知识\n标题：t\n内容：\n" + first + "\n\n---\n\n[2] 类型：AI 对话\n标题：t\n内容：\nfour"


def told(turns, last, most):
    out = ""
    for _, role, text in sorted(turns)[-last:]:
        said = (text or "").strip()
        if len(out) >= most:
            break
        if said:
            out += (E.ANSWERER if (role or "").strip().lower() == "assistant" else E.ASKER) + "：" + said[: most - len(out)] + "\n"
    return out.strip() or E.NONE


def test_history_equals_a_loop(spark):
    r = random.Random(3)
    talks = {s: [(n, r.choice(["user", " Assistant ", "tool", None]), r.choice([None, " ", "", "w" * r.randrange(1, 90) + " é\n"])) for n in range(r.randrange(1, 8))] for s in range(60)}
    df = spark.createDataFrame([(s, *t) for s, ts in talks.items() for t in ts], "sid int, n int, role string, text string")
    for last, most in ((4, 3000), (4, 60), (2, 10), (3, 1)):
        assert {x.sid: x.history for x in E.history(df, "sid", "n", last=last, most=most).collect()} == {s: told(ts, last, most) for s, ts in talks.items()}
    assert E.history(df.limit(0), "sid", "n").collect() == []
