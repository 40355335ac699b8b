"""Merges by containment and folded log lines against sequential loops on random texts."""

import random

from lorekeep.operators import containment, log_lines


def kept_by_loop(rows):
    """Contents joined as a merge joins them; a rule that no content holds stands between them."""
    out = {}
    for key, order, content in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        text = content or ""
        if key not in out:
            out[key] = [(order, content)]
        elif text.strip() and text.strip() not in "\x00".join(c or "" for _, c in out[key]):
            out[key].append((order, content))
    return sorted((str(k), o, c) for k, v in out.items() for o, c in v)


def test_uncontained_equals_a_loop(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "δέλτα", "x", "長い", "yy"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 60))) for _ in range(12)]
    rows = []
    for i in range(500):
        b = r.choice(base)
        a, z = sorted(r.sample(range(len(b)), 2))
        content = r.choice([b[a:z], b[a : a + r.randint(1, 18)], b, b[a:z] + " tail" + str(r.randint(0, 9)), "  ", None, "　" + b[a:z] + "\n"])
        rows.append((r.choice(["k", "l", "m", None]), i, content))
    rows += [("blank", 1, None), ("blank", 2, "x"), ("after", 1, "x y"), ("after", 2, "x"), ("after", 3, "x y z")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*row, "extra") for row in rows], "key string, n int, content string, _t string")
    got = containment.uncontained(df, ["key"], ["n"], "content").collect()
    assert sorted((str(g.key), g.n, g.content) for g in got) == sorted(kept_by_loop(rows), key=lambda x: (x[0], x[1]))
    assert containment.uncontained(df.limit(0), ["key"], ["n"], "content").count() == 0


def test_anchors_of_a_part_are_among_those_of_the_whole():
    r = random.Random(4)
    whole = "".join(r.choice("abcδ長") for _ in range(400))
    for _ in range(200):
        a = r.randrange(len(whole) - containment.LONG)
        z = r.randrange(a + containment.LONG, len(whole) + 1)
        part = set(containment.anchors(whole[a:z]))
        assert part and part <= set(containment.anchors(whole))


def compacted_by_loop(text):
    import re

    out, repeats, fenced, before = "", 0, False, None
    told = lambda: f"{log_lines.NOTE[0]}{repeats}{log_lines.NOTE[1]}" if repeats else ""
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        bare = re.sub("\r$", "", line.removesuffix("\n"))
        is_fence, may = bool(re.match(log_lines.FENCE, bare)), bool(re.match(log_lines.REPEATABLE, bare))
        if not fenced and not is_fence and may and bare == before:
            repeats += 1
            continue
        out, repeats = out + told() + line, 0
        fenced ^= is_fence
        before = bare if may and not fenced and not is_fence else None
    return out + told()


def test_compacted_equals_a_loop(spark):
    r = random.Random(5)
    lines = ["INFO a", "INFO a\r", "[WARN] b", "plain", "```", "  ~~~ x", "", "  INFO a"]
    texts = {i: "\n".join(r.choice(lines) for _ in range(r.randint(0, 40))) for i in range(50)}
    for i in range(50, 120):
        parts = [[r.choice(lines)] * r.randint(1, 9) for _ in range(r.randint(1, 9))]
        texts[i] = "\n".join(x for p in parts for x in p) + r.choice(["", "\n"])
    texts |= {200: "", 201: None, 202: "INFO a\n" * 50, 203: "\n\n", 204: "```\n" + "INFO a\n" * 9 + "```\n" + "INFO a\n" * 9}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    for segment in (3, log_lines.SEGMENT):
        got = {g.id: g for g in log_lines.compacted(df, "id", "text", segment=segment).collect()}
        assert len(got) == len(texts)
        for i, t in texts.items():
            want = compacted_by_loop(t or "")
            assert got[i].compacted == want, (i, segment)
        assert (got[202].n_lines, got[202].n_folded, got[204].n_folded, got[201].n_lines) == (50, 49, 8, 0)
    assert log_lines.compacted(df.limit(0), "id", "text").count() == 0


def test_only_asked_anchors_are_posted():
    import types

    import numpy as np
    import pandas as pd

    r = random.Random(6)
    texts = pd.Series(["".join(r.choice("abcdefgh ") for _ in range(5000)) for _ in range(20)])
    part, seeds = texts[3][700:900], pd.Series([9] * 20)
    h = containment._asked(pd.Series([part]), seeds[:1]).to_numpy(np.int64)
    marked = np.zeros(1 << 13, np.uint8)
    for at in containment._probes(h.view(np.uint64), 1 << 16):
        marked[at >> 3] |= (1 << (at & 7)).astype(np.uint8)
    found = containment._posted(types.SimpleNamespace(value=marked))(texts, seeds)
    assert h[0] in found[3] and sum(map(len, found)) < 5  # all anchors were posted before: some 20 000


def test_texts_of_one_segment_are_folded_in_their_own_rows(spark):
    r = random.Random(8)
    lines = ["INFO a", "INFO a\r", "[WARN] b", "plain", "```", ""]
    texts = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 300)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, text string")

    def shuffled():
        nothing = spark._sc._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {g.id: g.compacted for g in log_lines.compacted(df, "id", "text").collect()}
    rows = log_lines.folded(df, "id", "text").collect()
    assert shuffled() == before  # some 9000 lines were shuffled several times
    assert got == {i: compacted_by_loop(t) for i, t in texts}
    by_segments = log_lines.folded(df, "id", "text", segment=4).collect()
    assert sorted(rows) == sorted(by_segments) and len(rows) > 5000


def test_texts_hashed_together_give_what_each_gives_alone():
    import types

    import numpy as np
    import pandas as pd

    r = random.Random(7)
    words = ["alpha", "be", "c", "δέλτα", "𝄞𝄞", "長い", "\n", "e f"]
    texts = ["", "c", *["".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 6, 20, 300]))) for _ in range(400)], "", "x" * (containment.BLOCK + 5), "be", ""]
    short = sorted({t for t in texts if 0 < len(t) < containment.LONG})
    known = np.zeros(containment.BITS, bool)
    known[[int(at[0]) for t in short for n, at in containment.bits(t, len(t)) if n == len(t)]] = True
    heads = containment._beginnings(np.zeros(containment.HEADS, bool), short)
    cut = containment._cut(types.SimpleNamespace(value=(known, heads)))(pd.Series(texts))
    for t, got in zip(texts, cut, strict=True):
        assert [p for p in got if p in short] == [p for p in short if p in t and p != t] and len(set(got) - set(short)) < 3

    seeds = pd.Series([i % 3 for i in range(len(texts))])
    every = types.SimpleNamespace(value=np.full(1 << 13, 255, np.uint8))
    asked, posted = containment._asked(pd.Series(texts), seeds), containment._posted(every)(pd.Series(texts), seeds)
    for i, t in enumerate(texts):
        one, own = pd.Series([t]), seeds[i : i + 1].reset_index(drop=True)
        alone = containment._asked(one, own)[0]
        assert (asked[i] is pd.NA) == (alone is pd.NA) == (len(t) < containment.LONG) and (alone is pd.NA or asked[i] == alone)
        assert np.array_equal(posted[i], containment._posted(every)(one, own)[0])
        if len(t) > 80:  # a part's anchor is among those of the whole
            a = r.randrange(len(t) - 70)
            part = pd.Series([t[a : a + r.randint(15, 70)]])
            assert int(containment._asked(part, own)[0]) in posted[i]


def test_no_text_goes_to_python_for_the_result(spark):
    rows = [("k", i, f"line {i} of some length " * (1 + i % 3)) for i in range(50)] + [("k", 60 + i, f"line {i}") for i in range(9)]
    out = containment.uncontained(spark.createDataFrame(rows, "key string, n int, content string"), ["key"], ["n"], "content")
    assert sorted(r.n for r in out.collect()) == sorted(n for _, n, _ in kept_by_loop(rows))
    assert "EvalPython" not in out._jdf.queryExecution().toString()  # it did for each of several joins before
