"""Collocations against brute force and SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lorekeep.llm import collocations


def brute(rows, max_words, min_count, most, share):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        dropped = {q for p, b in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= share * cand[q := p[i : i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in dropped:
                score, _, x, y = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "min_count", "most"), [(3, 10, 2000), (2, 3, 5), (5, 4, 40)])
def test_collocations_by_brute_force(spark, monkeypatch, max_words, min_count, most):
    rng = np.random.default_rng(max_words)
    words = ["The", "cat", "é", "数据", "sat,", "on.", "a\tb", "mat", "x\ny", "New", "York", "City"]
    p = np.array([3, 3, 2, 1, 1, 1, 1, 2, 1, 1, 1, 1]) / 18
    rows = [(["en", "fr", None][int(i % 3)], " ".join(rng.choice(words, int(rng.integers(0, 60)), p=p)) + " new YORK city" * int(rng.integers(0, 3))) for i in range(200)]
    rows += [(None, None), ("en", ""), ("xx", " \t.;"), ("yy", "one two"), *[rows[0]] * 3]
    got = collocations.collocations(spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, text string, block string, n int").repartition(5), max_words, min_count, most)
    assert sorted(map(tuple, got.collect())) == brute(rows, max_words, min_count, most, 50)


def test_small_blocks_and_large_counts(spark):
    rows = [("en", "a b c. a b " * 40)] * 30 + [("en", "b c a")] * 7
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(9)).collect())) == brute(rows, 3, 10, 2000, 50)
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    a = spark.sql("select cast(1000000 as decimal(7,0)) * (cast(999999999999999 as decimal(15,0)) * cast(999999999999999 as decimal(15,0))) div (cast(999999999999999 as decimal(15,0)) * cast(999999999999998 as decimal(15,0))) as x").first().x
    assert a == 10**6 * 999999999999999**2 // (999999999999999 * 999999999999998)


def test_op12_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = collocations.op12_collocations(spark, sf)
    want = con.sql(collocations.OP12_SQL)
    assert want.columns == got.columns
    want = sorted(want.fetchall())
    assert len(want) > 1000
    assert sorted(map(tuple, got.collect())) == want
