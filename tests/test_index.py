"""The stored index against plain counting."""

import glob
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index as I  # noqa: E741

WORDS = ["alpha", "alpine", "al", "beta", "bet", "gamma", "aa", "Éa", "x1"]


def corpus(rng, n, begin=0):
    return [(f"d{begin + i}", " ".join(rng.choice(WORDS, int(rng.integers(0, 4)))), None if i % 9 == 0 else ", ".join(rng.choice(WORDS, int(rng.integers(0, 40))))) for i in range(n)]


def cut(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower().replace("é", "e"))


def brute(rows, phrases, weights):
    texts = {i: [cut(c) for c in r] for i, *r in rows}
    cols = list(weights)
    length = {i: sum(len(t[c]) for c in cols) for i, t in texts.items()}
    avg = sum(length.values()) / len(rows)
    f = []
    for p in (p.split() for p in phrases):
        at = lambda w, j, p=p: w[j : j + len(p) - 1] == p[:-1] and j + len(p) <= len(w) and w[j + len(p) - 1].startswith(p[-1])
        f.append({i: {c: sum(at(t[c], j) for j in range(len(t[c]))) for c in cols} for i, t in texts.items()})
    out = {}
    for own in f:
        df = sum(any(x.values()) for x in own.values())
        idf = max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
        for i, x in own.items():
            if any(x.values()):
                n = sum(weights[c] * k for c, k in x.items())
                out[i] = out.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[i] / avg))
    return out


def close(got, want):
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_phrases_prefixes_segments_and_overlaps(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    rng = np.random.default_rng(1)
    rows, more = [*corpus(rng, 400), ("over", "aa", "aa aa aa aa")], corpus(rng, 60, 1000)
    shape = "name string, head string, body string"
    I.add(spark.createDataFrame(rows, shape).repartition(3), folder, "name", ["head", "body"])
    asked = [" alpha", " aa aa", " beta gamma al", " ea", " nowhere", " b"]
    for weights in ({0: 3.0, 1: 1.0}, {1: 1.0}):
        got = {r.id: r.score for r in I.search(spark, folder, asked, weights, 2).collect()}
        close(got, brute(rows, asked, weights))
    old = set(glob.glob(f"{tmp_path}/i/segment-*/*.parquet"))
    I.add(spark.createDataFrame(more, shape), folder, "name", ["head", "body"])
    assert old < set(glob.glob(f"{tmp_path}/i/segment-*/*.parquet"))  # nothing was rebuilt
    want = brute(rows + more, asked, {0: 3.0, 1: 1.0})
    close({r.id: r.score for r in I.search(spark, folder, asked, {0: 3.0, 1: 1.0}, 2).collect()}, want)
    I.compact(spark, folder)
    assert len(I.segments(spark, folder)) == 1
    close({r.id: r.score for r in I.search(spark, folder, asked, {0: 3.0, 1: 1.0}, 2).collect()}, want)


def test_top_terms_with_skipped_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    folder = f"file://{tmp_path}/i"
    rows = corpus(np.random.default_rng(2), 500)
    I.add(spark.createDataFrame(rows, "name string, head string, body string"), folder, "name", ["head", "body"])
    asked = {0: ["alpha", "beta"], 1: ["x1"], 2: ["al", "gamma", "bet", "nowhere"]}
    q = spark.createDataFrame([(i, t) for i, ts in asked.items() for t in ts], "query_id long, term string")
    got = I.top_terms(spark, folder, q, 1, 7).collect()
    texts = {i: cut(b) for i, _, b in rows}
    avg = sum(map(len, texts.values())) / len(rows)
    df = {t: sum(t in w for w in texts.values()) for t in {*WORDS, "nowhere"}}
    for query, terms in asked.items():
        score = {i: round(sum(max(math.log((500 - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms if t in w), 6) for i, w in texts.items() if set(terms) & set(w)}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])] == best


def test_few_row_groups_hold_a_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "GROUP", 1 << 14)
    folder = f"file://{tmp_path}/i"
    docs = spark.range(20_000).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(9000))) for j in range(12)]).alias("body"))
    I.add(docs, folder, "id", ["body"])
    groups = [(g.column(0).statistics.min, g.column(0).statistics.max) for p in glob.glob(f"{tmp_path}/i/segment-*/*.parquet") for m in [pq.ParquetFile(p).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    met = sum(lo <= "w1234" <= hi for lo, hi in groups)
    assert len(groups) >= 20 and met <= 2
    rows = I.postings(spark, folder, ["w1234"], ["w777"])
    assert {r.term for r in rows.select("term").collect()} >= {"w1234", "w777", "w7771"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,w777)" in plan and "term" in plan.split("PushedFilters")[1]


def test_a_segment_is_written_where_its_documents_are_read(spark, tmp_path, monkeypatch):
    """No shuffle of postings: each file holds the blocks of its own documents, in runs sorted by term."""
    folder = f"file://{tmp_path}/i"
    rows = corpus(np.random.default_rng(3), 2500)
    monkeypatch.setattr(I, "RUN", 1)
    monkeypatch.setattr(I, "FEW", 1000, raising=False)
    I.add(spark.createDataFrame(rows, "name string, head string, body string").repartition(9), folder, "name", ["head", "body"])
    files = [pq.read_table(f) for f in sorted(glob.glob(f"{tmp_path}/i/segment-*/*.parquet"))]
    assert len(files) == 9 and not glob.glob(f"{tmp_path}/i/raw-*")
    assert sum(sum(n for t, c, n in zip(f["term"].to_pylist(), f["col"].to_pylist(), f["n"].to_pylist()) if t == "" and c == 0) for f in files) == len(rows)
    assert all("" in f["term"].to_pylist() for f in files)
    asked = [" alpha", " aa aa", " b"]
    close({r.id: r.score for r in I.search(spark, folder, asked, {0: 3.0, 1: 1.0}, 2).collect()}, brute(rows, asked, {0: 3.0, 1: 1.0}))


@pytest.mark.parametrize("repeated", [False, True])
def test_no_row_is_shuffled_for_each_query_and_document(spark, tmp_path, monkeypatch, repeated):
    """Many queries of frequent words, in several groups; documents of one id, in several blocks, are added up."""
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "QUERIES", 30, raising=False)
    monkeypatch.setattr(I, "TERMS", 2, raising=False)
    folder = f"file://{tmp_path}/i"
    rows = corpus(np.random.default_rng(4), 600)
    if repeated:
        rows = [(None if i % 100 == 7 else "same" if i % 50 == 3 else name, *r) for i, (name, *r) in enumerate(rows)]
    I.add(spark.createDataFrame(rows, "name string, head string, body string"), folder, "name", ["head", "body"])
    rng = np.random.default_rng(5)
    asked = {q: sorted(set(rng.choice([*WORDS, "nowhere"], 5))) for q in range(100)}
    q = spark.createDataFrame([(i, cut(str(t))[0]) for i, ts in asked.items() for t in ts], "query_id long, term string")

    def shuffled():
        nothing = spark._sc._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = I.top_terms(spark, folder, q, 1, 3).collect()
    assert repeated or shuffled() - before < 10_000  # 13 484 when each query and document had a row
    texts = [(i, cut(b)) for i, _, b in rows]
    avg = sum(len(w) for _, w in texts) / len(rows)
    df = {t: sum(t in w for _, w in texts) for t in {c for w in [*WORDS, "nowhere"] for c in cut(w)}}
    for query, terms in asked.items():
        score = {}
        for i, w in texts:
            for t in {cut(str(t))[0] for t in terms} & set(w):
                score[i] = score.get(i, 0) + max(math.log((600 - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
        best = sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0] or ""))[:3]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])] == best
