"""Substring deduplication against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lorekeep.llm import repeats


def brute(texts, window):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone), gone))
    return out


def texts_of(rng, count=150):
    """Passages that texts share whole, in part and more than once, with edits, and periodic stretches."""
    passages = [[f"p{x}" for x in rng.integers(0, 30, int(rng.integers(5, 40)))] for _ in range(6)]
    out = []
    for _ in range(count):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            kind = rng.integers(0, 4)
            if kind == 0:
                w += [f"u{x}" for x in rng.integers(0, 9999, int(rng.integers(1, 30)))]
            elif kind == 1:
                w += ["x", "y", "z"][: int(rng.integers(1, 4))] * int(rng.integers(1, 15))
            else:
                own = list(passages[rng.integers(0, 6)])
                if kind == 3:
                    own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 99)}"
                w += own
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("window", "k", "bits"), [(8, 4, 26), (12, 5, 3), (7, 7, 20), (2, 1, 26)])
def test_repeats_by_brute_force(spark, window, k, bits):
    texts = [None, "", " \n", "a", *texts_of(np.random.default_rng(window)), "tail é " * 30, "same words\there " * 3]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string, row int"), window, k, bits=bits).collect()
    want = brute(texts, window)
    assert len(got) == len(texts)
    for r in got:
        n, m, kept, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, m, kept)
        assert {i for s in r.removed for i in range(s.start, s.start + s.length)} == gone
        assert all(a.start + a.length < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_repeats_of_any_ids(spark):
    texts = ["a b c d e f g h", "z a b c d e y", None, "q w e r t y", "q w e r t y"]
    rows = [("i", texts[0]), ("i", texts[1]), (None, texts[2]), ("k", texts[3]), ("k", texts[4])]
    got = repeats.without_repeats(spark.createDataFrame(rows, "name string, body string"), 5, 3, id_col="name", text_col="body").collect()
    assert Counter((r.name, r.kept) for r in got) == Counter([("i", "f g h"), ("i", "z y"), (None, ""), ("k", ""), ("k", "")])
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op13_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows], 35)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op13_substring_dedup(spark, sf).collect()}
    assert got == {r.doc_id: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, m, kept, _) in zip(rows, want, strict=True)}
    assert sum(m for _, m, _, _ in want)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql(repeats.OP13_SQL).fetchall()} == got
