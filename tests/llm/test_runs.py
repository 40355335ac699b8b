"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from lorekeep.llm import runs, words


def brute_runs(w, least):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)  # the smallest period comes first
            i = j
    return sorted((s, n, p) for (s, n), p in out.items())


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_texts(rng, count):
    for k in range(count):
        n, size = int(rng.integers(0, 90)), int(rng.integers(1, 5))
        w = [f"w{x}é" for x in rng.integers(0, size, n)]
        if k % 2 and n > 20:
            at, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
            w = w[:at] + [w[at - 1 - i % p] for i in range(int(rng.integers(1, 60)))] + w[at:]
        yield w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_by_brute_force(least, monkeypatch):
    monkeypatch.setattr(runs, "_SHORT", 64)  # longer texts take their grids in portions
    monkeypatch.setattr(runs, "PLACES", 50)
    runs.caches.clear()
    import pyarrow as pa

    texts = list(random_texts(np.random.default_rng(least), 300))
    cut = words.cut(pa.array([" ".join(w) for w in texts]))
    got = [[] for _ in texts]
    for t, *r in zip(*runs.runs_of(cut.named()[0], cut.begin, least), strict=True):
        got[t].append(tuple(map(int, r)))
    assert got == [brute_runs(w, least) for w in texts]
    runs.caches.clear()


def test_periodic_runs_edge_cases(spark):
    texts = [None, "", " \t\n", "a", "a " * 12, "\x0ba\x0ca  a\r\n" * 8, "a b " * 7000 + "c", "x y z " * 3 + "x y", "é é é é " * 9, " ".join(map(str, range(5000))) + " q" * 40]
    rows = [(i if i != 3 else None, t, "s", 1) for i, t in enumerate(texts)] + [(4, texts[4], "s", 1)]
    out = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, t, *_) in zip(sorted(out, key=key), sorted(rows, key=key), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = brute_runs(w, 12) if len(w) < 6000 else [(0, 14000, 2)]
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (i, len(w), want, collapsed(w, want))
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_op11_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in runs.op11_periodic_runs(spark, sf).collect()}
    for doc, text in ((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        found = brute_runs(w, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        milli = None if not found else 1000 * best[1] // best[2]
        assert tuple(got[doc]) == (doc, len(found), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(collapsed(w, found)))
