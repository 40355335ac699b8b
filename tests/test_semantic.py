"""Near pairs, their merge and caps against brute force."""

import numpy as np

from lorekeep.operators import semantic


def clustered(rng, n=1500, d=12, clusters=60):
    centres = rng.normal(size=(clusters, d))
    return [(i, int(i % 2), [float(x) for x in centres[rng.integers(clusters)] + 0.1 * rng.normal(size=d)]) for i in range(n)]


def test_pairs_by_brute_force_with_few_compared(spark):
    rows = [*clustered(np.random.default_rng(5)), (9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 12), (9004, 0, [1.0, float("nan")]), (9005, 1, [1.0, 2.0]), (9006, 1, [2.0, 4.0]), (9007, None, [3.0, 1.0]), (9008, None, [3.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    good = [r for r in rows if r[2] and np.isfinite(r[2]).all() and any(r[2])]
    unit = [np.array(v) / np.linalg.norm(v) for *_, v in good]
    want = {(a[0], b[0]) for i, a in enumerate(good) for j, b in enumerate(good[i + 1 :], i + 1) if a[1] == b[1] and len(a[2]) == len(b[2]) and round(float(unit[i] @ unit[j]), 6) >= 0.95}
    assert {(r.a, r.b) for r in semantic.similar_pairs(table, 0.95).collect()} == want and len(want) > 1000
    assert semantic.compared(table, 0.95, "vec_id", "label", "embedding").count() < len(good) ** 2 / 2 / 10


def test_pairs_of_unclustered_vectors_by_tiles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 64))
    x[600:700] = x[:100] + 0.1 * rng.normal(size=(100, 64))
    x[700:720] = x[0]
    rows = [(f"v{i}", "one" if i % 3 else None, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id string, label string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(min(a, b), max(a, b)) for i, (a, la, _) in enumerate(rows) for j, (b, lb, _) in enumerate(rows[:i]) if la == lb and round(float(unit[i] @ unit[j]), 6) >= 0.82}
    for tile in (64 * 64, semantic.TILE):
        found = semantic.compared(table, 0.82, "vec_id", "label", "embedding", tile=tile)
        got = [(r.a, r.b) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 100


def test_merge_in_order_and_caps(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(f"s{rng.integers(4)}", int(a), int(b)) for a, b in rng.integers(0, 30, (300, 2)) if a < b})
    gone, want = {}, set()
    for s, a, b in pairs:
        out = gone.setdefault(s, set())
        if a not in out and b not in out:
            out.add(b)
            want.add((s, a, b))
    assert {tuple(r) for r in semantic.merge_in_order(spark.createDataFrame(pairs, "s string, a long, b long").repartition(7), "s").collect()} == want
    scored = [(s, a, b, round(float(rng.integers(0, 5)) / 5, 1)) for s, a, b in pairs]
    got = semantic.capped_relations(spark.createDataFrame(scored, "s string, item long, candidate long, cosine double"), "s", 2, 7).collect()
    for s in gone:
        best = [x for a in sorted({p[1] for p in scored if p[0] == s}) for x in sorted((p for p in scored if p[0] == s and p[1] == a), key=lambda p: (-p[3], p[2]))[:2]]
        assert [tuple(r)[:4] for r in sorted((r for r in got if r.s == s), key=lambda r: r.place)] == best[:7]
