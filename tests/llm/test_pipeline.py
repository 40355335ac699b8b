"""The pipeline's stages, each on a table of its own against brute force, and all of them in a row."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from lorekeep.llm import packing

EN, FR = "the quick house of the thing was with them and there", "le chat dans la maison est avec les fleurs et nous"
COPY = " ".join(f"word{i}" for i in range(40))
ROWS = [
    *((i, f"{EN if i % 2 else FR} {i} x{i * i} y{i * 7}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(1, 30)),
    (1, "Another  text with the id one, and of the same house", "en", "s1"), (1, "Another  text with the id one, and of the same house", "en", "s1"), (1, "Another text with the id one, and of the same house", "en", "s1"),
    (2, COPY, "en", "s0"), (None, COPY, "en", "s0"), (3, COPY.replace("word39", "other"), "en", "s2"), (None, "A text of the house without an id is there with them", "en", None),
    (40, None, "en", "s1"), (41, "", "fr", "s1"), (42, " \n\t", None, None), (43, "12 ! 34", "en", "s2"), (44, "the house " * 30_000, "en", "s2"), (45, f"{EN} 45 zz", None, "s2"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row long, doc string, _shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 0.1, "zz", 1, "d", 2) for i, t, g, s in ROWS], SCHEMA)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language_stage(spark, docs):
    out = pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns
    assert texts(out) == Counter((i, t) for i, t, _, _ in ROWS if re.search(r"[^\W\d_]", t or ""))


def test_exact_stage(spark, docs):
    out = pipeline.exact_copies(spark, docs, "")
    groups = defaultdict(list)
    for i, t, _, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((i, t))
    want = Counter(min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values())
    assert out.columns == docs.columns and texts(out) == want
    assert texts(out)[1, "Another  text with the id one, and of the same house"] == 1  # a repeated id loses no text of its own


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_rows_of_files_are_not_copied(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    with pipeline.scratch.owned() as tables:
        rows = pipeline._keyed(stored)
    assert not tables and rows.select("row").distinct().count() == len(ROWS)
    assert texts(pipeline.exact_copies(spark, stored, "")) == texts(pipeline.exact_copies(spark, docs, ""))


@pytest.mark.parametrize("bits", [6, 22])
def test_texts_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch, bits):
    """What a stage keeps is told by a map; with few bits most rows meet the numbers themselves."""
    monkeypatch.setattr(pipeline, "BITS", bits, raising=False)
    r = random.Random(7)
    own = [" ".join("%08x" % r.getrandbits(32) for _ in range(400)) for _ in range(300)]
    rows = [(i, own[i % 300]) for i in range(330)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")

    def shuffled():
        nothing = spark._sc._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where more rows are kept than can be sent to all tasks
    try:
        for stage in (pipeline.exact_copies, pipeline.near_copies):
            out = stage(spark, stored, "")
            before = shuffled()
            out.write.parquet(f"{tmp_path}/{stage.__name__}")
            assert bits < 20 or shuffled() - before < 300_000  # 330 texts of 3600 bytes; 30 of them go
            assert texts(spark.read.parquet(f"{tmp_path}/{stage.__name__}")) == Counter(rows[:300])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_near_stage(spark, docs):
    table = docs.filter("doc_id is null or doc_id <> 44")
    out = pipeline.near_copies(spark, table, "")
    sets = [shingles(r.text) for r in table.collect()]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for n, r in enumerate(table.collect()):
        groups[find(n)].add((r.doc_id, r.text))
    got = texts(out)
    assert out.columns == docs.columns and got.total() == len(groups)
    assert all(len(g & set(got)) >= 1 for g in groups.values())


def test_mix_stage(spark, docs):
    out = pipeline.mixture(spark, docs, "")
    kinds = {(i, t) for i, t, _, _ in ROWS if (t or "").split()}
    assert out.columns == docs.columns and set(texts(out)) <= kinds
    assert all(n <= 2 * sum((i, t) == x for i, t, _, _ in ROWS) for x, n in texts(out).items())
    assert texts(out) == texts(pipeline.mixture(spark, docs, ""))


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = pipeline.packed(spark, docs, "").toPandas()
    want = Counter()
    for i, text, _, _ in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want.update((i, at // 4096, min(4096, n - at)) for at in range(0, n, 4096))
    ids = [None if x != x else int(x) for x in out.doc_id]
    assert Counter(zip(ids, out.piece, out.length, strict=True)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert out.sequence_id.nunique() <= 1.25 * sum(x[2] * n for x, n in want.items()) / 4096 + 1


def test_results_outlive_later_stages(spark, docs, tmp_path):
    other = docs.filter("doc_id < 20")
    a, b = pipeline.packed(spark, docs, ""), pipeline.packed(spark, other, "")
    c, d = pipeline.near_copies(spark, docs, ""), pipeline.exact_copies(spark, other, "")
    assert b.count() == other.count() and a.count() > docs.count() and c.count() and d.count()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (pipeline.run(spark, str(tmp_path)) for _ in range(2))
    assert two.count() > 29 and one.count() > 29  # which of the rows without an id of their own stay may differ


def test_a_run_keeps_no_table_that_its_result_does_not_read(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with pipeline.scratch.owned() as left:
        out = pipeline.run(spark, str(tmp_path))
        pipeline.scratch.drop_unread(spark, left, out)
    assert out.count() and len(left) <= 2


def test_all_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert len(out) and {40, 41, 42, 43}.isdisjoint(set(out.doc_id))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
