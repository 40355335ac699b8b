"""Streams of growing files, and imports whose sources fail apart while they are read."""

from pyspark.sql import functions as F

from lorekeep.sources import logs
from lorekeep.sources.transcripts import COLUMNS
from lorekeep.streaming import growing


def test_half_lines_over_batches_equal_a_whole_read(spark, tmp_path):
    folder, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    (folder / "deep").mkdir(parents=True)
    a, b, c = folder / "a.log", folder / "deep" / "b.log", folder / "c.txt"

    def run():
        q = growing.follow(spark, str(folder), out, str(tmp_path / "checkpoint"), ".log", lambda d: seen.append(sorted((r.path.rsplit("/", 1)[1], r.lines) for r in d.collect())))
        q.awaitTermination(120)
        assert q.exception() is None

    steps = [(a, "one\ntw"), (b, "half"), (c, "other\n"), None, (a, "o\n"), (a, "thrée\n\nfo"), (b, " whole\n"), None, (a, "ur\n"), None]
    for step in steps:
        if step is None:
            run()
        else:
            with step[0].open("a") as f:
                f.write(step[1])
    got = spark.read.parquet(f"{out}/lines").orderBy("path", "start").collect()
    assert [r.value for r in got] == ["one", "two", "thrée", "", "four", "half whole"]
    assert seen == [[("a.log", 1)], [("a.log", 3), ("b.log", 1)], [("a.log", 1)]]
    a.write_text("new\n")  # shorter than before: another file under the same name
    run()
    assert spark.read.parquet(f"{out}/lines").filter("value = 'new' and start = 0").count() == 1
    assert [r.lines for r in spark.read.parquet(f"{out}/changes").filter("path like '%a.log'").orderBy("batch").collect()] == [1, 3, 1, 1]


def test_parts_of_a_file_give_each_line_once(tmp_path):
    text = "".join(f"line {i} {'x' * (i % 17)}\n" for i in range(200)) + "unfinished"
    (tmp_path / "a.log").write_text(text)
    for part in (1, 7, 64, 1 << 20):
        reader = growing.GrowingReader({"path": str(tmp_path), "partBytes": str(part)})
        ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [r[2] for p in ranges for r in reader.read(p)] == text.splitlines()[:-1]


def test_a_source_that_breaks_while_read_leaves_the_others(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0)], "session_id string, ordinal long")
    good = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    broken = good.withColumn("text", F.raise_error(F.lit("unreadable block")).cast("string"))

    def missing():
        raise FileNotFoundError("no such store")

    sources = {"good": lambda: good, "broken": lambda: broken, "missing": missing, "more": lambda: good}
    found, failed = logs.imported(spark, sources, str(tmp_path / "import"), at_once=2)
    assert sorted(r.source for r in found.collect()) == ["good", "more"]
    assert set(failed) == {"broken", "missing"} and "unreadable block" in failed["broken"]
    assert logs.imported(spark, {"missing": missing}, str(tmp_path / "import")) == (None, {"missing": "no such store"})
