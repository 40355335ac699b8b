"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns what it keeps;
all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, jaccard, language, mixing, packing, scratch


def _stage(function):
    """A stage that deletes those of the tables it wrote itself that its result does not read."""

    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch.owned() as tables:
            out = function(spark, docs, sf_dir)
        scratch.drop_unread(spark, tables, out)
        scratch.hand_over(tables)
        return out

    return stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those of no language in particular (best probability under 0.4).

    Null, empty and blank texts go; rows that repeat a text stay or go alike.  Without a
    language to learn every text goes.
    """
    model = language.fit(docs, language.default_vocabulary())
    return language.predict(docs, model, docs.columns).filter("lang_pred <> 'und' and score >= 0.4").select("doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc): docs with a number for each row, by which stages decide, as ids may be null or repeat.

    That is the id where no two rows share one and none is null; else a hash of a row's file and
    place in it; where that is not known, or two rows ever share it, docs is written once with
    numbers.
    """
    doc = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    numbers = [F.xxhash64("_metadata.file_path", "_metadata.row_index")]
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int"):
        numbers.insert(0, docs["doc_id"].cast("long"))
    for number in numbers:
        try:
            named = docs.select(number.alias("row"), doc)
            seen = named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("different")).first()
            if seen.n == seen.different:
                return named
        except AnalysisException:  # no rows of files
            pass
    return scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), doc), "rows")


#: Bits of the map of the rows that go.
BITS = 24


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of all rows but those that go.

    Most rows stay, which a map of 2 ** BITS bits tells without a shuffle of their texts at any
    size; only rows that meet a bit are joined with the numbers themselves.
    """
    gone = scratch.table(gone.select("row"), "gone")
    at = F.pmod(F.xxhash64("row"), F.lit(1 << BITS))
    word, bit = F.shiftright(at, 6).cast("int"), (at % 64).cast("int")
    words = gone.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    told = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")  # 2 ** BITS bits at most
    may = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return told.filter(~may).select("doc.*").unionByName(told.filter(may).join(gone, "row", "left_anti").select("doc.*"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays: the longest original, then the smallest id (null last), then the first row.

    Null, empty and blank texts are equal to each other.
    """
    rows = _keyed(docs)
    named = rows.select(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row").alias("name"), F.col("doc.text").alias("text"))
    return _without(rows, exact_dedup.exact_duplicates(named, id_col="name").filter("not kept").select("name.row"))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 or more on 5-word shingles the smallest id stays; where ids are null or repeat, one row.

    Texts without a word are linked with nothing and stay.
    """
    rows = _keyed(docs)
    return _without(rows, jaccard.similar_components(rows.select("row", F.col("doc.text").alias("text")), k=5, num=4, den=5, id_col="row").filter("component_id <> row"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes rows by the sources' target weights; one taken twice is two rows.  Texts without a word are not taken."""
    return mixing.mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences of at most 4096 tokens; a null text is its end id alone."""
    return packing.pack(docs, packing.default_tokenizer(), balance=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mixture),
    ("best_fit_packing", packed),
]

#: Model fitting, connected components and packing have no SQL: tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus.  Each run has tables of its own and deletes those that its later stages no longer read; results of other runs stay whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.owned() as tables:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
            scratch.drop_unread(spark, tables, docs)
        out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop_unread(spark, tables, out)
    return out
