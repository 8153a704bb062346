"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written
and read again as the ``docs`` of the next. All but the last keep the columns of
``documents`` and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemine.llm.decontaminate import contamination
from phrasemine.llm.mixing import mix_sources
from phrasemine.llm.ngram_join import ngram_join
from phrasemine.llm.quality_cnn import score_quality
from phrasemine.llm.suffix_dedup import suffix_dedup
from phrasemine.plans.stage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return score_quality(docs, labels).filter("predicted = 1").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each different document, ``__key``: its id, where one row has that id.

    Rows that agree in id and text are one document. Of different texts with one id, the one
    with the least digest has the id; the others, and documents without id, are numbered beyond
    the largest id, in the order of id (null last) and digest.
    """
    docs = docs.select(*COLUMNS)
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    again = stage(often.select("doc_id"), "again")
    if again.isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    digest = F.coalesce(F.md5("text"), F.lit("")).alias("digest")
    some = docs.filter("doc_id is not null").join(again, "doc_id").unionByName(docs.filter("doc_id is null"))
    texts = stage(some.select("doc_id", digest).distinct(), "texts")
    extra = texts.join(texts.groupBy("doc_id").agg(F.min("digest").alias("digest")), ["doc_id", "digest"], "left_anti")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    ordered = extra.orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    numbers = ordered.select(
        F.col("doc_id").alias("__id"),
        F.col("digest").alias("__digest"),
        (F.monotonically_increasing_id() + F.lit(top + 1)).alias("__number"),
    )
    numbers = stage(numbers, "numbers")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    return docs.join(numbers, same, "left").select(*COLUMNS, F.coalesce("__number", "doc_id").alias("__key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, those without id last.

    Rows that agree in id and text are one document, and one of them stays; different texts with
    one id are different documents. Documents without words link with nothing and stay,
    those without id too as rows.
    """
    own = keyed(docs)
    groups = ngram_join(own.select(F.col("__key").alias("doc_id"), "text"))
    gone = groups.filter("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias("__key")).distinct()
    left = own.join(gone, "__key", "left_anti")
    blank = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~blank).dropDuplicates(["__key"]).unionByName(left.filter(blank)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; a character that was cut into goes as a whole.

    All rows stay, some with an empty text; ``n_chars`` follows the text.
    """
    kept = suffix_dedup(docs, as_text=True)
    cut = F.col("n_removed") > 0
    return (
        kept.withColumn("n_chars", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
        .withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
        .select(*COLUMNS)
    )


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; of texts with one id, or without, each is judged by itself."""
    own = keyed(docs)
    benchmark = table(spark, sf_dir, "benchmark")
    found = contamination(own.withColumn("doc_id", F.col("__key")), benchmark).select(F.col("doc_id").alias("__key"))
    return own.join(found.distinct(), "__key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("mix", mix),
]

#: SQL cannot express the classifier or the searches; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
