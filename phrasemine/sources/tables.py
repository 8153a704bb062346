"""Corpora made from the ``documents`` and ``conversations`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemine.session import INPUT_PARTITIONS
from phrasemine.sources.lines import lines_of
from phrasemine.sources.parallel import DELIMITER


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as its scan splits it, or in ``INPUT_PARTITIONS`` parts if the session asks for that.

    The setting is for a table of one file with one row group, which is one task
    however many cores there are. Without it nothing is moved before extraction.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(line)``: every line of every document."""
    return lines_of(table(spark, folder, "documents"))


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(line)``: every line of every turn, whoever speaks."""
    return lines_of(table(spark, folder, "conversations"))


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, dst, src)``: each user turn and its reply, whole, as one line pair.

    Line breaks become spaces, so nothing of either text is lost.
    """
    turns = table(spark, folder, "conversations")
    line = F.translate("text", "\n", " ")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", line.alias("src"))
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), line.alias("dst")
    )
    return asked.join(replied, ["conv_id", "turn"]).select("conv_id", "turn", "dst", "src")


def parallel_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, value)``: the turn pairs as ``dst|src`` lines."""
    value = F.concat("dst", F.lit(DELIMITER), "src").alias("value")
    return turn_pairs(spark, folder).select("conv_id", "turn", value)


def mixed_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(value)``: the parallel lines among all document lines, most of which have no ``|``."""
    pairs = parallel_text(spark, folder).select("value")
    return pairs.unionByName(document_lines(spark, folder).withColumnRenamed("line", "value"))


def parallel_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, dst, src)``: the turn pairs, without a detour by text lines.

    A turn may hold the delimiter, after which a parallel line's text would not be read.
    """
    return turn_pairs(spark, folder)
