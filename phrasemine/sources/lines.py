"""Line corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line)``: one row per line of the text files at ``path``, blank lines included."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """``(line)``: the lines of a text column."""
    return df.select(F.explode(F.split(text, "\n", -1)).alias("line"))


def corpus_size(lines: DataFrame) -> DataFrame:
    """One row ``(lines)``: the number of lines, blank ones included."""
    return lines.agg(F.count(F.lit(1)).alias("lines"))
