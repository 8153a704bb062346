"""Line-aligned parallel corpora: ``destination|origin`` on each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DELIMITER = "|"
MODES = ("PERMISSIVE", "FAILFAST")


def read_parallel(
    spark: SparkSession, path: str | list[str], delimiter: str = DELIMITER, mode: str = "PERMISSIVE"
) -> DataFrame:
    """``(value, dst, src)`` of the well-formed lines of the text files at ``path``."""
    return parse_parallel(spark.read.text(path), delimiter, mode)


def _fields(delimiter: str) -> Column:
    """Fields of ``value``; empty fields at the end of a line do not count."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    return F.split(F.rtrim(F.col("value"), F.lit(delimiter)), rf"\Q{delimiter}\E", -1)


def parse_parallel(
    raw: DataFrame, delimiter: str = DELIMITER, mode: str = "PERMISSIVE"
) -> DataFrame:
    """Add ``dst`` and ``src``, the first two fields of ``value``; further fields are ignored.

    A line with fewer than two fields is left out (see ``rejected_lines``), or
    fails the job in ``FAILFAST`` mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    split = raw.withColumn("__fields", _fields(delimiter))
    complete = F.size("__fields") >= 2
    if mode == "FAILFAST":
        # In the filter, as a column that nobody asks for would be left out with its error.
        error = F.raise_error(F.concat(F.lit("no second field in line: "), F.coalesce("value", F.lit("null"))))
        complete = F.when(complete, F.lit(True)).otherwise(error.cast("boolean"))
    return split.filter(complete).select(
        *raw.columns,
        F.get("__fields", F.lit(0)).alias("dst"),
        F.get("__fields", F.lit(1)).alias("src"),
    )


def parse_observed(raw: DataFrame, seen: Observation, delimiter: str = DELIMITER) -> DataFrame:
    """``parse_parallel`` that counts while it reads.

    After the first action on the result, ``seen.get`` has ``lines``, ``accepted`` and ``rejected``; no
    second scan is needed to know how many lines were set aside. A null value is rejected.
    """
    complete = F.coalesce(F.size(_fields(delimiter)) >= 2, F.lit(False))
    counts = {"lines": F.lit(True), "accepted": complete, "rejected": ~complete}
    observed = raw.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()])
    return parse_parallel(observed, delimiter)


def rejected_lines(raw: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """Lines that ``parse_parallel`` leaves out."""
    return raw.filter(F.size(_fields(delimiter)) < 2)
