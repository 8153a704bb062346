"""Reads what is needed of chosen documents without moving the texts of the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.shipping import ship

SLOTS = 1 << 23  # bits of the filter: 1 MB, whatever the number of ids


def slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """One bit for each slot that an id falls in; at most SLOTS / 64 rows come to the driver."""
    bit = F.expr("shiftleft(1L, cast(__slot % 64 as int))")
    rows = (
        ids.select(slot(column).alias("__slot"))
        .groupBy(F.expr("cast(__slot div 64 as int)").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .collect()
    )
    words = np.zeros(SLOTS // 64, np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words


def of_chosen(
    docs: DataFrame, ids: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``work`` on the ``(doc_id, text)`` of documents whose id is in ``ids[column]``.

    A bitmap of the ids lets the scan's own tasks skip most other documents;
    the join that follows removes those it let through by chance, so the result
    is exact and only what ``work`` makes is shuffled. ``ids`` must be distinct.
    """
    words = bitmap(ids, column)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("__slot").to_numpy()
            keep = (words[at >> 6] >> (at & 63)) & 1 == 1
            if keep.any():
                yield work(batch.filter(pa.array(keep)).drop_columns(["__slot"]))

    made = (
        docs.filter("doc_id is not null")
        .select("doc_id", "text", slot("doc_id").alias("__slot"))
        .mapInArrow(chosen, schema)
    )
    return made.join(ids.select(F.col(column).alias("__id")), F.col("doc_id") == F.col("__id")).drop("__id")


ship(__name__)
