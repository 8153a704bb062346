"""Mixing sources to target weights by capped water-filling, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemine.plans.stage import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets of a source's documents


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to ``(source, size, weight)``: shares of the sum of all sizes by weight.

    A target stops at ``max_epochs`` times its source's size, and what is in
    excess goes to the others by weight until none is above. Sources fill up in
    the order of cap / weight, so the level at which the water stands after the
    first k are full is a running sum, and one pass finds the level that holds.
    Works on one row per source. Sources without size or weight get 0.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    active = F.col("weight") > 0
    rows = sources.withColumn("__cap", F.when(active, cap).otherwise(0.0)).withColumn(
        "__full_at", F.when(active, F.col("__cap") / F.col("weight")).otherwise(0.0)
    )
    everything = Window.partitionBy()
    before = Window.orderBy("__full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    thirst = F.sum(F.col("weight").cast("double")).over(everything) - F.coalesce(
        F.sum(F.col("weight").cast("double")).over(before), F.lit(0.0)
    )
    rows = rows.withColumn("__level", F.when(thirst > 0, left / thirst))
    # The first source that the level does not fill sets the level of all after it.
    level = F.min(F.when(F.col("__full_at") >= F.col("__level"), F.struct("__full_at", "__level"))).over(everything)
    target = F.when(level.isNull(), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), F.col("weight") * level["__level"])
    )
    return rows.withColumn("target", target.cast("double")).drop("__cap", "__full_at", "__level")


def rotating_weights(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """Add ``weight`` to ``(source, size)``: 1 to ``cycle`` in turn, by code point, null last.

    The one window without partitions works on one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.pmod(turn, F.lit(cycle)) + 1)


def mix_sources(
    docs: DataFrame, weights=rotating_weights, max_epochs: float = 3.0, seed: int = 17
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns are kept out.
    Returned are ``(doc_id, source, size, source_size, target, taken)``. A
    document is taken whole as often as its source's target goes whole into its
    source. The fractional repetition goes to documents in a seeded order until
    the target is reached; the last one is taken in part. Null sources are one
    source, null or empty texts have size 0 and are taken 0 words of, repeated
    rows each count. An empty table gives no rows. Rows with the same key in the
    seeded order and the same size are interchangeable, so reruns agree.

    The order is that of an MD5 of seed and id, and sums run over
    ``source`` x 4096 buckets of it, so no source's documents meet in one task.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"
    ).withColumn("__key", key)
    sized = sized.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    buckets = stage(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum")), "buckets")
    totals = buckets.groupBy("source").agg(F.sum("__sum").alias("size"))
    plan = fill(weights(totals), max_epochs).select(
        F.col("source").alias("__s"), F.col("size").alias("source_size"), "target"
    )
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    place = buckets.select(
        F.col("source").alias("__bs"), F.col("__bucket").alias("__bb"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
    )
    place = place.join(plan, F.col("__bs").eqNullSafe(F.col("__s")))
    inside = (
        Window.partitionBy("source", "__bucket")
        .orderBy("__key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        place, F.col("source").eqNullSafe(F.col("__bs")) & (F.col("__bucket") == F.col("__bb"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("__whole") * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("__offset") - F.col("__before")))
    return placed.withColumn("__whole", whole.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("__whole") * F.col("size") + part).cast("long").alias("taken"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 AS w,
         3.0::DOUBLE * source_size AS cap
  FROM totals),
levels AS (
  SELECT *, cap / w AS full_at,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER prev, 0))
      / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER prev, 0)::DOUBLE) AS lev
  FROM weighted WINDOW prev AS (ORDER BY cap / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
the_level AS (SELECT arg_min(lev, full_at) AS l FROM levels WHERE full_at >= lev),
plan AS (SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, w * l) END AS target
         FROM levels CROSS JOIN the_level),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
    CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(size, greatest(0, CAST(round(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM placed
"""
