"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemine.plans.stage import stage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges`` ``(a, b)``: the smallest id reachable.

    Alternates large-star and small-star steps; each is a grouping and a join,
    each pair of steps is written as a table, and the number of pairs grows with
    the logarithm of the longest path. Loops are ignored; no edges give no rows.
    """
    both = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = stage(both.distinct(), "edges")
    mark = None
    while True:
        ends = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            ends.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        now = stage(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    star = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.unionAll(star.select(F.col("component").alias("id"), "component").distinct())
