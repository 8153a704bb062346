"""Equi-join lookups that hold up when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A key with more than this share of the total weight counts as frequent. At
# most 1 / FREQUENT_SHARE keys can, however large the data: that is the bound
# on what is broadcast.
FREQUENT_SHARE = 1e-4
SPREAD = 1 << 20


def frequent(table: DataFrame, weight: str, share: float | None = None) -> DataFrame:
    """Rows of ``table`` with more than ``share``, or ``FREQUENT_SHARE``, of all ``weight``."""
    total = table.agg(F.sum(weight).alias("total")).scalar()
    return table.filter(F.col(weight) > total * (FREQUENT_SHARE if share is None else share))


def attach(
    facts: DataFrame,
    table: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    weight: str,
    inner: bool = False,
    universe: DataFrame | None = None,
    made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns of ``table`` to ``facts``, spreading the frequent keys.

    ``on`` maps columns of facts to columns of the table; ``take`` maps columns
    of the table to their new names. ``weight`` is a column of the table that
    bounds, up to a constant, how many facts carry the row's key, such as the
    number of occurrences behind it; rows with the same key must have the same
    weight. The table is read three times, so it should be a staged one unless it
    is cheap to make.

    Facts with a frequent key find their row in a broadcast of those keys, and
    go on under random-looking keys that the table does not have (negative numbers, or texts that
    begin with a line feed), evenly over all tasks. The others meet the table in a shuffled join in which no key can own
    more than ``FREQUENT_SHARE`` of the rows. Both joins are exact. The second is on the given
    columns alone, so a table staged by them is not moved for it.

    ``made`` gives keys in ``on`` that are no columns of facts, as expressions of such; they are
    worked out where they are compared, and not moved with the facts.

    Frequent keys that the table does not have would all meet in one task. With
    ``inner``, ``universe`` may give the weight of every key that facts can have, under the
    table's names; facts with frequent keys that are absent are then dropped where they are.
    """
    names = {column: f"__{place}_{column}" for place, column in enumerate([*on.values(), *take])}

    def given(key: str) -> Column:
        return made[key] if made and key in made else F.col(key)

    def side(rows: DataFrame, tag: str, extra: Sequence[Column]) -> DataFrame:
        return rows.select(*[F.col(c).alias(tag + n) for c, n in names.items()], *extra)

    def matches(tag: str) -> Column:
        pairs = [given(f) == F.col(tag + names[t]) for f, t in on.items()]
        condition = pairs[0]
        for pair in pairs[1:]:
            condition = condition & pair
        return condition

    if inner and universe is not None:
        keys = list(on.values())
        absent = frequent(universe, weight).select(*keys).distinct().join(table.select(*keys), keys, "left_anti")
        absent = absent.select(*[F.col(c).alias("hot" + names[c]) for c in keys])
        facts = facts.join(F.broadcast(absent), matches("hot"), "left_anti")

    hot = side(frequent(table, weight), "hot", [F.lit(True).alias("__hot")])
    cold = side(table, "cold", [F.lit(True).alias("__cold")])
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(SPREAD)).cast("int") + 1
    key, *others = on
    kind = facts.select(given(key).alias(key)).schema[key].dataType
    nowhere = F.concat(F.lit("\n"), salt.cast("string")) if isinstance(kind, StringType) else (-salt).cast(kind)
    # The key is made in the condition, so that facts carry no second copy of it.
    condition = F.when(F.col("__hot"), nowhere).otherwise(given(key)) == F.col("cold" + names[on[key]])
    for other in others:
        condition = condition & (given(other) == F.col("cold" + names[on[other]]))
    joined = (
        facts.join(F.broadcast(hot), matches("hot"), "left")
        .join(cold, condition, "left")
    )
    if inner:
        joined = joined.filter(F.col("__hot") | F.col("__cold"))
    return joined.select(
        *facts.columns,
        *[
            F.coalesce(F.col("hot" + names[column]), F.col("cold" + names[column])).alias(new)
            for column, new in take.items()
        ],
    )
