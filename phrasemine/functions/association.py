"""2x2 association: cells as columns in, score as a column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the score of a table in which some row or column sums to zero.
DEGENERATE_SCORE = 20.0


def chi_square(
    n11: Column, n10: Column, n01: Column, n00: Column, degenerate: float = DEGENERATE_SCORE
) -> Column:
    """Pearson chi-square of a 2x2 table, in double precision.

    Cells may be negative. The bracketing of the denominator makes the result
    the same to the last bit when n10 and n01 change places, so that ties stay
    ties; the casts come before the products because long products overflow.
    """
    a, b, c, d = (cell.cast("double") for cell in (n11, n10, n01, n00))
    spread = ((a + b) * (c + d)) * ((a + c) * (b + d))
    cross = a * d - b * c
    return F.when(spread != 0, (a + b + c + d) * cross * cross / spread).otherwise(
        F.lit(degenerate)
    )


def clamped_cells(n: Column, left: Column, right: Column, lines: Column) -> dict[str, Column]:
    """Cells for a chunk seen ``n`` times whose halves are seen ``left`` and ``right`` times.

    A chunk can occur more often than there are lines. The joint cell is then
    held at the number of lines, and a margin beyond it falls back to the rest.
    """
    n11 = F.least(n, lines)

    def margin(total: Column) -> Column:
        rest = total - n11
        return F.when(rest > lines, lines - n11).otherwise(rest)

    n10, n01 = margin(left), margin(right)
    return {"n11": n11, "n10": n10, "n01": n01, "n00": lines - n10 - n01 - n11}


def remainder_cells(joint: Column, source: Column, target: Column, lines: Column) -> dict[str, Column]:
    """Cells for two items seen ``joint`` times together, taken as they come (no clamps)."""
    n10, n01 = source - joint, target - joint
    return {"n11": joint, "n10": n10, "n01": n01, "n00": lines - n10 - n01 - joint}
