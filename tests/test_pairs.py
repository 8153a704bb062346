"""Chunks of two words get the counts of their words where they are counted."""

import random

import pytest
from pyspark.sql import functions as F

from phrasemine.operators import chunks as chunk_ops
from phrasemine.operators import scoring
from phrasemine.operators.groups import group_scores, pair_group_scores
from phrasemine.plans.mining import mine_chunks
from tests import brute


def corpus():
    rng = random.Random(5)
    words = ["the"] * 12 + ["a"] * 5 + [f"w{k}" for k in range(40)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(120)]
    return [*lines, "", "  ", "b b b b  c", "@ the"]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(params=[(0.05, 0.02), (0.9, 0.9), (0.0, 0.0), (0.05, 0.9)])
def shares(request, monkeypatch):
    monkeypatch.setattr(chunk_ops, "BEGINS_MANY", request.param[0])
    for module in (chunk_ops, scoring):
        monkeypatch.setattr(module, "COMMON_SHARE", request.param[1])


@pytest.mark.parametrize("max_gap", [1, 4])
def test_cells_are_those_of_the_lookups(make_lines, shares, max_gap):
    lines = make_lines(*corpus())
    counts = chunk_ops.stage_counts(lines, 2, max_gap)
    columns = ["text", "type", *scoring.CELLS]
    expected = scoring.contingency(counts, chunk_ops.line_total(counts), 2).select(*columns)
    assert rows(scoring.pair_contingency(lines, max_gap).select(*columns)) == rows(expected)
    assert len(rows(expected)) == len([1 for _, code in brute.counts(corpus(), 2, max_gap) if code])


@pytest.mark.parametrize("threshold", [0.05, 7.0, 25.0])
def test_only_chunks_not_below_the_threshold_are_left_out(make_lines, shares, threshold):
    lines = make_lines(*corpus())
    every = scoring.score(scoring.pair_contingency(lines).drop("types"))
    expected = rows(every.filter(F.col("chi2") < threshold))
    assert rows(mine_chunks(lines, threshold=threshold)) == expected
    assert expected


def test_groups_are_those_of_the_counts(make_lines, shares):
    lines = make_lines(*corpus())
    counts = chunk_ops.stage_counts(lines, 2, 2)
    expected = group_scores(counts, chunk_ops.line_total(counts), 2, 2)
    assert rows(pair_group_scores(lines, 2).drop("type")) == rows(expected.drop("type"))


def test_windows_are_all_that_moves(spark, make_lines):
    """One exchange, of windows; the words lie by text. Before, texts moved once more for each half."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = make_lines(*corpus())
        counted = chunk_ops.pair_counts(lines, chunk_ops.stage_words(lines))
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    main = plan.split("Subquery")[0]
    assert main.count("Exchange hashpartitioning") == 1
    moved = next(line for line in main.splitlines() if "Exchange hashpartitioning" in line)
    assert "__window" in moved
