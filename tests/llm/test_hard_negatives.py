import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemine.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=5, share=80, scale=256):
    """All scores, sorted."""
    use = []
    for n, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((n, i, [math.floor(scale * x) for x in v], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, i, v, label in use:
        if i is None or i % 100:
            continue
        every = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, j, w, other in use if m != n and len(w) == len(v)]
        for p, pid, _ in sorted([r for r in every if r[2] == label], key=order)[:k]:
            near = [r for r in every if r[2] != label and share * p <= 100 * r[0] <= 100 * p]
            out += [(i, pid, rank, j, p, s) for rank, (s, j, _) in enumerate(sorted(near, key=order)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "anchor": F.lit("x"), "cell": F.lit(None)})
    return sorted(map(tuple, hn.hard_negatives(vectors.repartition(3), F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def gathered(seed, n, dims, near):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(4, dims))
    x = centers[r.integers(0, 4, n)] + near * r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(10 * k, [float(c) for c in x[k]], int(r.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize("near, dims", [(0.05, 20), (0.6, 33), (5.0, 8)])
def test_against_all_scores(spark, monkeypatch, near, dims):
    monkeypatch.setattr(hn, "BLOCK", 37)
    monkeypatch.setattr(hn, "ANCHORS", 9)
    monkeypatch.setattr(hn, "BLOCKS_A_TASK", 2)
    rows = gathered(4, 260, dims, near)
    expected = plain(rows)
    assert expected and found(spark, rows) == expected
    assert found(spark, rows, positives=2, negatives=3) != expected


def test_ties_nulls_and_lengths(spark):
    one, two = [0.5, 0.25, 0.0], [0.5, 0.24, 0.1]
    rows = [(100 * k, one, k % 2) for k in range(6)] + [(7, one, 0), (8, one, 1), (9, two, 1), (None, one, 1), (None, two, 0)]
    rows += [(100, one, 0), (300, two, 1), (11, None, 0), (12, [0.5, None, 0.1], 1), (13, [0.5, math.nan, 0.1], 1)]
    rows += [(14, [math.inf, 0.0, 0.0], 0), (15, one, None), (1000, [1.0], 0), (1001, [1.0], 0), (1002, [0.9], 1)]
    rows += [(2000, [], 0), (2001, [], 0), (2002, [], 1), (3000, [0.0, 0.0, 0.0], 5), (3001, [-0.5, 0.0, 0.0], 5)]
    rows += [(4000, [1e5, -2e5], 2), (4001, [1e5, -1e5], 2), (4002, [1e5, -1.1e5], 3)]
    # Of rows that are equal throughout, any may be the first.
    assert found(spark, rows) == plain(rows)


def test_empty_and_too_large(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, None, None)]) == []
    with pytest.raises(Exception, match="does not fit"):
        found(spark, [(100, [1e12], 0), (101, [1e12], 0), (102, [1e12], 1)])


def test_scan_leaves_what_cannot_be_among_the_first():
    r = random.Random(1)
    x = np.array([[r.randrange(-50, 50) * (1000 if d == 3 else 1) for _ in range(400)] for d in range(24)], float)
    a = np.array([r.randrange(-50, 50) * (1000 if d == 3 else 1) for d in range(24)], float)
    scan, looks = hn.Scan(x, a, x.min(1), x.max(1)), []
    assert scan.order[0] == 3
    b = {"rows": np.arange(400), "ids": np.arange(400)}
    call = hn.Scan.__call__

    def watched(self, alive, keep):
        def look(lower, upper):
            assert (lower <= upper).all()
            looks.append(len(lower))
            return keep(lower, upper)

        return call(self, alive, look)

    try:
        hn.Scan.__call__ = watched
        best = hn.positives_of(scan, b, slice(0, 400), -1, [], 5)
    finally:
        hn.Scan.__call__ = call
    exact = a @ x
    assert best == sorted((-int(s), k, k) for k, s in enumerate(exact))[:5]
    assert looks[0] == 400 and looks[-1] < 100
