from pyspark.sql import functions as F

from phrasemine.llm.mixing import fill, mix_sources
from tests.llm.texts import SCHEMA, awkward, words


def filled(sizes, weights, most):
    """Targets by pouring again and again."""
    total, target = sum(sizes), {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in target]
        left, w = total - sum(target.values()), sum(weights[k] for k in open_)
        over = [k for k in open_ if w and left * weights[k] / w > most * sizes[k] + 1e-9]
        if not over:
            return [target[k] if k in target else left * weights[k] / w if w else 0 for k in range(len(sizes))]
        target |= {k: most * sizes[k] for k in over}


def test_water_filling(spark):
    cases = [([10, 200, 5, 0], [1, 2, 3, 1], 3.0), ([5, 5], [1, 1], 1.0), ([100, 1, 1], [1, 50, 49], 3.0), ([7], [2], 3.0)]
    for sizes, weights, most in cases:
        rows = [(f"s{k}", s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        frame = spark.createDataFrame(rows, "source string, size long, weight int")
        got = {r.source: r.target for r in fill(frame, most).collect()}
        for k, t in enumerate(filled(sizes, weights, most)):
            assert abs(got[f"s{k}"] - t) < 1e-6, (sizes, got)


def test_mix(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "taken": F.lit(1)})
    found = mix_sources(docs.repartition(5)).collect()
    again = mix_sources(docs.coalesce(1)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    size = {i: len(words(t)) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    totals = [sum(size[r[0]] for r in rows if r[3] == s) for s in sources]
    targets = filled(totals, [1 + k % 3 for k in range(len(sources))], 3.0)
    for s, total, target in zip(sources, totals, targets, strict=True):
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {total} and abs(own[0].target - target) < 1e-6
        assert abs(sum(r.taken for r in own) - target) <= 1
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in found)
    assert mix_sources(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1)], SCHEMA)
    assert [(r.target, r.taken) for r in mix_sources(blank).collect()] == [(0.0, 0)] * 2
