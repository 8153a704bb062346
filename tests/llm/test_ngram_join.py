import random

import numpy as np
from pyspark.sql import functions as F

from phrasemine.llm.ngram_join import build_index, divide_skip, ngram_join
from tests.llm.texts import SCHEMA, awkward, near_groups


def test_divide_skip_finds_the_same_as_intersection():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 60)
        query = sorted(rng.sample(range(200), n))
        sets = []
        for _ in range(rng.randrange(1, 12)):
            other = set(query)
            for _ in range(rng.randrange(0, n)):
                other.discard(rng.choice(query))
                if rng.random() < 0.5:
                    other.add(rng.randrange(200, 300))
            sets.append(sorted(other) or [299])
        found = divide_skip(np.array(query, np.uint64), build_index([np.array(s, np.uint64) for s in sets]), 80)
        expected = [
            k for k, s in enumerate(sets) if 100 * len(set(query) & set(s)) >= 80 * len(set(query) | set(s))
        ]
        assert sorted(found) == expected


def test_against_all_pairs(spark):
    rows = awkward()
    docs = spark.createDataFrame([*rows, (None, rows[0][1], None, None, 1)], SCHEMA)
    docs = docs.withColumns({"component_id": F.lit("clash"), "n": F.lit(1), "rep": F.lit(2)})
    sizes, groups = near_groups(rows)
    found = ngram_join(docs.repartition(3)).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        if r.doc_id is None:
            assert r.component_id == groups[0]
        else:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], groups[r.doc_id]), r
    assert len(set(groups.values())) < len(groups) - 10


def test_nothing_to_join(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0)], SCHEMA)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(blank).collect()} == {(1, 0, 1), (2, 0, 2)}
