import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemine.llm.decontaminate import MASKS, best_run, build_index, contamination, overlaps
from tests.llm.texts import SCHEMA, prose


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [prose(rng, n, 10**6) for n in (40, 25, 12, 7)]
    swapped = list(items[0])
    swapped[9], swapped[21] = "other", "words"
    texts = {
        0: prose(rng, 50) + items[0] + prose(rng, 30),
        1: prose(rng, 50) + swapped,
        2: items[1][5:20] + prose(rng, 9),
        3: [w.upper() for w in items[2]],
        4: prose(rng, 3) + items[3] + prose(rng, 3),
        5: prose(rng, 400),
        6: items[1][:11] + prose(rng, 40),
        7: items[3][:6] + ["x"],
        8: prose(rng, 30000, 10**5) + items[1],
    }
    rows = [(k, " ".join(t), None, None, 1) for k, t in texts.items()]
    rows += [(20, None, None, None, None), (21, "", None, None, 0), rows[0]]
    benchmark = [(k, " ".join(t)) for k, t in enumerate(items)] + [(4, None), (5, ""), (6, " ".join(items[1]))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    return docs, spark.createDataFrame(benchmark, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


@pytest.mark.parametrize("shard", [10**6, 150])
def test_planted_passages(planted, shard):
    docs, benchmark = planted
    found = {(r.doc_id, r.item_id): (r.n_matched, r.n_words, r.first_word, r.item_word) for r in contamination(docs, benchmark, shard_chars=shard).collect()}
    assert found == {
        (0, 0): (40, 40, 50, 0),
        (1, 0): (38, 40, 50, 0),
        (2, 1): (15, 15, 0, 5),
        (2, 6): (15, 15, 0, 5),
        (3, 2): (12, 12, 0, 0),
        (4, 3): (7, 7, 3, 0),
        (8, 1): (25, 25, 30000, 0),
        (8, 6): (25, 25, 30000, 0),
    }


def test_empty_tables(planted):
    docs, benchmark = planted
    assert contamination(docs, benchmark.limit(0)).collect() == []
    assert contamination(docs.limit(0), benchmark).collect() == []


def hit(same):
    """Whether a mask finds all its words equal somewhere."""
    return any(
        all(same[a + k] for k, bit in enumerate(m) if bit == "1") for m in MASKS for a in range(len(same) - len(m) + 1)
    )


@pytest.mark.parametrize("size", range(12, 18))
def test_masks_hit_every_stretch_that_is_accepted(size):
    accepted = 0
    for n in range(size // 3 + 1):
        for wrong in combinations(range(size), n):
            same = np.ones(size, bool)
            same[list(wrong)] = False
            _, first, end = best_run(same, 2)
            if end - first >= 12:
                accepted += 1
                assert hit(same[first:end]), wrong
    assert accepted > size


def test_masks_hit_long_stretches():
    # Whatever follows, the first 12 words of a stretch follow this rule.
    for wrong in combinations(range(12), 3):
        if all(at >= 3 * (k + 1) for k, at in enumerate(wrong)):
            assert hit([k not in wrong for k in range(12)]), wrong


@pytest.mark.parametrize("wrong", [[7], [3, 7], list(range(3, 59, 4)), list(range(3, 56, 3))])
def test_substituted_words_are_found(wrong):
    rng = random.Random(3)
    size = 12 if len(wrong) < 3 else 59
    item = prose(rng, size, 10**6)
    text = [f"other{k}" if k in wrong else w for k, w in enumerate(item)]
    index = build_index([1], pa.array([" ".join(item)], pa.large_string()))
    for before in ([], prose(rng, 20, 10**6)):
        data = np.frombuffer(" ".join(before + text + before).encode(), np.uint8)
        found = overlaps(index, data, np.array([0, len(data)]), 12, 2)
        assert found == [(0, 0, size - len(wrong), size, len(before), 0)]


def test_narrower_rules_are_refused(planted):
    for rule in ({"least": 11}, {"gap": 1}):
        with pytest.raises(ValueError):
            contamination(*planted, **rule)
