import random

import pytest
from pyspark.sql import functions as F

from phrasemine.functions.association import chi_square
from phrasemine.plans.mining import mine_chunks, mine_groups, score_corpus
from tests import brute

M1 = ["a b c", "a b d", "a x b", ""]
M2 = ["a a b", "a"]
M3 = ["a b", "a b", "a b c"]
M4 = ["a b c d", "a x b c", "b c a", "", "", "", ""]
M5 = ["a a a"]


def scored(lines, *limits):
    return {
        (r.text, r.type): ((r.n11, r.n10, r.n01, r.n00), r.chi2)
        for r in score_corpus(lines, *limits).collect()
    }


def check(found, expected):
    for key, (cells, chi2) in expected.items():
        assert found[key][0] == cells, key
        assert found[key][1] == pytest.approx(chi2, abs=1e-6), key


def test_small_corpus(make_lines):
    found = scored(make_lines(*M1))
    check(found, {
        ("a b", 200): ((2, 1, 1, 0), 0.444444),
        ("a b", 210): ((1, 2, 2, -1), 11.111111),
        ("a c", 210): ((1, 2, 0, 1), 0.444444),
        ("a d", 210): ((1, 2, 0, 1), 0.444444),
        ("a x", 200): ((1, 2, 0, 1), 0.444444),
        ("b c", 200): ((1, 2, 0, 1), 0.444444),
        ("b d", 200): ((1, 2, 0, 1), 0.444444),
        ("x b", 200): ((1, 0, 2, 1), 0.444444),
    })
    assert len(found) == 8
    kept = {(r.text, r.type) for r in mine_chunks(make_lines(*M1)).collect()}
    assert kept == set(found) - {("a b", 210)}
    assert mine_groups(make_lines(*M1)).count() == 0


def test_negative_scores_are_kept(make_lines):
    found = scored(make_lines(*M2))
    check(found, {
        ("a a", 200): ((1, 2, 2, -3), 10.888889),
        ("a b", 200): ((1, 2, 0, -1), -0.666667),
        ("a b", 210): ((1, 2, 0, -1), -0.666667),
    })
    assert mine_chunks(make_lines(*M2)).count() == 2
    rows = sorted(mine_groups(make_lines(*M2)).collect(), key=lambda r: (r.level, r.type or 0))
    assert [(r.text, r.level, r.type, r.types) for r in rows] == [
        ("a b", 1, 200, [200, 210]), ("a b", 1, 210, [200, 210]), ("a b", 2, None, [200, 210]),
    ]
    assert rows[2].chi2 == pytest.approx(-1.333333, abs=1e-6)


def test_zero_margins_score_the_fixed_value(make_lines):
    found = scored(make_lines(*M3))
    check(found, {
        ("a b", 200): ((3, 0, 0, 0), 20), ("a c", 210): ((1, 2, 0, 0), 20), ("b c", 200): ((1, 2, 0, 0), 20),
    })
    assert len(found) == 3 and mine_chunks(make_lines(*M3)).count() == 0


def test_trigrams_and_strict_threshold(make_lines):
    found = scored(make_lines(*M4), 3, 1)
    check(found, {
        ("a b", 200): ((1, 2, 2, 2), 0.194444), ("a b", 210): ((1, 2, 2, 2), 0.194444),
        ("a b c", 300): ((1, 2, 2, 2), 0.194444), ("a b c", 311): ((1, 2, 2, 2), 0.194444),
        ("a b d", 310): ((1, 0, 0, 6), 7.0), ("a c d", 311): ((1, 2, 0, 4), 1.555556),
        ("a x b", 300): ((1, 2, 0, 4), 1.555556), ("a x c", 310): ((1, 0, 2, 4), 1.555556),
        ("b c", 200): ((3, 0, 0, 4), 7.0),
    })
    kept = {(r.text, r.type) for r in mine_chunks(make_lines(*M4), 3, 1).collect()}
    assert ("b c", 200) not in kept and ("a b d", 310) not in kept and ("a b c", 311) in kept
    pooled = {r.text: r.chi2 for r in mine_groups(make_lines(*M4), 3, 1).collect() if r.level == 2}
    assert pooled["a b"] == pytest.approx(0.388889, abs=1e-6)
    assert pooled["a b c"] == pytest.approx(0.388889, abs=1e-6)


def test_clamps(make_lines):
    found = scored(make_lines(*M5))
    check(found, {("a a", 200): ((1, 0, 0, 0), 20), ("a a", 210): ((1, 0, 0, 0), 20)})
    assert mine_chunks(make_lines(*M5)).count() == 0 and mine_groups(make_lines(*M5)).count() == 0


@pytest.mark.parametrize("seed,limits", [(1, (2, 1)), (2, (3, 2)), (3, (4, 4))])
def test_random_corpora(make_lines, seed, limits):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("aabcdé@") for _ in range(rng.randrange(10))) for _ in range(25)] + ["a " * 40]
    found, expected = scored(make_lines(*lines), *limits), brute.tables(lines, *limits)
    assert {key: cells for key, (cells, _) in found.items()} == expected
    for cells, chi2 in found.values():
        assert sum(cells) == len(lines)
        assert chi2 == pytest.approx(brute.chi2(*cells), rel=1e-12)


@pytest.mark.parametrize("limits", [(2, 1), (4, 3)])
def test_groups_pool_the_tables(make_lines, limits):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(80)]
    tables = brute.tables(lines, *limits)
    groups = {}
    for (text, code), cells in tables.items():
        groups.setdefault(text, {})[code] = cells
    expected = {}
    for text, members in groups.items():
        pooled = brute.chi2(*map(sum, zip(*members.values())))
        if len(members) > 1 and pooled < 6.63:
            expected[text] = (sorted(members), pooled, {c: brute.chi2(*t) for c, t in members.items()})
    rows = mine_groups(make_lines(*lines), *limits).collect()
    assert {r.text for r in rows} == set(expected) and expected
    for r in rows:
        types, pooled, single = expected[r.text]
        assert r.types == types
        assert r.chi2 == pytest.approx(pooled if r.level == 2 else single[r.type], rel=1e-12)
    assert len(rows) == sum(len(types) + 1 for types, _, _ in expected.values())


def test_single_occurrences_can_be_left_out(make_lines):
    rows = mine_chunks(make_lines(*M1), single_occurrences=False).collect()
    assert [(r.text, r.type) for r in rows] == [("a b", 200)]


def test_large_cells_do_not_overflow_and_ties_stay_ties(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randrange(10**9) for _ in range(4)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "a long, b long, c long, d long")
    scores = frame.select(
        chi_square(*map(F.col, "abcd")).alias("one"), chi_square(*map(F.col, "acbd")).alias("two")
    ).collect()
    for (a, b, c, d), row in zip(rows, scores):
        assert row.one == row.two
        assert row.one == pytest.approx(float(brute.chi2(a, b, c, d)), rel=1e-6, abs=1e-6)
