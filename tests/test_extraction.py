import random

import pytest

from phrasemine.operators.chunks import count_chunks, extract_chunks
from phrasemine.operators.scoring import constituents
from phrasemine.shapes import Shape, all_shapes, chunk_shapes
from tests import brute


def random_lines(seed, n=40):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd", "e@", "f|", "ég", "\tT"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(n)]
    return lines + ["", "   ", " a", "a  b ", "one"]


def as_counts(df):
    return {(row.text, row.type): row.n for row in df.collect()}


def test_shape_codes():
    codes = {s.code: s.offsets for s in chunk_shapes(4, 4)}
    assert codes == brute.shape_table(4, 4) and len(codes) == 27
    assert [s.code for s in all_shapes(2, 1)] == [0, 200, 210]
    assert Shape(3, 1, 0).left_words == 2 and Shape(3, 1, 1).left_words == 1 and Shape(3).left_words == 1


@pytest.mark.parametrize("limits", [(1, 1), (5, 1), (2, -1), (2, 5)])
def test_limits_are_checked(limits):
    with pytest.raises(ValueError):
        chunk_shapes(*limits)


@pytest.mark.parametrize("max_words", [2, 3, 4])
@pytest.mark.parametrize("max_gap", [0, 1, 2, 3, 4])
def test_counts_equal_window_loop(make_lines, max_words, max_gap):
    lines = random_lines(10 * max_words + max_gap)
    counted = as_counts(count_chunks(make_lines(*lines), max_words, max_gap))
    assert counted == dict(brute.counts(lines, max_words, max_gap))


def test_one_line_with_all_words(make_lines):
    found = {(r.text, r.type) for r in extract_chunks(make_lines("p q r s t"), 4, 1).collect() if r.type}
    expected = """p q 200, p r 210, p q r 300, p q s 310, p r s 311, p q r s 400, p r s t 410,
        p q s t 411, p q r t 412, q r 200, q s 210, q r s 300, q r t 310, q s t 311,
        q r s t 400, r s 200, r t 210, r s t 300, s t 200"""
    assert found == {
        (" ".join(item.split()[:-1]), int(item.split()[-1])) for item in expected.split(",")
    }


def test_duplicates_in_a_line_count_each(make_lines):
    assert as_counts(count_chunks(make_lines("a b a b")))["a b", 200] == 2


def test_counts_do_not_depend_on_partitions(spark, make_lines):
    lines = make_lines(*random_lines(3))
    assert as_counts(count_chunks(lines.repartition(7))) == as_counts(count_chunks(lines.coalesce(1)))


def test_constituents_of_every_shape(spark):
    rows = [(" ".join("wxyz"[: s.words]), s.code) for s in chunk_shapes(4, 4)]
    cut = constituents(spark.createDataFrame(rows, "text string, type int")).collect()
    for row in cut:
        left, right = brute.halves(row.text, row.type)
        assert (row.left_text, row.left_type) == left and (row.right_text, row.right_type) == right
