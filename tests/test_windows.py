"""Chunks counted from shuffled windows: what is moved, and that frequent first words change no count."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasemine.functions.text import pieces
from phrasemine.operators import chunks as chunk_ops
from phrasemine.operators import scoring
from phrasemine.operators.groups import multi_type_chunks
from phrasemine.operators.scoring import contingency, pair_contingency
from phrasemine.plans import mining
from phrasemine.plans.stage import stage
from phrasemine.shapes import all_shapes, chunk_shapes
from tests import brute


def exchanges(df, kind="Exchange hashpartitioning"):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan, df._jdf.queryExecution().executedPlan().toString().count(kind)


@pytest.mark.parametrize("looked_at, many", [(1.0, 0.05), (1.0, 0.9), (1.0, 0.0)])
def test_frequent_first_words_change_no_count(spark, make_lines, monkeypatch, looked_at, many):
    monkeypatch.setattr(chunk_ops, "LOOKED_AT", looked_at)
    monkeypatch.setattr(chunk_ops, "BEGINS_MANY", many)
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["the", "the", "the", "a", "b", "@"]) for _ in range(rng.randrange(14))) for _ in range(30)]
    found = chunk_ops.count_chunks(make_lines(*lines, "", "  "), 4, 4).collect()
    assert len({(r.text, r.type) for r in found}) == len(found)
    assert {(r.text, r.type): r.n for r in found} == dict(brute.counts(lines, 4, 4))


def test_null_words_break_windows_and_copies_count(spark):
    lines = spark.createDataFrame([("a  b c d", 3), ("a b", 2), (" a b", 1), (None, 5)], "line string, copies long")
    parts = F.transform(pieces(F.col("line")), lambda piece: F.nullif(piece, F.lit("")))
    found = chunk_ops.count_shapes(lines, chunk_shapes(4, 0), parts, "copies").collect()
    assert {(r.text, r.type): r.n for r in found} == {
        ("b c", 200): 3, ("c d", 200): 3, ("b c d", 300): 3, ("a b", 200): 3
    }


def test_one_row_a_position_is_moved(spark, make_lines):
    """All 27 shapes of a word without many windows come of one shuffled row; before, each shape was one."""
    line = " ".join(f"w{k}" for k in range(200))
    counted = chunk_ops.count_shapes(make_lines(line), chunk_shapes(4, 4))
    plan = counted._jdf.queryExecution().analyzed().toString()
    moved = plan.index("RepartitionByExpression")
    assert plan.index("Aggregate") < plan.index("Generate inline(array(struct(text") < moved
    assert counted.count() == sum(201 - s.span for s in chunk_shapes(4, 4))


def test_halves_are_not_moved_beside_their_chunk(spark, make_lines):
    """The rows that move for the lookups hold the text once; before, four copies or parts of it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = chunk_ops.stage_counts(make_lines("a b c a b d", "b c"))
        plan = contingency(counts, F.lit(2).cast("long"))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    widths = []

    def walk(node):
        if node.nodeName() == "Exchange":
            names = [node.output().apply(k).dataType().typeName() for k in range(node.output().size())]
            widths.append(names.count("string"))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    # The second string is the frequent half that was found in the broadcast, null for others.
    assert widths and max(widths) <= 2


def test_rows_of_texts_with_several_types(spark):
    rows = [("a b", 200, 3), ("a b", 210, 1), ("c d", 200, 5), ("a", 0, 9), ("", -1, 4)]
    counts = spark.createDataFrame(rows, "text string, type int, n long")
    found = {tuple(r) for r in multi_type_chunks(counts).select("text", "type", "n").collect()}
    assert found == {("a b", 200, 3), ("a b", 210, 1)}
    assert len(all_shapes(2, 1)) == 3


@pytest.mark.parametrize("words", [2, 3])
def test_tasks_that_count_grow_with_the_words(spark, make_lines, monkeypatch, words):
    """A task's share of the windows is bounded, whatever the session's number of shuffle partitions."""
    lines = make_lines(*[" ".join(f"w{(k * j) % 37}" for j in range(12)) for k in range(400)])
    expected = sorted(map(tuple, chunk_ops.count_shapes(lines, chunk_shapes(words, 1)).collect()))
    scored = sorted(map(tuple, pair_contingency(lines).collect()))
    parts = []

    def watched(*args, inner=chunk_ops.cut_windows, **options):
        cut = inner(*args, **options)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        parts.append(int(re.search(r"(\d+)\), REPARTITION_BY_NUM", plan)[1]))
        return cut

    monkeypatch.setattr(chunk_ops, "cut_windows", watched)
    monkeypatch.setattr(chunk_ops, "A_TASK", 500)
    assert sorted(map(tuple, chunk_ops.count_shapes(lines, chunk_shapes(words, 1)).collect())) == expected
    assert sorted(map(tuple, pair_contingency(lines).collect())) == scored
    assert len(parts) == 2 and min(parts) >= 10


def chunk_rows(df):
    cells = ("text", "type", "n11", "n10", "n01", "n00")
    return sorted(tuple(r[c] for c in cells) for r in df.collect())


@pytest.mark.parametrize("max_words, max_gap, many", [(4, 4, 1e-3), (4, 4, 0.05), (4, 4, 0.9), (3, 2, 0.2), (4, 0, 0.2), (2, 4, 0.2)])
def test_halves_counted_at_positions_give_the_same_cells(spark, make_lines, monkeypatch, max_words, max_gap, many):
    monkeypatch.setattr(scoring, "BEGINS_MANY", many)
    rng = random.Random(5)
    words = ["the", "the", "the", "a", "b", "1", ",", "@"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(40)]
    lines = make_lines(*lines, "", "  ", "a  b", "alone")
    counts = chunk_ops.stage_counts(lines, max_words, max_gap)
    expected = contingency(counts, chunk_ops.line_total(counts), max_words)
    found, _ = scoring.window_contingency(lines, max_words, max_gap)
    assert chunk_rows(found) == chunk_rows(expected) != []
    several, _ = scoring.window_contingency(lines, max_words, max_gap, several=True)
    types = Counter(r.text for r in expected.collect())
    assert chunk_rows(several) == chunk_rows(expected.filter(F.col("text").isin([t for t in types if types[t] > 1])))
    often, _ = scoring.window_contingency(lines, max_words, max_gap, single_occurrences=False)
    single = expected.join(counts.filter("n = 1").select("text", "type"), ["text", "type"], "left_anti")
    assert chunk_rows(often) == chunk_rows(single)


@pytest.mark.parametrize("job", ["scores", "groups"])
def test_chunks_of_more_words_are_not_moved_once_cut(spark, make_lines, job):
    """Before, each chunk moved for either half, and for its types and its group."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = make_lines("a b c a b d e f", "b c", "a x b c a x c")
        df = mining.score_corpus(lines, 4, 4) if job == "scores" else mining.mine_groups(lines, 4, 4)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    cut = re.search(r"Generate inline\(array\((struct|if|CASE|named_struct).*__left", plan)
    assert cut and "Exchange hashpartitioning" not in plan[: cut.start()]


@pytest.mark.parametrize("max_gap", [0, 1, 4])
def test_tables_of_texts_are_summed_in_their_row(spark, make_lines, monkeypatch, max_gap):
    """Before, all texts were staged with their tables and moved to be summed."""
    monkeypatch.setattr(chunk_ops, "COMMON_SHARE", 0.1)
    rng = random.Random(11)
    words = ["the", "the", "the", "a", "b", "1", ",", "@", *"cdefgh"]
    lines = make_lines(*[" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(40)], "", " ")
    cells = ("n11", "n10", "n01", "n00")
    expected, texts = set(), {}
    for r in pair_contingency(lines, max_gap).collect():
        table = tuple(r[c] for c in cells)
        expected.add(table)
        texts.setdefault(r.text, []).append(table)
    expected |= {tuple(map(sum, zip(*tables))) for tables in texts.values()}
    staged = []
    monkeypatch.setattr(scoring, "stage", lambda df, *a, **k: staged.append(df) or stage(df, *a, **k))
    found = {tuple(r[c] for c in cells) for r in scoring.pair_tables(lines, max_gap).collect()}
    assert found == expected and (max_gap == 0 or any(len(t) > 1 for t in texts.values()))
    (pairs,) = staged
    assert {" " in (r.text or "") for r in pairs.collect()} == {False}
    assert 0 < pairs.filter("text is null").count() < pairs.count()


@pytest.mark.parametrize("copies", [None, "copies"])
def test_pairs_with_frequent_words_are_combined_before_the_shuffle(spark, monkeypatch, copies):
    """Before, each occurrence of theirs was a shuffled row, and those of two shapes or more several."""
    monkeypatch.setattr(chunk_ops, "LOOKED_AT", 1.0)
    monkeypatch.setattr(chunk_ops, "BEGINS_MANY", 0.2)
    rows = [("the a the b the a", 2), ("the a the a", 1), ("c the", 1), ("", 1), (None, 3)] * 3
    lines = spark.createDataFrame(rows, "line string, copies long").repartition(3)
    counted = chunk_ops.count_shapes(lines, chunk_shapes(2, 2), copies=copies)
    expected = Counter()
    for line, n in rows:
        for key, many in brute.counts([line or ""], 2, 2).items():
            expected[key] += many * (n if copies else 1) * (key[1] > 0)
    assert {(r.text, r.type): r.n for r in counted.collect()} == dict(+expected)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(text[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_", plan)
