import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from phrasemine.sources.lines import corpus_size, lines_of, read_lines
from phrasemine.sources.parallel import parse_observed, parse_parallel, read_parallel, rejected_lines

RAW = ["dst words|src words", "no pipe here", "", "dst|", "|src", "d|s|extra", "d||x", "||", "a||"]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(value,) for value in RAW], "value string")


def test_parse_and_reject(raw):
    parsed = {r.value: (r.dst, r.src) for r in parse_parallel(raw).collect()}
    assert parsed == {
        "dst words|src words": ("dst words", "src words"),
        "|src": ("", "src"),
        "d|s|extra": ("d", "s"),
        "d||x": ("d", ""),
    }
    assert {r.value for r in rejected_lines(raw).collect()} == {"no pipe here", "", "dst|", "||", "a||"}


def test_failfast(raw):
    with pytest.raises(PySparkException, match="no second field"):
        parse_parallel(raw, mode="FAILFAST").collect()
    with pytest.raises(PySparkException, match="no second field"):
        parse_parallel(raw, mode="FAILFAST").count()
    good = raw.filter("value like '%s%|%s%'")
    assert parse_parallel(good, mode="FAILFAST").count() == good.count() > 0


def test_other_delimiter_and_bad_arguments(spark, raw):
    tabbed = spark.createDataFrame([("d\ts",)], "value string")
    row = parse_parallel(tabbed, "\t").first()
    assert (row.dst, row.src) == ("d", "s")
    with pytest.raises(ValueError):
        parse_parallel(raw, "||")
    with pytest.raises(ValueError):
        parse_parallel(raw, mode="LENIENT")


def test_files(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a b\n\né c\n", encoding="utf-8")
    lines = read_lines(spark, str(tmp_path / "lines.txt"))
    assert [r.line for r in lines.collect()] == ["a b", "", "é c"]
    assert corpus_size(lines).first().lines == 3
    (tmp_path / "pairs.txt").write_text("x y|a b\nbroken\n", encoding="utf-8")
    pairs = read_parallel(spark, str(tmp_path / "pairs.txt")).collect()
    assert [(r.dst, r.src) for r in pairs] == [("x y", "a b")]


def test_lines_of_a_column(spark):
    texts = spark.createDataFrame([("a\n\nb\n",), ("",)], "text string")
    assert sorted(r.line for r in lines_of(texts).collect()) == ["", "", "", "a", "b"]


def test_one_scan_gives_the_accepted_lines_and_the_counts(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a|b\nno field\n|c\nd|\n\ne|f|g\n")
    seen = Observation()
    accepted = parse_observed(spark.read.text(str(tmp_path)), seen)
    assert accepted._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    rows = [(r.dst, r.src) for r in accepted.collect()]
    assert rows == [("a", "b"), ("", "c"), ("e", "f")]
    assert seen.get == {"lines": 6, "accepted": 3, "rejected": 3}


def test_nulls_are_rejected_and_counted(spark):
    seen = Observation()
    raw = spark.createDataFrame([(None,), ("a|b",)], "value string")
    assert parse_observed(raw, seen).count() == 1
    assert seen.get == {"lines": 2, "accepted": 1, "rejected": 1}
