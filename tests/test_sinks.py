import duckdb
from pyspark.sql import functions as F

import oracle
from phrasemine.plans.mining import mine_chunks, mine_groups, mine_translations
from phrasemine.sinks.text import (
    parse_chunks,
    parse_groups,
    parse_translations,
    render_chunks,
    render_groups,
    printed,
    render_translations,
    write_lines,
)
from phrasemine.sources.lines import read_lines
from tests.test_scoring import M1, M2
from tests.test_translation import PAIRS

FOUR_NINTHS, MINUS_TWO_THIRDS = "0.4444444444444444", "-0.6666666666666666"


def test_chunks(spark, make_lines, tmp_path):
    rendered = render_chunks(mine_chunks(make_lines(*M1)))
    lines = {r.line for r in rendered.collect()}
    assert f"[a b@200@{FOUR_NINTHS}]" in lines and len(lines) == 7
    write_lines(rendered, str(tmp_path / "out"))
    parsed = parse_chunks(read_lines(spark, str(tmp_path / "out")))
    kept = {(r.text, r.type, r.chi2) for r in mine_chunks(make_lines(*M1)).collect()}
    assert {tuple(r) for r in parsed.collect()} == kept


def test_words_with_an_at_sign_come_back(make_lines):
    lines = make_lines("me@x.org @ b@200@3", "b c d", "", "", "me@x.org d")
    kept = mine_chunks(lines, threshold=100.0)
    expected = {(r.text, r.type, r.chi2) for r in kept.collect()}
    assert {tuple(r) for r in parse_chunks(render_chunks(kept)).collect()} == expected


def test_words_with_other_line_breaks_come_back(spark, make_lines):
    lines = make_lines("a\r b\u2028c d", "b\u0085 c", "", "a\r d")
    kept = mine_chunks(lines, threshold=100.0)
    expected = {(r.text, r.type, r.chi2) for r in kept.collect()}
    rendered = render_chunks(kept)
    assert {tuple(r) for r in parse_chunks(rendered).collect()} == expected
    noise = spark.createDataFrame([("no record",), ("",), (None,)], "line string")
    assert parse_chunks(rendered.unionAll(noise)).count() == len(expected)


def test_groups_come_back(make_lines):
    lines = make_lines("a@1 b a@1 x b", "a@1 b", "\\E q b", "a@1 z b", *["", ""] * 9)
    groups = mine_groups(lines, threshold=1e9)
    expected = {
        (r.text, r.level, str(r.type) if r.level == 1 else "#" + "#".join(map(str, r.types)), r.chi2)
        for r in groups.collect()
    }
    assert expected and {tuple(r) for r in parse_groups(render_groups(groups)).collect()} == expected


def test_translations_come_back(make_lines, make_pairs):
    best = mine_translations(mine_chunks(make_lines(*M1)), make_pairs(*PAIRS))
    columns = ["text", "type", "chunk_chi2", "rank", "dst_text", "dst_type", "score"]
    expected = {tuple(r) for r in best.select(*columns).collect()}
    assert {tuple(r) for r in parse_translations(render_translations(best)).select(*columns).collect()} == expected


def test_groups(make_lines):
    (row,) = render_groups(mine_groups(make_lines(*M2))).collect()
    single, pooled = MINUS_TWO_THIRDS, "-1.3333333333333333"
    assert row.line == f"[a b@{single}@1@200, a b@{single}@1@210, a b@{pooled}@2@#200#210]"


def test_translations(make_lines, make_pairs):
    best = mine_translations(mine_chunks(make_lines(*M1)), make_pairs(*PAIRS))
    (row,) = render_translations(best).collect()
    third = "1.3333333333333333"
    assert row.line == (
        f"(a b@200@{FOUR_NINTHS},(q r@200,{third}),(p r@210,{third}),(p q@200,{third}),"
        f"(zz yy@200,{FOUR_NINTHS}),(x q@200,{FOUR_NINTHS}))"
    )


def test_scores_with_a_fixed_number_of_digits(spark):
    values = [0.0, 0.5, 1.25, -1.25, 6.6299995, 0.9999999, -0.0000004, 123456789.123, 2.0**53, float("nan"), float("-inf"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    found = [r.p for r in rows.select("k", printed(F.col("x"), 6).alias("p")).orderBy("k").collect()]
    assert found == [
        "0.000000", "0.500000", "1.250000", "-1.250000", "6.630000", "1.000000", "-0.000000", "123456789.123000",
        "9.007199254740992E15", "NaN", "-Infinity", None,
    ]
    base = duckdb.connect()
    for v in values[:8]:
        assert base.execute(f"SELECT {oracle.fixed('x')} FROM (SELECT CAST(? AS DOUBLE) AS x)", [v]).fetchone()[0] in found


def test_forms_with_digits_are_read_back(spark):
    scored = spark.createDataFrame([("a@ b", 200, 1.23456789)], "text string, type int, chi2 double")
    (line,) = [r.line for r in render_chunks(scored, 3).collect()]
    assert line == "[a@ b@200@1.235]"
    assert tuple(parse_chunks(render_chunks(scored, 3)).first()) == ("a@ b", 200, 1.235)
