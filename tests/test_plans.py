"""Plan properties and the whole set of queries against SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from phrasemine.operators.translation import select_candidates
from phrasemine.plans import stage as stage_module
from phrasemine.plans.table_queries import QUERIES
from phrasemine.session import INPUT_PARTITIONS
from phrasemine.sources.tables import turn_pairs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def planned(spark):
    names = ("chunk_counts", "filtered_chunks", "filtered_groups", "top_translations", "chunk_line_matches")
    return {name: plan(QUERIES[name](spark, FOLDER)) for name in names}


@pytest.mark.parametrize("name", ["filtered_chunks", "filtered_groups", "top_translations", "chunk_line_matches"])
def test_no_pairwise_joins_and_no_python(planned, name):
    text = planned[name]
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert banned not in text


def test_best_candidates_are_cut_before_the_shuffle(spark):
    """The ranking is staged before it is named, so it has a plan of its own."""
    scored = spark.createDataFrame([(1, 2, 0.5)], "chunk_id long, dst_id long, score double")
    assert plan(select_candidates(scored)).count("WindowGroupLimit") >= 2


def test_scan_reads_only_the_text(planned):
    assert "ReadSchema: struct<text:string>" in planned["chunk_counts"]


def test_counts_are_read_by_type(planned):
    assert "PartitionFilters: [isnotnull(type" in planned["filtered_chunks"]


@pytest.mark.parametrize("name", ["chunk_counts", "filtered_chunks", "top_translations"])
def test_nothing_is_moved_before_extraction(planned, name):
    assert "RoundRobinPartitioning" not in planned[name]


def test_input_parts_are_asked_for(spark):
    spark.conf.set(INPUT_PARTITIONS, "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan(QUERIES["chunk_counts"](spark, FOLDER))
    finally:
        spark.conf.unset(INPUT_PARTITIONS)


@pytest.mark.parametrize("name", ["filtered_chunks", "filtered_groups"])
def test_lines_are_counted_in_the_counting_pass(planned, name):
    """After the counts are staged, the corpus is not read again."""
    assert "documents.parquet" not in planned[name]


def test_stages_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage_module, "checkpoint_root", lambda spark: str(tmp_path))
    written = stage_module.stage(spark.range(5), "numbers")
    assert written.count() == 5 and list(tmp_path.glob("phrasemine/*/numbers"))


def test_turn_pairs_keep_all_text(spark):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    pairs = turn_pairs(spark, FOLDER).collect()
    assert len(pairs) == sum(
        r.role == "user" and (c, t + 1) in turns and turns[c, t + 1].role == "assistant"
        for (c, t), r in turns.items()
    )
    for p in pairs:
        assert p.src == turns[p.conv_id, p.turn].text.replace("\n", " ")
        assert p.dst == turns[p.conv_id, p.turn + 1].text.replace("\n", " ")


def test_every_query_runs(spark):
    assert set(entry.oracle_sql()) < set(entry.queries())
    assert entry.entry(spark).count() > 0


COMPARED = [
    "parallel_parse", "parallel_rejects", "tokenize", "chunk_counts_full", "chi_square_expr",
    "filtered_chunks", "filtered_groups", "match_gapped", "ranked_translations",
]


def test_queries_equal_their_sql(spark):
    """Some of the queries; ``check.py`` compares all of them."""
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in ("documents", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for name in COMPARED:
        sql = entry.oracle_sql()[name]
        frame = entry.queries()[name](spark, FOLDER)
        columns = sorted(frame.columns)
        mine = sorted(map(tuple, frame.select(*columns).toPandas().itertuples(index=False)))
        theirs = base.sql(sql).df()
        assert sorted(theirs.columns) == columns, name
        assert mine == sorted(map(tuple, theirs[columns].itertuples(index=False))), name
