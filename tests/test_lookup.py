import random

from pyspark.sql import functions as F

from phrasemine.operators import lookup
from phrasemine.operators.chunks import line_total, stage_counts
from phrasemine.operators.lookup import attach, frequent
from phrasemine.operators.scoring import contingency


def frames(spark):
    """A third of the facts have one key, some have none in the table."""
    rng = random.Random(5)
    facts = [(k, "hot" if k % 3 == 0 else f"k{rng.randrange(400)}") for k in range(3000)]
    counts = {}
    for _, key in facts:
        counts[key] = counts.get(key, 0) + 1
    table = [(key, n, f"value of {key}") for key, n in counts.items() if not key.endswith("7")]
    return (
        spark.createDataFrame(facts, "id int, key string"),
        spark.createDataFrame(table, "name string, n long, value string"),
        facts,
        {key: value for key, _, value in table},
    )


def test_attach_keeps_every_fact(spark, monkeypatch):
    facts, table, rows, values = frames(spark)
    for share in (1e-4, 0.01, 0.9):
        monkeypatch.setattr(lookup, "FREQUENT_SHARE", share)
        found = attach(facts, table, {"key": "name"}, {"value": "v"}, weight="n")
        assert {(r.id, r.key, r.v) for r in found.collect()} == {
            (k, key, values.get(key)) for k, key in rows
        }
        inner = attach(facts, table, {"key": "name"}, {"value": "v"}, weight="n", inner=True)
        assert sorted((r.id, r.v) for r in inner.collect()) == sorted(
            (k, values[key]) for k, key in rows if key in values
        )


def test_several_rows_per_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_SHARE", 0.2)
    facts = spark.createDataFrame([(k, "hot" if k < 50 else f"k{k}") for k in range(80)], "id int, key string")
    table = spark.createDataFrame(
        [("hot", 50, "x"), ("hot", 50, "y"), ("k60", 1, "z")], "key2 string, n long, v string"
    )
    found = attach(facts, table, {"key": "key2"}, {"v": "v"}, weight="n", inner=True)
    assert found.count() == 101


def test_few_keys_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_SHARE", 0.05)
    _, table, _, _ = frames(spark)
    hot = frequent(table, "n").collect()
    assert [r.name for r in hot] == ["hot"] and len(hot) <= 1 / 0.05


def test_frequent_keys_spread_over_tasks(spark):
    facts, table, _, _ = frames(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach(facts, table, {"key": "name"}, {"value": "v"}, weight="n")
        sizes = (
            found.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 500


def test_frequent_keys_that_are_absent_go_before_the_shuffle(spark):
    rows = [(k, "hot" if k % 3 else f"k{k}") for k in range(900)]
    facts = spark.createDataFrame(rows, "id int, key string")
    table = spark.createDataFrame([(f"k{k}", 1, "v") for k in range(0, 900, 9)], "name string, n long, value string")
    universe = facts.groupBy(F.col("key").alias("name")).agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach(facts, table, {"key": "name"}, {"value": "v"}, weight="n", inner=True, universe=universe)
        text = found._jdf.queryExecution().toString()
        assert found.count() == 100
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and text.index("LeftAnti") > 0


def test_halves_are_read_where_they_lie(spark):
    """Neither lookup moves the staged table: each exchange by text is of the chunks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.createDataFrame([("a b c a b d",), ("b c",)], "line string")
        counts = stage_counts(lines)
        plan = contingency(counts, line_total(counts))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    joins = []

    def walk(node):
        if node.nodeName() == "SortMergeJoin":
            joins.append([side(node.children().apply(k)) for k in range(2)])
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    def side(node):
        """Whether rows come from an exchange or straight from a scan."""
        while node.children().size() == 1 and "Exchange" not in node.nodeName():
            node = node.children().apply(0)
        return node.nodeName().split(" ")[0]

    walk(plan)
    assert len(joins) == 2
    assert all("Exchange" in facts and table.startswith("Scan") for facts, table in joins)
