import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemine.llm import suffix_dedup as suffix_dedup_module
from phrasemine.llm import suffixes
from phrasemine.llm.suffix_dedup import suffix_dedup
from phrasemine.llm.suffixes import common_prefixes, suffix_array
from tests.llm.texts import SCHEMA, awkward, repeated


def test_suffix_arrays_and_common_prefixes(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(80):
        letters = int(rng.integers(1, 5))
        t = np.append(rng.integers(1, letters + 1, int(rng.integers(1, 60))), 0)
        expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for small in (300, 0):
            monkeypatch.setattr(suffixes, "SMALL", small)
            assert suffix_array(t, letters + 1).tolist() == expected
        shared = common_prefixes(t, np.array(expected), 200)
        for a, b in zip(expected[:-1], expected[1:], strict=True):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert shared[b] == k


@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_against_all_windows(spark, monkeypatch, share):
    # All owners are hot, some, or none.
    monkeypatch.setattr(suffix_dedup_module, "HOT_SHARE", share)
    rows = awkward()
    docs = spark.createDataFrame([*rows, (None, rows[15][1], None, None, 1)], SCHEMA)
    rows = [*rows, (None, rows[15][1])]
    docs = docs.withColumns({"kept": F.lit("clash"), "n_spans": F.lit("x"), "spans": F.lit(1), "key": F.lit(2)})
    found = suffix_dedup(docs.repartition(3), length=200).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in found)
    assert mine == sorted(
        (-1 if i is None else i, n, kept, gone, runs)
        for (i, *_), (n, kept, gone, runs) in zip(rows, repeated(rows, 200), strict=True)
    )
    assert sum(r.n_spans > 1 for r in found) and sum(r.n_removed == 0 for r in found) > 10


def test_one_id_with_different_texts(spark):
    line = "a line that comes back " * 12
    rows = [(1, line + "one"), (1, "two " + line), (1, "short"), (None, line + "three"), (None, None), (1, line + "one"), (None, "x" * 150 + "four")]
    found = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    mine = sorted((r.doc_id or 0, r.text or "", r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in found)
    assert mine == sorted((i or 0, t or "", *own) for (i, t), own in zip(rows, repeated(rows, 200), strict=True))


def test_text_of_what_is_kept(spark):
    shared = "é" * 120
    rows = [(1, f"aä{shared}b"), (2, f"cä{shared}"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.kept for r in suffix_dedup(docs, as_text=True).collect()}
    assert found == {1: "ab", 2: "c", 3: "", 4: ""}
    assert suffix_dedup(docs.limit(0)).collect() == []


def test_owners_of_many_contexts_are_not_held_in_a_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    some = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    lines = [some(60), some(190), some(230)]
    ends = [some(130) for _ in range(3)]
    texts = [some(200) + lines[k % 3] + (ends[k % 4] if k % 4 < 3 else "") + some(k % 7 * 30) for k in range(90)]
    rows = [(k, t) for k, t in enumerate([*texts, texts[5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = []

    def watched(texts, length, inner=suffix_dedup_module.repeated_in_shards):
        held.extend(r[0] for r in texts.groupBy("owner").agg(F.sum(F.length("context"))).select("sum(length(context))").collect())
        return inner(texts, length)

    monkeypatch.setattr(suffix_dedup_module, "repeated_in_shards", watched)
    for most in (3000, 1 << 30):
        monkeypatch.setattr(suffix_dedup_module, "SHARD", most)
        held.clear()
        found = {r.doc_id: (r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup(docs).collect()}
        assert found == dict(zip(range(len(rows)), repeated(rows, 200), strict=True))
        assert held and max(held) <= most
        assert most == 3000 or max(held) > 3000


def test_frequent_contexts_are_one_run_a_document(spark, monkeypatch):
    """A passage that very many documents have gives each one row, not one a context, and is looked up in no join."""
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    some = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    passage = some(900)
    rows = [(k, some(100) + passage + some(100)) for k in range(60)] + [(60, some(400)), (61, passage + some(90) + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup_module, "HOT_SHARE", 0.001)
    spans = suffix_dedup_module.repeated_spans(docs)
    contexts = suffix_dedup_module.all_contexts(docs, 200).groupBy("key").count().agg(F.min("count")).first()[0]
    assert contexts <= 4 < 10 < suffix_dedup_module.all_contexts(docs, 200).groupBy("key").count().agg(F.max("count")).first()[0]
    assert spans.agg(F.max(F.size("spans"))).first()[0] <= 6
    found = {r.doc_id: (r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup(docs).collect()}
    assert found == dict(zip(range(len(rows)), repeated(rows, 200), strict=True))


def test_hashes_that_come_once_stay_in_their_task(spark):
    """Of the rows that are not frequent, only those whose hash comes again meet."""
    rows = [(1, k, k, 0, 0, 1) for k in range(2000)] + [(1, k, 5000 + k, 0, 0, 1) for k in range(7)]
    rows += [(2, 9000, 6000 + k, 0, 0, 3) for k in range(50)]
    rows = spark.createDataFrame(rows, "owner long, content long, key long, mark int, start int, windows short").repartition(3)
    counts = rows.groupBy("owner", "content").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = suffix_dedup_module.repeated_by_hash(rows, counts, 20)
        runs = sorted((r.key, r.windows) for r in found.collect())
        made, left = [], [found._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            children = node.children()
            left += [children.apply(k) for k in range(children.size())]
            if node.nodeName() == "MapInArrow":
                made.append(node.metrics().apply("pythonNumRowsReceived").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert runs == [(k, 1) for k in range(7)] + [(5000 + k, 1) for k in range(7)] + [(6000 + k, 3) for k in range(50)]
    assert max(made) < 100


def test_bins_are_told_by_flags_and_not_joined(spark, monkeypatch):
    bins = [0, 63, 64, 4095, suffix_dedup_module.BINS - 1]
    numbers = spark.range(-3 * suffix_dedup_module.BINS, 2 * suffix_dedup_module.BINS, 1)
    found = numbers.filter(suffix_dedup_module.in_bins("id", bins)).agg(F.sort_array(F.collect_list("id"))).first()[0]
    assert found == sorted(k * suffix_dedup_module.BINS + b for k in range(-3, 2) for b in bins)
    assert numbers.filter(suffix_dedup_module.in_bins("id", [])).isEmpty()
    plans = {}

    def watched(df, name, inner=suffix_dedup_module.stage):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return inner(df, name)

    monkeypatch.setattr(suffix_dedup_module, "stage", watched)
    line = "a line that comes back " * 12
    docs = spark.createDataFrame([(k, f"{line} and {k}") for k in range(20)], "doc_id long, text string")
    assert suffix_dedup(docs).filter("n_removed > 0").count() == 20
    assert "Join" not in plans["counted"]


def test_names_of_long_repeats_are_sorted_by_doubling():
    rng = np.random.default_rng(2)
    some = rng.integers(1, 900, 400)
    t = np.concatenate([some, some, some[:150], rng.integers(1, 900, 100), some, [0]])
    expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffixes.doubled(t, 900).tolist() == expected == suffix_array(t, 900).tolist()
