import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasemine.llm.token_counts import Rollup, counted, deleted, inserted, op5_token_counts, revised
from tests.llm.texts import SCHEMA, awkward, words

COUNTS = "doc_id long, source string, lang string, version string, tokens long"


def totals(store):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()}


def test_changes_in_any_order_equal_a_recount(spark, tmp_path):
    rng = random.Random(6)
    state, batches = {}, []
    for b in range(4):
        changes = []
        for k in range(40):
            key = (k, rng.choice(["s0", "s0", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]))
            if rng.random() < 0.4:
                if key in state:
                    changes.append(("-", (*key, state.pop(key))))
                else:
                    state[key] = rng.choice([0, 5, None, 9])
                    changes.append(("+", (*key, state[key])))
            elif key in state:
                changes.append(("-", (*key, state[key])))
                state[key] = rng.randrange(20)
                changes.append(("+", (*key, state[key])))
        batches.append(changes)
    store = Rollup(spark, str(tmp_path / "store"))
    assert totals(store) == {}
    for b in (2, 0, 2, 3, 1, 0):
        plus, minus = ([r for s, r in batches[b] if s == sign] for sign in "+-")
        frame = revised(spark.createDataFrame(minus, COUNTS), spark.createDataFrame(plus, COUNTS))
        store.commit(f"b{b}", frame.withColumn("batch", F.lit("clash")).drop("batch"))
    documents, tokens = Counter(), Counter()
    for (_, *key), t in state.items():
        documents[tuple(key)] += 1
        tokens[tuple(key)] += t or 0
    assert totals(store) == {k: (n, tokens[k]) for k, n in documents.items()}


def test_a_broken_attempt_is_not_seen(spark, tmp_path):
    store = Rollup(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "s", "en", "v", 4)], COUNTS)
    broken = inserted(one).withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit("a", broken)
    assert totals(store) == {} and not store.committed("a")
    assert store.commit("a", inserted(one)) and not store.commit("a", inserted(one))
    assert totals(store) == {("s", "en", "v"): (1, 4)}
    assert store.commit("b", deleted(one)) and totals(store) == {}
    assert store.commit("c", inserted(one.limit(0)))
    with pytest.raises(ValueError):
        store.commit("x/y", inserted(one))


def test_counts_of_awkward_texts(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"version": F.lit("clash"), "tokens": F.lit("x")})
    got = counted(docs, {"w": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), "none": F.lit(None)}).collect()
    assert len(got) == 2 * len(rows)
    expected = Counter((r[0], r[3], r[2], "w", len(words(r[1]))) for r in rows)
    assert Counter(tuple(r) for r in got if r.version == "w") == expected
    assert {r.tokens for r in got if r.version == "none"} == {0}


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    rows = [(1, "a - b", "s", "en")] * 3 + [(None, "c ! d", "s", "en")] * 2 + [(2, "e", "s", "en")] * 2 + [(3, None, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(2, 0), (2, 0), (None, 0), (1, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.version: (r.documents, r.tokens) for r in op5_token_counts(spark, str(tmp_path)).collect()}
    assert found == {"words": (6, 10), "runs": (6, 10)}
