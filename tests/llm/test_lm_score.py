import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from phrasemine.llm import lm_score as lm
from tests.llm.texts import SCHEMA, awkward, words


def brute(rows, held):
    tokens = [(r[0], [*words(r[1]), None]) for r in rows]
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    pairs = Counter(p for i, t in tokens if not held(i) for p in zip(["<s>", *t], t, strict=False))
    starts = sum(not held(i) for i, _ in tokens)
    return tokens, count, pairs, starts


def test_against_plain_counts(spark, monkeypatch):
    rows = [*awkward(), (None, "w1 w2 w3", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"held_out": F.lit("clash"), "part": F.lit(1)})
    held = lambda i: i is not None and i % 3 == 2
    seen = {}
    learn = lm.learn_weights

    def keep(table, n, v):
        seen["table"], seen["weights"] = table, learn(table, n, v)
        return seen["weights"]

    monkeypatch.setattr(lm, "learn_weights", keep)
    monkeypatch.setattr(lm, "BLOCK", 3000)
    found = lm.lm_scores(docs.repartition(3), F.col("doc_id") % 3 == 2).collect()
    tokens, count, pairs, starts = brute(rows, held)
    n, v, w = sum(count.values()), len(count), seen["weights"]
    assert len(found) == len(rows) and np.allclose(w.sum(1), 1)
    assert seen["table"].sum() == n
    expected = {}
    for i, t in tokens:
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        score = 0.0
        for h, x in zip(["<s>", *t], t, strict=False):
            c = starts if h == "<s>" else count[h]
            a, b, f = w[int(lm.class_of(np.array([c]))[0])]
            score += math.log10(a * pairs[h, x] / max(c, 1) + b * count[x] / n + f / (v + 1))
        expected[i] = (held(i), len(t), sum(count[x] > 0 for x in t), n, base, score)
    for r in found:
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert math.isclose(r.base_score, e[4], rel_tol=1e-9) and math.isclose(r.score, e[5], rel_tol=1e-9)
    out = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_expectation_maximisation_raises_the_likelihood():
    r = np.random.default_rng(3)
    table = np.zeros((lm.CLASSES, lm.RATIOS, lm.LEVELS))
    table[1:5, 20:70, 2:40] = r.integers(0, 9, (4, 50, 38))
    word = np.maximum(lm.level_counts() - 1, 0)[None] / 999
    pair = np.where(np.arange(lm.RATIOS) > 0, 2.0 ** ((np.arange(lm.RATIOS) - 40) / 2), 0)[:, None] * word

    def likelihood(w):
        p = np.einsum("k,kij->ij", w[2], np.stack(np.broadcast_arrays(pair, word, np.full_like(pair, 1 / 101))))
        return (table[2] * np.log(p)).sum()

    values = [likelihood(lm.learn_weights(table, 1000, 100, rounds)) for rounds in (0, 1, 3, 10, 50)]
    assert values == sorted(values) and values[-1] > values[0]


def test_without_training_or_rows(spark):
    docs = spark.createDataFrame([(2, "a b", None, None, 1), (5, None, None, None, None)], SCHEMA)
    rows = lm.lm_scores(docs, F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(2, 3, 0, 0, 0.0), (5, 1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in rows)
    assert lm.lm_scores(docs.limit(0), F.lit(False)).collect() == []
