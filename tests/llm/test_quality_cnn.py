import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemine.llm import quality_cnn as q
from tests.llm.texts import SCHEMA, awkward, prose


def test_gradients_are_those_of_the_loss(monkeypatch):
    r = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in q.new_model(1).items()}
    rows = r.integers(0, 256, (3, 4 * q.HALF)).astype(np.uint8)
    half_at, y = np.arange(4) * 4, np.array([0.0, 1.0, 1.0])

    def loss():
        halves = q.pool(q.respond(model, rows.ravel(), half_at[1:] * (q.HALF // q.STEP)))
        p = q.combine(model, halves, half_at)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = q.gradients(model, rows.ravel(), half_at, y)
    for name in model:
        flat = model[name].reshape(-1)
        for k in r.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g[name].reshape(-1)[k]) < 1e-4, (name, k)


def test_slices_do_not_change_a_score(monkeypatch):
    model = q.new_model(2)
    texts = pa.array([r[1] for r in awkward()])
    whole = q.score_texts(model, texts)
    monkeypatch.setattr(q, "WIDE", q.HALF * 3)
    assert np.allclose(q.score_texts(model, texts), whole, atol=1e-6)
    one_by_one = [q.score_texts(model, texts.slice(k, 1))[0] for k in range(len(texts))]
    assert np.allclose(one_by_one, whole, atol=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        w = prose(rng, rng.randrange(5, 300))
        bad = k % 4 == 0
        rows.append((k, " ".join(f"{x}***" if bad else x for x in w), "en", "s0", 1))
        labels.append((k, int(not bad), None))
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("clash"), "quality": F.lit(9), "__id": F.lit(1)})
    return docs, spark.createDataFrame([*labels, (0, None, None), (None, 1, None)], "doc_id long, quality int, toxic int")


def test_learns_and_scores_every_row(labelled):
    docs, labels = labelled
    rows = q.score_quality(docs, labels.filter(~q.held_out_column()), q.Training(steps=120)).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert rows[0].quality == 9
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in rows if r.doc_id < 400]
    assert sum(right) / len(right) > 0.97
    by_id = {}
    for r in rows:
        assert abs(by_id.setdefault(r.doc_id, r.score) - r.score) < 1e-6
    assert abs(by_id[1000] - by_id[1001]) < 1e-6


def test_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert q.score_quality(docs, labels.limit(0)).count() == 403
    assert q.score_quality(docs.limit(0), labels, q.Training(steps=2)).collect() == []


def test_examples_are_whole_texts_within_the_bounds(spark):
    text = "a" * 30000 + "b" * 30000
    rows = [(1, text), (2, "short"), (3, None), (4, "x" * 200), (None, "no id"), (1, text), (2, "shorter"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(1, 0), (2, 1), (2, 0), (3, 1), (4, 1), (4, None), (5, 1), (None, 1), (9, 1)], "doc_id long, quality int"
    )
    examples, y = q.training_rows(docs, labels, q.Training())
    expected = {text.encode(): 0, b"short": 0, b"x" * 200: 1, b"": 1}
    assert dict(zip(examples, y.tolist(), strict=True)) == expected and len(examples) == 4
    examples, _ = q.training_rows(docs, labels, q.Training(bytes=60000 - 1))
    assert sorted(map(len, examples)) == [0, 5, 200]
    assert len(q.training_rows(docs, labels, q.Training(documents=2))[0]) <= 2


def test_gradients_of_slices_are_those_of_the_whole(monkeypatch):
    r = np.random.default_rng(3)
    model = q.new_model(1)
    data = r.integers(0, 256, 40 * q.HALF).astype(np.uint8)
    padded, half_at = q.layout(np.array([0, 30, 30, 25 * q.HALF + 7, len(data)]), data)
    y = np.array([0, 1, 0, 1], np.float32)
    whole = q.gradients(model, padded, half_at, y)
    monkeypatch.setattr(q, "WIDE", q.HALF * 3)
    for name, value in q.gradients(model, padded, half_at, y).items():
        assert np.allclose(value, whole[name], atol=1e-6), name
