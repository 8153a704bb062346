import os
import random

import corpus_pipeline as pipeline
import pytest

from phrasemine.llm.queries import QUERIES, SQL
from tests.llm.texts import SCHEMA, near_groups, prose, repeated, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(300):
        w = prose(rng, rng.randrange(40, 160), 10**5)
        bad = k % 5 == 0
        rows.append((k, " ".join(f"{x}&&&" if bad else x for x in w), "en", f"s{k % 3}", 1))
        labels.append((k, int(not bad), 0))
    item = prose(rng, 30, 10**6)
    passage = " ".join(prose(rng, 70, 10**6))
    rows[1] = (1, rows[1][1] + " " + " ".join(item), "en", "s1", 1)
    for k in (3, 4, 6):
        rows[k] = (k, f"{rows[k][1]} {passage}", "en", "s0", 1)
    rows += [(400, rows[2][1], "en", "s2", 1), (401, rows[7][1] + " more", "en", "s2", 1), rows[8]]
    rows += [(500, None, None, None, None), (501, "", None, None, 0), (None, rows[9][1] + " " + passage, None, None, 3)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_on_its_own_input(spark, folder):
    docs = pipeline.table(spark, folder, "documents")
    seen = {}
    for name, step in pipeline.STAGES:
        out = step(spark, docs, folder)
        seen[name] = ([tuple(r) for r in docs.select(*pipeline.COLUMNS).collect()], out.collect())
        if name != "mix":
            assert out.columns == list(pipeline.COLUMNS)
            docs = pipeline.stage(out, name)
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert sum(i in kept for i in range(300) if i % 5) >= 235 and sum(i in kept for i in range(0, 300, 5)) <= 3

    before, after = seen["near_duplicates"]
    _, groups = near_groups([r for r in before if r[0] is not None])
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({i for i in groups if groups[i] == i})

    before, after = seen["repeated_passages"]
    expected = {i: kept.decode(errors="ignore") for (i, *_), (_, kept, *_) in zip(before, repeated(before, 200), strict=True)}
    assert {r.doc_id: r.text or "" for r in after} == expected and any(n > 0 for _, _, n, _ in repeated(before, 200))
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in (3, 4, 6))

    before, after = seen["benchmark_free"]
    assert {r[0] for r in before} - {r.doc_id for r in after} == {1}

    before, after = seen["mix"]
    size = {r[0]: len(words(r[1])) for r in before}
    assert {r.doc_id: r["size"] for r in after} == size
    run = pipeline.run(spark, folder).collect()
    assert sorted(map(str, run)) == sorted(map(str, after))


@pytest.mark.parametrize("ids", [(1, 2), (7, 7), (None, 8), (None, None)])
def test_repeated_and_missing_ids(spark, tmp_path, ids):
    rng = random.Random(5)
    item = prose(rng, 30, 10**6)
    texts = [" ".join(prose(rng, 60, 10**6)) for _ in range(3)]
    dirty = f"{texts[0]} {' '.join(item)}"
    a, b = ids
    rows = [(a, texts[1]), (a, texts[1]), (b, texts[2]), (a, dirty), (9, texts[1] + " more"), (b, None), (b, ""), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    keys = pipeline.keyed(docs).select("doc_id", "text", "__key").collect()
    assert len(keys) == len(rows)
    assert len({r["__key"] for r in keys}) == len({(r.doc_id, r.text) for r in keys})
    assert all(r["__key"] in {q["__key"] for q in keys if q.doc_id == r.doc_id} for r in keys if r.doc_id == 9)
    kept = pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = sorted(r.text or "" for r in kept.collect())
    assert [t for t in left if t.strip()] in [sorted([x, texts[2], dirty]) for x in (texts[1], texts[1] + " more")]
    assert left.count(" ") == 2 and left.count("") == 2
    free = pipeline.benchmark_free(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in free) == sorted((i or 0, t or "") for i, t in rows if t != dirty)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    theirs = base.sql(SQL[name]).df()
    assert sorted(theirs.columns) == columns
    key = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)))
    assert key(frame.toPandas()) == key(theirs)
