import random
import zlib

import numpy as np
import pytest

from phrasemine.llm import spelling
from tests.llm.texts import SCHEMA

LETTERS = "etaoxyzßéÿ"


def distance_one(a, b):
    changes = {a[:k] + a[k + 1 :] for k in range(len(a))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return b in changes or a in {b[:k] + b[k + 1 :] for k in range(len(b))}


def plain(counts, ratio=5):
    near = {w: [(-n, v) for v, n in counts.items() if distance_one(w, v)] for w in counts}
    form = {w: min(x)[1] if x and -min(x)[0] >= ratio * counts[w] else None for w, x in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def vocabulary(seed, n, longest=9):
    r = random.Random(seed)
    words = {"".join(r.choices(LETTERS, k=r.randrange(1, longest))) for _ in range(n)}
    for w in r.sample(sorted(words), n // 4):
        k = r.randrange(len(w) + 1)
        words |= {w[:k] + w[k + 1 :], w[:k] + r.choice(LETTERS) + w[k:], w[:k] + r.choice(LETTERS) + w[k + 1 :]}
    words -= {""}
    words |= {"t" * 70, "t" * 71, "t" * 69 + "x", "xt" * 40, "xt" * 39 + "tt", "tx" * 40, "日本語", "日本誤", "𝒳語", "語", "\x00a", "a"}
    return {w: r.choice([1, 1, 2, 5, 10, 26, 130, 700]) for w in words}


@pytest.mark.parametrize("node", [20, 4096])
def test_against_all_pairs(spark, monkeypatch, node):
    monkeypatch.setattr(spelling, "NODE", node)
    monkeypatch.setattr(spelling, "NODES", 1 << 20)
    counts = vocabulary(5, 700)
    rows = [*counts.items(), (None, 4), ("gone", None)]
    words = spark.createDataFrame(rows, "word string, n int").selectExpr("*", "'clash' as leaf", "1 as role", "0 as near")
    found = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(words.repartition(3)).collect()}
    assert found == plain(counts)
    assert any(v[0] and v[0] != v[1] for v in found.values())


def test_words_with_one_vector_are_dealt_to_leaves(spark, monkeypatch):
    from itertools import permutations

    monkeypatch.setattr(spelling, "NODE", 10)
    monkeypatch.setattr(spelling, "NODES", 1 << 20)
    counts = {"".join(p): k % 7 + 1 for k, p in enumerate(permutations("etaox"))} | {"etao": 50, "etaoxx": 3, "etaob": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    nodes = spelling.top_of_trie(words.mapInArrow(spelling.with_vectors, "word string, n long, vector string"))
    assert max(n for _, n in nodes) == 120 and spelling.routes(nodes)[1] > len(nodes)
    assert {r.word: tuple(r)[1:] for r in spelling.spelling_variants(words).collect()} == plain(counts)


def test_search_spends_one_surplus_and_one_deficit():
    r = np.random.default_rng(2)
    rows = r.integers(0, 3, (400, spelling.GROUPS)).astype(np.int8)
    rows[:, 6:] = 0
    rows = rows[np.lexsort(rows.T[::-1])]
    queries = rows[r.integers(0, 400, 50)] + (np.arange(spelling.GROUPS) == 7)
    got = []
    spelling.search(rows, np.full(400, spelling.GROUPS), queries, lambda a, b: got.extend(zip(a.tolist(), b.tolist(), strict=True)))
    apart = rows[:, None].astype(int) - queries[None]
    good = (np.maximum(apart, 0).sum(2) <= 1) & (np.maximum(-apart, 0).sum(2) <= 1)
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(good)), strict=True))


def test_letter_pairs():
    words = sorted(vocabulary(1, 120))
    held = spelling.Words(words)
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    expected = [distance_one(words[i], words[j]) for i, j in zip(a, b, strict=True)]
    assert held.near(held, a, b).tolist() == expected
    assert [spelling.one_apart(words[i], words[j]) for i, j in zip(a, b, strict=True)] == expected


def test_runs_lose_letters_by_hash(spark, tmp_path):
    r = random.Random(4)
    base = ["".join(r.choices("abcdeé", k=r.randrange(6, 9))) for _ in range(40)]
    texts = [" ".join(r.choices(base, k=60)) for _ in range(80)]
    texts += [None, "", "ABCDEF " * 6, "ÀBCDEF-àbcdef×÷ƒabcdef'abcdef " * 5, "a" * 3000 + " " + "a" * 3001, "short wörds"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, texts[0], None, None, None)] + [(0, texts[0], None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    counts, changed = {}, 0
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\xc0" <= c <= "\xff":
                run += c.lower() if c < "\x80" else c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 199 == 0:
                run, changed = run[: h % len(run)] + run[h % len(run) + 1 :], changed + 1
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
            run = ""
    assert changed > 5
    found = {x.word: tuple(x)[1:] for x in spelling.op13_spelling(spark, str(tmp_path)).collect()}
    assert found == plain({w: n for w, n in counts.items() if n >= 5})


def test_empty(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(none).collect() == []
    one = spark.createDataFrame([("", 9), ("a", 1)], "word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(one).collect())) == [("", None, "", 9, 1, None), ("a", "", "", 1, 1, 9)]
