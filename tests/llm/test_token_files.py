import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemine.llm import huffman, token_files
from tests.llm.texts import SCHEMA, awkward

PATH = public_tokenizers.path(token_files.VOCABULARY)


def plain(text):
    found = token_files.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, token_files.END], "<u4")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(2, 20))
def test_symbols_come_back(symbols, limit):
    symbols = np.array(symbols, np.int64)
    lengths = huffman.code_lengths(np.bincount(symbols, minlength=301), limit)
    assert lengths.max() <= max(limit, 9)
    bits, checkpoints = huffman.encode(symbols, lengths, huffman.code_words(lengths), 64)
    table, width = huffman.look_up(lengths)
    assert (huffman.decode(bits, len(symbols), checkpoints, table, width, 64) == symbols).all()
    if len(symbols) > 130:  # any checkpoint is a place to start
        rest = huffman.decode(bits, len(symbols) - 128, checkpoints[2:], table, width, 64)
        assert (rest == symbols[128:]).all()


def test_lengths_are_the_best_within_the_limit():
    def best(counts, limit):
        """Least sum of count x length over all lengths that a prefix code can have."""
        from functools import cache

        counts = sorted(counts, reverse=True)

        @cache
        def go(k, least, room):  # room in units of 2**-limit
            if k == len(counts):
                return 0
            options = [
                counts[k] * n + go(k + 1, n, room - 2 ** (limit - n))
                for n in range(least, limit + 1)
                if 2 ** (limit - n) <= room
            ]
            return min(options, default=float("inf"))

        return go(0, 1, 2**limit)

    r = random.Random(5)
    for _ in range(60):
        counts = [r.choice([1, 1, 2, 50, 1000]) * r.randrange(1, 9) for _ in range(r.randrange(2, 9))]
        for limit in (3, 4, 6):
            lengths = huffman.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit
            assert sum(c * int(n) for c, n in zip(counts, lengths, strict=True)) == best(counts, limit)


def test_code_words_are_canonical():
    lengths = np.array([3, 1, 0, 3, 2], np.uint8)
    assert huffman.code_words(lengths).tolist() == [0b110, 0, 0, 0b111, 0b10]
    with pytest.raises(ValueError, match="no code word"):
        huffman.encode(np.array([2]), lengths, huffman.code_words(lengths))


def test_pieces_are_the_whole(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 40)
    r = random.Random(2)
    odd = "aAbßÀéİΣςẞ'̸́̊̇​ \x0b\x0c\r\t\n  \x1c\x85\x01.,!|<>0१७字ｦ😀-_ﬁKͅ"
    texts = ["".join(r.choices(odd, k=r.randrange(60))) for _ in range(600)]
    texts += ["it's o'clock 's ' s", "<|endoftext|> a", "a <|ENDOFTEXT|>b", "≮| W̊", "", " ", "x" * 5000]
    pieces, whole = token_files.Pieces(PATH), token_files.Whole(PATH)
    for k in range(0, len(texts), 50):
        for t, a, b in zip(texts[k:], pieces(texts[k : k + 50]), whole(texts[k : k + 50]), strict=False):
            assert a.tolist() == b.tolist(), repr(t)


def test_files_against_plain_encoding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 700)
    rows = [*awkward(), (None, "no id <|endoftext|>", None, None, 1), (None, None, None, None, None), (4, "other text", None, None, 1)]
    rows = [(-3 if r[0] == 9 else r[0], *r[1:]) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.selectExpr("*", "'clash' as ids", "1 as row", "'x' as tie", "0 as part")
    folder = str(tmp_path / "ids")
    token_files.write_ids(docs.repartition(3), folder, PATH)
    found = token_files.read_ids(spark, folder).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(plain(r[1]).tobytes())
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    place = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == place
        place += len(r.ids) // 4
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 20 and blocks.agg({"n_tokens": "sum"}).first()[0] == place
    raw = np.concatenate([np.frombuffer(b, "<u4") for v in texts.values() for b in v])
    bits = huffman.code_lengths(np.bincount(raw))
    assert {r.id: r.bits for r in spark.read.parquet(f"{folder}/code").collect()} == {
        int(i): int(bits[i]) for i in np.flatnonzero(bits)
    }


def test_any_tokenizer_and_no_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "Two  words\n"), (0, None), (2, "")], "doc_id long, text string")
    token_files.write_ids(docs, str(tmp_path / "bytes"), path, end=None, encoder=token_files.Whole)
    found = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_ids(spark, str(tmp_path / "bytes")).collect()}
    two = token_files.tokenizer(path).encode("Two  words\n", add_special_tokens=False).ids
    assert found == {0: (0, []), 1: (0, two), 2: (len(two), [])}
    token_files.write_ids(docs.limit(0), str(tmp_path / "none"), PATH)
    assert token_files.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_query(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = token_files.op11_token_files(spark, str(tmp_path)).collect()
    expected = sorted((r[0], len(plain(r[1])), zlib.crc32(plain(r[1]).tobytes())) for r in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    assert [r.start for r in sorted(found, key=lambda r: r.start)] == np.cumsum([0] + [r.n_tokens for r in sorted(found, key=lambda r: r.start)])[:-1].tolist()
