import numpy as np
import pyarrow as pa

from phrasemine.llm.words import shingle_sets, slice_words, slices
from tests.llm.texts import awkward, shingles, words


def test_words_and_shingles_are_told_apart_as_texts_are():
    texts = [r[1] for r in awkward()]
    hashes, sets = {}, {}
    for first, data, at in slices(pa.array(texts), most=5000):
        h, word_at = slice_words(data, at)
        for k in range(len(at) - 1):
            own = h[word_at[k] : word_at[k + 1]].tolist()
            expected = words(texts[first + k])
            assert len(own) == len(expected)
            for x, w in zip(own, expected, strict=True):
                assert hashes.setdefault(w, x) == x
        for k, s in enumerate(shingle_sets(data, at)):
            assert len(s) == len(shingles(texts[first + k])) and (np.diff(s.astype(float)) >= 0).all()
            sets.setdefault(tuple(s.tolist()), set()).add(frozenset(shingles(texts[first + k])))
    assert len(set(hashes.values())) == len(hashes)
    assert all(len(x) == 1 for x in sets.values())


def test_a_sliced_column():
    texts = pa.array(["a b", None, "c", "", "d e f"])
    counts = [np.diff(slice_words(data, at)[1]).tolist() for _, data, at in slices(texts.slice(1))]
    assert counts == [[0, 1, 0, 3]]
    assert list(slices(pa.array([], pa.string()))) == []
