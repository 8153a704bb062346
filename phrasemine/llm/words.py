"""Words of whole texts as 64-bit hashes, for functions that get Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased. All
steps are numpy passes over slices of a batch, so memory is bounded by a slice
or by the longest document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from phrasemine.llm.shipping import ship

SLICE = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row starts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of the rows in them) for runs of whole rows of about ``most`` bytes."""
    data, at = utf8(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of a hash depends on all of its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    pair = []
    for x in (base, pow(base, -1, 1 << 64)):
        all_x = np.full(n, x, np.uint64)
        all_x[:1] = 1
        pair.append(np.multiply.accumulate(all_x))
    return pair[0], pair[1]


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte; a capital letter has its small letter's."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    return values


def is_space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return space


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; rows that meet without a space do not join."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    letter = ~is_space()[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    starts = np.flatnonzero(letter & (before | edge[:-1]))
    ends = np.flatnonzero(letter & (after | edge[1:])) + 1
    return starts, ends


def slice_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and which words each row has (like ``at``)."""
    n = len(data)
    starts, ends = spans(data, at)
    up, down = powers(max(1, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its set of ``size``-word shingles as sorted hashes.

    With fewer words the whole sequence is the one shingle; without words the
    set is empty.
    """
    h, word_at = slice_words(data, at)
    n = max(0, len(h) - size + 1)
    all_s = np.zeros(n, np.uint64)
    for k in range(size):
        all_s = all_s * np.uint64(0x9FB21C651E98DF25) + h[k : n + k]
    all_s = mix(all_s)
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(all_s[a : b - size + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    short = short * np.uint64(0x9FB21C651E98DF25) + x
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


ship(__name__)
