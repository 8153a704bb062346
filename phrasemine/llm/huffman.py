"""Canonical Huffman codes of bounded length, for arrays of small integers.

A code is given by its lengths alone: symbols in order of (length, symbol) get
ascending code words, written from the highest bit on. Encoding and decoding are numpy passes; a decoder
starts at any checkpoint, and all stretches between checkpoints are decoded side by side.
"""

from __future__ import annotations

import numpy as np

from phrasemine.llm.shipping import ship

LIMIT = 16  # bits of a code word at most; more only if there are more symbols than that can tell apart
MOST = 24  # bits that one look at four bytes can give, wherever it starts
STEP = 512  # symbols from one checkpoint to the next


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each symbol, 0 for those that do not occur; the best of all prefix codes within ``limit``.

    Package-merge: a list of all symbols by weight is merged ``limit`` times with the
    pairs of the list before; how often a symbol is among the lightest 2n - 2
    items, through all lists, is its length. Equal weights go by symbol.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    if limit > MOST:
        raise ValueError(f"{n} symbols need code words of more than {MOST} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights, pairs, singles = counts[order], np.zeros(0, np.int64), []
    for _ in range(limit):
        items = np.concatenate([weights, pairs])
        place = np.argsort(items, kind="stable")
        singles.append(place < n)
        pairs = items[place][: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for single in reversed(singles):
        alone = int(single[:take].sum())
        lengths[order[:alone]] += 1
        take = 2 * (take - alone)
    return lengths


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The code word of each symbol, in its lowest bits."""
    words = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used):
        order = used[np.argsort(lengths[used], kind="stable")]
        spare = int(lengths.max()) - lengths[order].astype(np.int64)
        ends = np.cumsum(np.int64(1) << spare)
        words[order] = ((ends - (np.int64(1) << spare)) >> spare).astype(np.uint64)
    return words


def look_up(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each run of ``bits`` bits the symbol it begins with, shifted by 8, and that symbol's length; and ``bits``."""
    bits = int(lengths.max(initial=1))
    table = np.zeros(1 << bits, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    runs = np.int64(1) << (bits - lengths[order].astype(np.int64))
    entries = (order.astype(np.int64) << 8) | lengths[order]
    filled = np.repeat(entries, runs)
    table[: len(filled)] = filled
    return table, bits


def encode(symbols: np.ndarray, lengths: np.ndarray, words: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bits of ``symbols``, and the bit that each ``step``-th of them starts at."""
    size = lengths[symbols].astype(np.int64)
    if len(size) and not size.all():
        raise ValueError("a symbol has no code word")
    at = np.cumsum(size) - size
    total = int(size.sum())
    cell = at >> 5
    value = words[symbols] << (64 - (at & 31) - size).astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(first):
        out[cell[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
        out[cell[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::step]


def decode(data: bytes, n: int, checkpoints: np.ndarray, table: np.ndarray, bits: int, step: int = STEP) -> np.ndarray:
    """The ``n`` symbols that start at the first checkpoint."""
    byte = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    windows = ((byte[:-3] << 24) | (byte[1:-2] << 16) | (byte[2:-1] << 8) | byte[3:]).astype(np.int64)
    at = np.asarray(checkpoints, np.int64)[: -(-n // step)].copy()
    out = np.zeros((min(n, step), len(at)), np.int64)
    rest, mask = n - (len(at) - 1) * step, (1 << bits) - 1
    for k in range(len(out)):
        if k == rest:  # the last stretch is a shorter one
            at = at[:-1]
        entry = table[(windows[at >> 3] >> (32 - bits - (at & 7))) & mask]
        out[k, : len(at)] = entry >> 8
        at += entry & 255
    return out.T.reshape(-1)[:n] if n else np.zeros(0, np.int64)


ship(__name__)
