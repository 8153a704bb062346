"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard."""

from __future__ import annotations

import numpy as np

from phrasemine.llm.shipping import ship

SMALL = 300  # alphabets up to this size are induced, bucket by bucket; texts over larger ones, of names, are told apart by doubling


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (type S); the last one is."""
    s = np.ones(len(t), bool)
    differ = np.flatnonzero(t[:-1] != t[1:])
    if len(differ):
        less = t[differ] < t[differ + 1]
        s[: differ[-1] + 1] = np.repeat(less, np.diff(differ, prepend=-1))
    return s


def induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones ``seeds`` in order.

    Each bucket is passed on as a whole, in as many steps as its letter repeats.
    """
    n = len(t)
    t = t.astype(np.uint16)  # numpy sorts these by digits
    size = np.bincount(t, minlength=letters)
    start = np.cumsum(size) - size
    end = start + size
    by_letter = np.split(seeds, np.searchsorted(t[seeds], np.arange(1, letters)))
    sa = np.full(n, -1, np.int64)
    fill = start.copy()

    def spread(block: np.ndarray, large: bool, c: int) -> None:
        """Puts the predecessors of ``block`` that have the wanted type into their buckets, in order."""
        p = block[block > 0] - 1
        p = p[s[p] != large]
        if not len(p):
            return
        first = t[p]
        p = p[np.argsort(first, kind="stable")]
        count = np.bincount(first, minlength=letters)
        done = np.cumsum(count) - count
        if large:
            sa[np.repeat(fill - done, count) + np.arange(len(p))] = p
            fill[:] += count
        else:
            sa[np.repeat(fill - 1 + done, count) - np.arange(len(p))] = p
            fill[:] -= count

    for c in range(letters):
        done = start[c]
        while done < fill[c]:
            block, done = sa[done : fill[c]].copy(), int(fill[c])
            spread(block, True, c)
        spread(by_letter[c], True, c)
    fill_l, fill = fill, end.copy()
    for c in range(letters - 1, -1, -1):
        done = end[c]
        while done > fill[c]:
            block, done = sa[fill[c] : done][::-1].copy(), int(fill[c])
            spread(block, False, c)
        spread(sa[start[c] : fill_l[c]][::-1], False, c)
    sa[0] = n - 1
    return sa


def doubled(name: np.ndarray, names: int) -> np.ndarray:
    """Order of all suffixes of a text of many names, whose last one occurs nowhere else.

    A suffix has the first place of those that agree with it so far. Ones that share a place are told
    apart by the places of the suffixes that begin where the agreement ends, which doubles it.
    """
    n = len(name)
    size = np.bincount(name, minlength=names)
    place = (np.cumsum(size) - size)[name]
    alive, k = np.flatnonzero(size[name] > 1), 1
    while len(alive):
        key = place[alive] * n + place[alive + k]
        order = np.argsort(key)
        alive, key = alive[order], key[order]
        old = place[alive]
        first = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(alive))
        own = np.maximum.accumulate(np.where(first, at, 0))
        place[alive] = old + own - np.maximum.accumulate(np.where(group, at, 0))
        alive = alive[~(first & np.append(first[1:], True))]
        k *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Order of all suffixes of ``t``, whose last letter is 0 and occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    if letters > SMALL:
        return doubled(t, letters)
    s = smaller(t)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(leftmost)
    order = induce(t, s, lms[np.argsort(t[lms], kind="stable")], letters)
    order = order[leftmost[order]]
    # Names of the substrings from one leftmost-smaller place to the next.
    after = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = after - lms + 1
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (a < n - 1) & (b < n - 1)
    alive, k = np.flatnonzero(same), 0
    while len(alive):
        x, y = a[alive], b[alive]
        equal = t[x + k] == t[y + k]
        same[alive[~equal]] = False
        k += 1
        alive = alive[equal]
        alive = alive[length[a[alive]] > k]
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    names = int(name[order[-1]]) + 1
    if names < len(lms):
        order = lms[suffix_array(name[lms], names)]
    return induce(t, s, order, letters)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP: for each place, how much its suffix shares with the one before it in order, up to ``most``.

    A value that is not one less than its left neighbour's is compared anew; all such are compared together, letter
    by letter, and the rest follow from them.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.arange(n) - 1
    known = (phi >= 0) & (before >= 0)
    left = np.where(known, phi - 1, -1)
    follows = np.zeros(n, bool)
    at = np.flatnonzero(left >= 0)
    follows[at] = (t[before[at]] == t[left[at]]) & (phi[before[at]] == left[at])
    fresh = np.flatnonzero(~follows & (phi >= 0))
    shared = np.zeros(n, np.int64)
    alive, k = fresh, 0
    limit = 4 * most
    while len(alive) and k < limit:
        inside = (alive + k < n) & (phi[alive] + k < n)
        alive = alive[inside]
        alive = alive[t[alive + k] == t[phi[alive] + k]]
        k += 1
        shared[alive] = k
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(phi >= 0, shared[start] - (np.arange(n) - start), 0)


ship(__name__)
