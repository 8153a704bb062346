"""Small awkward document tables, and plain Python versions of what the operators compute."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def awkward(seed=3):
    """Copies, near copies, shared passages, nulls, empty, blank, short and very long texts, repeated rows."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [" ".join(base)] * 3
    texts += [" ".join(edited(rng, base, k % 5)) for k in range(12)]
    texts += [" ".join(prose(rng, 80) + passage + prose(rng, 50)) for _ in range(5)]
    texts += [" ".join(prose(rng, rng.randrange(1, 90))) for _ in range(15)]
    texts += [None, "", " \t\n", "one", "one two three four", "ONE Two three\x0bfour", "é ü ñ ßtraße 日本 語", "a\x00b c", "A" * 3000]
    texts += [" ".join(prose(rng, 6000)), "so so " * 400, "ab" * 500]
    rows = [
        (k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t) if t is not None else None)
        for k, t in enumerate(texts)
    ]
    return [*rows, rows[4], rows[4], rows[-1]]


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*[w[k:] for k in range(size)], strict=False))


def joined(links, ids):
    """Smallest id that each of ``ids`` reaches."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_groups(rows, percent=80):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, joined(links, sets)


def repeated(rows, length):
    """(bytes, kept, removed, runs) of each row; rows with one id count as rows of their own."""
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), kept, sum(gone), runs))
    return out
