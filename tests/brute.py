"""Plain-Python answers for small inputs, written from the semantics alone."""

from collections import Counter, defaultdict


def shape_table(max_words, max_gap):
    table = {}
    for words in range(2, max_words + 1):
        table[100 * words] = tuple(range(words))
        for gap in range(1, max_gap + 1):
            for variant in range(words - 1):
                left = (2 - variant) if words == 3 else variant + 1
                table[100 * words + 10 * gap + variant] = tuple(
                    k if k < left else k + gap for k in range(words)
                )
    return table


def tokens(line):
    return [word for word in line.split(" ") if word]


def chunks(line, max_words=2, max_gap=1):
    found, words = [], tokens(line)
    for code, offsets in shape_table(max_words, max_gap).items():
        for start in range(len(words) - offsets[-1]):
            found.append((" ".join(words[start + o] for o in offsets), code))
    return found


def counts(lines, max_words=2, max_gap=1):
    total = Counter()
    for line in lines:
        total.update((word, 0) for word in tokens(line))
        total.update(chunks(line, max_words, max_gap))
    return total


def halves(text, code):
    words = text.split(" ")
    offsets = shape_table(4, 4)[code]
    jumps = [k for k in range(1, len(offsets)) if offsets[k] - offsets[k - 1] > 1]
    cut = jumps[0] if jumps else 1
    sides = words[:cut], words[cut:]
    return [(" ".join(side), 0 if len(side) == 1 else 100 * len(side)) for side in sides]


def chi2(a, b, c, d):
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    return (a + b + c + d) * (a * d - b * c) ** 2 / spread if spread else 20.0


def tables(lines, max_words=2, max_gap=1):
    counted, size, result = counts(lines, max_words, max_gap), len(lines), {}
    for (text, code), n in counted.items():
        if not code:
            continue
        n11 = min(n, size)
        outer = [counted.get(half, 0) - n11 for half in halves(text, code)]
        n10, n01 = (size - n11 if rest > size else rest for rest in outer)
        result[text, code] = (n11, n10, n01, size - n10 - n01 - n11)
    return result


def is_in(text, code, line, match="substring"):
    if code % 100 == 0 and match == "substring":
        return text in line
    return (text, code) in chunks(line, 4, 4)


def candidates(kept, pairs, max_words=2, max_gap=1, match="substring"):
    """{chunk: [(score, key)] best first} for ``pairs`` of (dst, src)."""
    n_src = counts([src for _, src in pairs], max_words, max_gap)
    n_dst = counts([dst for dst, _ in pairs], max_words, max_gap)
    joint = defaultdict(Counter)
    for chunk in kept:
        for dst, src in pairs:
            if is_in(*chunk, src, match):
                joint[chunk].update(chunks(dst, max_words, max_gap))
    ranked = {}
    for chunk, found in joint.items():
        scored = []
        for target, n in found.items():
            n10, n01 = n_src.get(chunk, 0) - n, n_dst[target] - n
            scored.append((chi2(n, n10, n01, len(pairs) - n10 - n01 - n), "%s@%d" % target))
        if scored:
            ranked[chunk] = sorted(scored, reverse=True)
    return ranked
