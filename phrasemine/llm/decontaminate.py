"""Benchmark decontamination by spaced-seed hashing.

A fixed mask picks 7 of at most 12 word positions and ignores the others. The words it
picks are hashed at every position of benchmark items and of documents; where a
hash of a document is one of an item's, the two are aligned and compared word by
word, which tolerates substituted words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.shipping import ship
from phrasemine.llm.words import mix, slice_words, slices

# Fixed masks of at most SPAN word positions; each picks 7. Every beginning of a best stretch has more equal
# words than twice its unequal ones, so its k-th unequal word has 3k words before it at least, and of its first
# SPAN words LEAST_SAME or more are equal. In each such pattern one of the masks finds all its words equal.
MASKS = ("111011101", "11101101001", "1111100101", "11110110001", "111101011", "111110000011", "111011000101")
SPAN = 12
LEAST_SAME = 9
HITS = 1 << 18  # hits that are looked at together
SHARD_CHARS = 4_000_000  # benchmark text that is indexed at a time
FILTER_BITS = 24


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked words of each window of as many words as the mask has."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + h[k : n + k]
    return mix(out)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : len(out) + k]
    return mix(out)


def table(h: np.ndarray, at: np.ndarray) -> tuple:
    """Sorted hashes, the place of each, and one bit for each value of their first FILTER_BITS bits."""
    order = np.argsort(h, kind="stable")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    slot = h >> np.uint64(64 - FILTER_BITS)
    bit = np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8)
    np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), bit)
    return h[order], at[order], bits


def find(keys: np.ndarray, at: np.ndarray, bits: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in h, place in the benchmark) of all equal hashes."""
    slot = h >> np.uint64(64 - FILTER_BITS)
    byte = bits[(slot >> np.uint64(3)).astype(np.int64)]
    maybe = np.flatnonzero(byte >> (slot & np.uint64(7)).astype(np.uint8) & 1)
    low, high = np.searchsorted(keys, h[maybe]), np.searchsorted(keys, h[maybe], "right")
    n = high - low
    place = np.repeat(maybe, n)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, at[np.repeat(low, n) + inside]


def build_index(ids: list, texts: pa.Array) -> dict:
    """Words, and tables of the masked hashes, of a bounded part of the benchmark.

    An item of fewer than SPAN words has one hash, of all its words, in the
    table for its length.
    """
    words, start, total = [np.zeros(0, np.uint64)], [0], 0
    for _, data, at in slices(texts):
        h, word_at = slice_words(data, at)
        words.append(h)
        start += (word_at[1:] + total).tolist()
        total += len(h)
    words, start = np.concatenate(words), np.array(start)
    sizes = np.diff(start)
    item = np.repeat(np.arange(len(ids)), sizes)
    masks, long = [], np.repeat(sizes >= SPAN, sizes)
    for mask in MASKS:
        h = masked(words, mask)
        at = np.flatnonzero((item[: len(h)] == item[len(mask) - 1 :][: len(h)]) & long[: len(h)])
        masks.append(table(h[at], at))
    exact = {}
    for n in np.unique(sizes[(sizes > 0) & (sizes < SPAN)]).tolist():
        at = start[:-1][sizes == n]
        exact[n] = table(rolled(words, n)[at], at)
    return {"ids": ids, "words": words, "start": start, "item": item, "masks": masks, "exact": exact}


def best_run(same: np.ndarray, gap: int) -> tuple[int, int, int]:
    """(matches, first, end) of the stretch with the largest matches - ``gap`` * mismatches."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -gap))])
    lows = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lows))
    first = int(np.flatnonzero(sums[: end + 1] == lows[end])[-1])
    return int(same[first:end].sum()), first, end


def promising(
    index: dict, h: np.ndarray, word_at: np.ndarray, row_of: np.ndarray, place: np.ndarray, there: np.ndarray, span: int
) -> np.ndarray:
    """Whether a hit of a mask of ``span`` words lies in SPAN words of its row and item with LEAST_SAME equal."""
    start, words = index["start"], index["words"]
    row, item = row_of[place], index["item"][there]
    before = np.minimum(place - word_at[row], there - start[item])
    after = np.minimum(word_at[row + 1] - place, start[item + 1] - there)
    out = np.zeros(len(place), bool)
    for back in range(SPAN - span + 1):
        k = np.flatnonzero((before >= back) & (after >= SPAN - back) & ~out)
        steps = np.arange(-back, SPAN - back)
        out[k] = (h[place[k, None] + steps] == words[there[k, None] + steps]).sum(1) >= LEAST_SAME
    return out


def overlaps(index: dict, data: np.ndarray, at: np.ndarray, least: int, gap: int) -> list[tuple]:
    """(row, item, matches, words, first word in the row, first word in the item) of verified overlaps."""
    h, word_at = slice_words(data, at)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
    found = []
    for mask, hashes in zip(MASKS, index["masks"], strict=True):
        x = masked(h, mask)
        if len(x) and len(hashes[0]):
            place, there = find(*hashes, x)
            for k in range(0, len(place), HITS):
                part = place[k : k + HITS], there[k : k + HITS]
                good = promising(index, h, word_at, row_of, *part, len(mask))
                found.append((part[0][good], part[1][good], np.full(int(good.sum()), SPAN)))
    for n, hashes in index["exact"].items():
        x = rolled(h, n)
        if len(x):
            place, there = find(*hashes, x)
            found.append((place, there, np.full(len(place), n)))
    if not found:
        return []
    place, there, span = (np.concatenate(x) for x in zip(*found, strict=True))
    # Hits of masks were looked at; those of short items may reach into the next row.
    inside = (span == SPAN) | (row_of[place] == row_of[np.minimum(place + span, len(h)) - 1])
    # Hits on one diagonal of a row and an item are one alignment.
    seen = np.unique(np.stack([row_of[place], index["item"][there], place - there, span < SPAN], 1)[inside], axis=0)
    out, start = [], index["start"]
    for row, item, shift, short in seen.tolist():
        a, b = max(word_at[row], start[item] + shift), min(word_at[row + 1], start[item + 1] + shift)
        same = h[a:b] == index["words"][a - shift : b - shift]
        matches, first, end = best_run(same, gap)
        size = start[item + 1] - start[item]
        if matches == size if short else end - first >= min(least, size):
            here = int(a + first)
            out.append((row, item, matches, end - first, int(here - word_at[row]), int(here - shift - start[item])))
    return out


def shards(benchmark: DataFrame, most: int) -> Iterator[dict]:
    """The benchmark in parts of about ``most`` characters, by a hash of the item."""
    rows = benchmark.filter("text is not null").select("item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // most)
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if part:
            yield build_index([r["item_id"] for r in part], pa.array([r["text"] for r in part], pa.large_string()))


def contamination(
    docs: DataFrame, benchmark: DataFrame, least: int = SPAN, gap: int = 2, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """``(doc_id, item_id, n_matched, n_words, first_word, item_word)``: overlaps of documents and items.

    An overlap is a stretch of at least ``least`` aligned words (or all of a
    shorter item's) that has the largest number of equal words less ``gap`` times
    the unequal ones on its alignment; the masks hit every such stretch if ``least``
    is 12 or more and ``gap`` 2 or more, and smaller values are refused. Of a document and
    an item the overlap with the most equal words is returned, ties by place.
    An item of fewer than 12 words must occur whole and unchanged. Null and
    empty texts on either side overlap with nothing; repeated documents and
    items count once for each id; other columns are ignored.

    The benchmark is indexed in parts of bounded size, each sent to all
    tasks; documents stay where they are. A benchmark of many parts is a pass over
    the documents for each.
    """
    if least < SPAN or gap < 2:
        raise ValueError(f"overlaps of fewer than {SPAN} words, or with a gap below 2, could be missed")
    schema = "doc_id long, item_id long, n_matched int, n_words int, first_word int, item_word int"
    texts = docs.select("doc_id", "text")
    spark = docs.sparkSession

    def against(index: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for first, data, at in slices(batch.column("text")):
                    rows = overlaps(own, data, at, least, gap)
                    if rows:
                        row, item, *numbers = zip(*rows, strict=True)
                        yield pa.record_batch(
                            [
                                ids.take(pa.array([first + k for k in row])).cast(pa.int64()),
                                pa.array([own["ids"][k] for k in item], pa.int64()),
                                *[pa.array(x, pa.int32()) for x in numbers],
                            ],
                            names=["doc_id", "item_id", "n_matched", "n_words", "first_word", "item_word"],
                        )

        return texts.mapInArrow(work, schema)

    found = None
    for index in shards(benchmark, shard_chars):
        part = against(index)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.struct(-F.col("n_matched"), "n_words", "first_word", "item_word")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.min(best).alias("b"))
        .select("doc_id", "item_id", (-F.col("b.col1")).alias("n_matched"), "b.n_words", "b.first_word", "b.item_word")
    )


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items)


ship(__name__)
