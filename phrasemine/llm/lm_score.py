"""Language-model scoring by deleted interpolation.

A token's probability after a word is a mixture of maximum-likelihood estimates
of the pair and of the token alone, and of a uniform floor. The weights depend on how often the
word before occurs (buckets by powers of two), and are learnt by
expectation-maximisation on counts from which the occurrence in question is held out.

Texts are encoded once, in blocks of some megabytes with a dictionary of their
own. Blocks send their distinct words, and then their distinct pairs, to buckets by hash;
each bucket sums over the corpus and answers every block with the sums of
what it sent. So all counts cover the whole corpus, what is shuffled grows with the text
and not with repetition inside a block, and no table is broadcast. Blocks are staged by their number and stay
where they lie; only messages and answers are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.packing import pack, unpack
from phrasemine.llm.shipping import ship
from phrasemine.llm.words import mix, slice_words, slices
from phrasemine.plans.stage import stage, stage_by_key

BLOCK = 8 << 20  # bytes of text in a block
START, END = np.uint64(1), np.uint64(2)  # in place of a word's hash
CLASSES = 34  # buckets of the context's frequency: unseen, 1, 2-3, 4-7, ...
RATIOS = 96  # bins of the ratio of both estimates, two for each power of two; bin 0: the pair is new
LEVELS = 256
SUMS = 8

MESSAGE = "kind int, part int, block long, payload binary"


def message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "part", "block", "payload"]
    )


def level(count: np.ndarray) -> np.ndarray:
    """A byte for a count: exact below 64, then eight to a power of two."""
    count = np.asarray(count, np.float64)
    high = 64 + np.round(8 * np.log2(np.maximum(count, 64) / 64))
    return np.where(count < 64, count, np.minimum(high, LEVELS - 1)).astype(np.uint8)


def level_counts() -> np.ndarray:
    """The count that each byte stands for."""
    k = np.arange(LEVELS)
    return np.where(k < 64, k, 64 * 2.0 ** ((k - 64) / 8))


def class_of(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.where(count < 1, 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, CLASSES - 1)).astype(np.int64)


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, held-out flags, where each starts, a dictionary, and the tokens as places in it."""

    def close(held: list[tuple]) -> bytes:
        ids, known, out, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        words, tokens = np.unique(hashes, return_inverse=True)
        return pack(ids=ids, known=known, out=out, sizes=sizes, words=words, tokens=tokens.astype(np.uint32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            id_column = batch.column("doc_id").cast(pa.int64())
            known = id_column.is_valid().to_numpy(zero_copy_only=False)
            ids = id_column.fill_null(0).to_numpy()
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, data, at in slices(batch.column("text")):
                h, word_at = slice_words(data, at)
                h = np.maximum(h, np.uint64(3))
                rows = slice(first, first + len(at) - 1)
                # One end after the words of each row.
                tokens = np.insert(h, word_at[1:], END)
                held.append((ids[rows], known[rows], out[rows], np.diff(word_at) + 1, tokens))
                size += len(data)
                if size >= BLOCK:
                    yield message([(0, 0, (part << 24) + k, close(held))])
                    k, held, size = k + 1, [], 0
        if held:
            yield message([(0, 0, (part << 24) + k, close(held))])

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, MESSAGE)


def split_sorted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each of some sorted hashes, ascending, and the bounds of all buckets."""
    at = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return at, np.searchsorted(at, np.arange(parts + 1))


def word_messages(block: int, b: dict, parts: int) -> Iterator[tuple]:
    """A block's distinct words and how often they occur in training."""
    train = np.repeat(~b["out"], b["sizes"])
    count = np.bincount(b["tokens"][train], minlength=len(b["words"]))
    at, bounds = split_sorted(b["words"], parts)
    for p in np.unique(at).tolist():
        own = slice(bounds[p], bounds[p + 1])
        yield (1, p, block, pack(words=b["words"][own], count=count[own].astype(np.uint32)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their sums, and the sums for each of the arrays."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    return distinct, total, np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted messages with the same value of ``column``."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = row[batch.schema.get_field_index(column)]
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def small(counts: np.ndarray) -> np.ndarray:
    """The same counts in as few bytes as hold them."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32 if counts.max() >> 32 == 0 else np.int64)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One message for each part, with the sums of its arrays."""
    total: dict[tuple, dict] = {}
    for batch in batches:
        for kind, part, _, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new, old = unpack(payload), total.get((kind, part))
            total[kind, part] = {k: x + old[k] for k, x in new.items()} if old else new
    yield message([(kind, part, -1, pack(**x)) for (kind, part), x in total.items()])


def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers with the corpus counts of the words sent, in their order; totals are kind 9."""
    for part, rows in grouped(batches, "part"):
        sent = [unpack(r[3]) for r in rows]
        words, total, answers = summed([s["words"] for s in sent], [s["count"] for s in sent])
        yield message([(9, part, -1, pack(n=int(total.sum()), v=int((total > 0).sum())))])
        yield message([(r[0], part, r[2], pack(count=small(a))) for r, a in zip(rows, answers, strict=True)])


def with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each block with its own payload, as kind 0, and the answers to it."""
    for batch in batches:
        for block, payload, answers in zip(*(batch.column(c) for c in ("block", "payload", "answers")), strict=True):
            number = block.as_py()
            yield number, [
                (0, 0, number, payload.as_py()),
                *((a["kind"], a["part"], number, a["payload"]) for a in answers.as_py() or ()),
            ]


def with_counts(rows: list[tuple], parts: int) -> tuple[dict, np.ndarray]:
    """A block and the corpus counts of its words, from its messages."""
    block = unpack(next(r[3] for r in rows if r[0] == 0))
    count = np.zeros(len(block["words"]), np.int64)
    _, bounds = split_sorted(block["words"], parts)
    for kind, part, _, payload in rows:
        if kind == 1:
            count[bounds[part] : bounds[part + 1]] = unpack(payload)["count"]
    return block, count


def pairs_of(b: dict, count: np.ndarray, starts: int) -> tuple[np.ndarray, ...]:
    """For each token: hash of the pair with the one before, its count, the count of the one before."""
    words = np.append(b["words"], START)
    counts = np.append(count, starts)
    before = np.empty(len(b["tokens"]), np.int64)
    before[1:] = b["tokens"][:-1]
    first = np.cumsum(b["sizes"]) - b["sizes"]
    before[first] = len(words) - 1
    keys = mix(words[before] * np.uint64(0x9FB21C651E98DF25) + words[b["tokens"]])
    # 48 bits: two pairs meet by chance once in some 10**14.
    return keys & ~np.uint64(0xFFFF), counts[b["tokens"]], counts[before]


def pair_messages(block: int, rows: list[tuple], parts: int, starts: int) -> Iterator[tuple]:
    b, count = with_counts(rows, parts)
    keys, own, context = pairs_of(b, count, starts)
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    train = np.repeat(~b["out"], b["sizes"])
    seen = np.bincount(place[train], minlength=len(distinct))
    at, bounds = split_sorted(distinct, parts)
    for p in np.unique(at).tolist():
        part = slice(bounds[p], bounds[p + 1])
        gaps = np.diff(distinct[part] >> np.uint64(16), prepend=np.uint64(0))
        steps = gaps[1:].astype(np.uint32) if gaps[1:].max(initial=np.uint64(0)) >> np.uint64(32) == 0 else gaps[1:]
        c = seen[part]
        yield (
            2, p, block,
            pack(first=gaps[0], steps=steps, count=small(c),
                 own=level(own[first[part]]), context=level(context[first[part]])),
        )


def sum_pairs(n: int, v: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers (kind 2) with the corpus counts of the pairs sent; held-out statistics are kind 8."""
        for part, rows in grouped(batches, "part"):
            sent = [unpack(r[3]) for r in rows]
            keys = [np.cumsum(np.append(s["first"], s["steps"].astype(np.uint64)), dtype=np.uint64) for s in sent]
            distinct, total, answers = summed(keys, [s["count"] for s in sent])
            _, one = np.unique(np.concatenate(keys), return_index=True)
            own, context = (np.concatenate([s[k] for s in sent])[one] for k in ("own", "context"))
            yield message([(8, part, -1, pack(table=held_out_table(total, own, context, n, v)))])
            yield message(
                [
                    (2, part, r[2], pack(count=small(a)))
                    for r, a in zip(rows, answers, strict=True)
                ]
            )

    return work


def held_out_table(total: np.ndarray, own: np.ndarray, context: np.ndarray, n: int, v: int) -> np.ndarray:
    """Training tokens by (class of the context, ratio of pair and word estimate, level of the word), each token left out of its own counts."""
    use = total > 0
    total, own, context = total[use], own[use].astype(np.int64), context[use].astype(np.int64)
    meant = level_counts()
    left = np.maximum(meant[context] - 1, 0)
    pair = (total - 1) / np.maximum(left, 1)
    word = np.maximum(meant[own] - 1, 0) / max(n - 1, 1)
    ratio = np.zeros(len(total), np.int64)
    some = (total > 1) & (word > 0)
    ratio[some] = np.clip(np.round(2 * np.log2(pair[some] / word[some])) + 40, 1, RATIOS - 1)
    flat = (class_of(left) * RATIOS + ratio) * LEVELS + own
    return np.bincount(flat, total, CLASSES * RATIOS * LEVELS).reshape(CLASSES, RATIOS, LEVELS)


def learn_weights(table: np.ndarray, n: int, v: int, rounds: int = 50) -> np.ndarray:
    """Weights (pair, word, floor) for each class of contexts by expectation-maximisation.

    Classes without held-out tokens, and unseen contexts, give the pair no weight if they have no evidence for it.
    """
    word = np.maximum(level_counts() - 1, 0)[None, :] / max(n - 1, 1)
    pair = np.where(np.arange(RATIOS) > 0, 2.0 ** ((np.arange(RATIOS) - 40) / 2), 0)[:, None] * word
    floor = np.full_like(pair, 1 / (v + 1))
    parts = np.stack(np.broadcast_arrays(pair, word, floor))
    out = np.empty((CLASSES, 3))
    for c in range(CLASSES):
        w = np.array([0.0 if c == 0 else 0.5, 0.4, 0.1 if c else 0.6])
        w /= w.sum()
        mass = table[c]
        if mass.sum() > 0:
            for _ in range(rounds):
                share = w[:, None, None] * parts
                share /= share.sum(0)
                w = (share * mass).sum((1, 2)) + np.array([0, 1e-6, 1e-6])
                w /= w.sum()
        out[c] = w
    return out


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scores(rows: list[tuple], weights: np.ndarray, n: int, v: int, parts: int, starts: int) -> pa.RecordBatch:
    b, count = with_counts(rows, parts)
    keys, own, context = pairs_of(b, count, starts)
    distinct, place = np.unique(keys, return_inverse=True)
    at, bounds = split_sorted(distinct, parts)
    pair_count = np.zeros(len(distinct), np.int64)
    for r in rows:
        if r[0] == 2:
            pair_count[bounds[r[1]] : bounds[r[1] + 1]] = unpack(r[3])["count"]
    w = weights[class_of(context)]
    p = w[:, 0] * pair_count[place] / np.maximum(context, 1) + w[:, 1] * own / max(n, 1) + w[:, 2] / (v + 1)
    first = np.cumsum(b["sizes"]) - b["sizes"]
    total = lambda x: np.add.reduceat(x, first)
    ids = pa.array(b["ids"], pa.int64(), mask=~b["known"])
    return pa.record_batch(
        [
            ids,
            pa.array(b["out"]),
            pa.array(b["sizes"].astype(np.int64)),
            pa.array(total((own > 0).astype(np.int64))),
            pa.array(np.full(len(ids), n, np.int64)),
            pa.array(total(np.log10((own + 1.0) / (n + (v + 1.0))))),
            pa.array(total(np.log10(p))),
        ],
        names=[f.split()[0] for f in RESULT.split(", ")],
    )


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs`` ``(doc_id, text)``.

    Learns from the rows for which ``held_out`` is not true. Tokens are the
    words and one end. ``base_score`` is the sum over tokens of
    log10((c + 1) / (N + V + 1)), ``score`` that of the mixture. Null, empty
    and blank texts are one end. Repeated rows count and are scored as often as they
    come. Without training rows N is 0 and all tokens are unknown. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ready = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    blocks = stage_by_key(encode(ready).select("block", "payload"), "blocks", ["block"])
    starts = ready.filter(~F.col("held_out")).count()
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * shuffled, blocks.count() // 32)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield message(list(word_messages(block, unpack(payload), parts)))

    def to_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part")

    def to_blocks(*tables: DataFrame) -> DataFrame:
        answers = tables[0].filter("block >= 0")
        for t in tables[1:]:
            answers = answers.unionAll(t.filter("block >= 0"))
        found = answers.groupBy(F.col("block").alias("__block")).agg(
            F.collect_list(F.struct("kind", "part", "payload")).alias("answers")
        )
        own = blocks.hint("merge").join(found, F.col("block") == F.col("__block"), "left")
        return own.select("block", "payload", "answers")

    def gather(answers: DataFrame, kind: int) -> list[dict]:
        """What the buckets have for the driver, summed by the tasks to SUMS rows at most."""
        rows = answers.filter(F.col("kind") == kind).withColumn("part", F.pmod("part", F.lit(SUMS)))
        summed = rows.repartition(SUMS, "part").sortWithinPartitions("part").mapInArrow(add_up, MESSAGE)
        return [unpack(r["payload"]) for r in summed.select("payload").collect()]

    words = stage(to_buckets(blocks.mapInArrow(send_words, MESSAGE)).mapInArrow(sum_words, MESSAGE), "words")
    totals = gather(words, 9)
    n, v = sum(t["n"] for t in totals), sum(t["v"] for t in totals)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in with_answers(batches):
            yield message(list(pair_messages(block, rows, parts, starts)))

    sent = to_blocks(words).mapInArrow(send_pairs, MESSAGE)
    pairs = stage(to_buckets(sent).mapInArrow(sum_pairs(n, v), MESSAGE), "pairs")
    table = np.zeros((CLASSES, RATIOS, LEVELS))
    for t in gather(pairs, 8):
        table += t["table"]
    weights = learn_weights(table, n, v)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in with_answers(batches):
            yield scores(rows, weights, n, v, parts, starts)

    return to_blocks(words, pairs).mapInArrow(score, RESULT)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)


ship(__name__)
