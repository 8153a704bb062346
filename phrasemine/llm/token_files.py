"""Token ids of whole texts in compressed binary files, and back.

Ids are counted over all documents, and each id gets a canonical Huffman code
word of bounded length. A set of files is a folder with

* ``code``: ``(id, bits)``, the lengths that give the code;
* ``blocks``: whole documents in ascending order of doc_id, some 2^18 ids to a
  block. A row has the block's ``part`` (files of ascending parts continue each other) and number in
  it, the ids before it in the part, its documents' ids and sizes, the ``bits`` of all its ids, and
  the bit that every 512th id starts at. Blocks, and the stretches between these checkpoints,
  are decoded independently.

Both are Parquet, so that Spark writes and commits them on whatever store the folder is.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemine.llm import huffman
from phrasemine.llm.shipping import ship, worker_wide
from phrasemine.llm.words import slices
from phrasemine.plans.stage import checkpoint_root, stage

VOCABULARY = "word_bpe_49k.json"
END = 2
BLOCK = 1 << 18  # ids after which a block is closed
PART = 1 << 26  # ids of a part, about, where there are more of them than shuffle partitions
CACHED = 1 << 20  # pieces whose ids a Python worker keeps, some 150 bytes each
LONG = 64  # characters beyond which a piece is not kept
MARK = "\x01"
ENDS = frozenset(".,;:!?")
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
COMBINING = re.compile("[\u0300-\u036f]")


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, on one thread a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def small(text: str) -> str:
    """The text with a-z for A-Z, unless such a letter could first become one letter with a mark that follows it."""
    return text if COMBINING.search(text) else text.encode().lower().decode()


class Pieces:
    """Ids of texts by the ids of their pieces between blanks.

    For tokenizers that drop white space, do not tell capitals from small letters and whose added tokens
    contain ``<|``: no token or normalisation then reaches over a blank, and each different piece is encoded
    once. New pieces are encoded as one text, with a mark between them that has an id of its own; what
    has the mark or ``<|`` in it is encoded as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.kept: dict[str, bytes] = {}
        (self.mark,) = self.whole(MARK)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        kept = self.kept
        if len(kept) > CACHED:
            kept.clear()
        split = [None if "<|" in t or MARK in t else small(t).replace("\n", " ").split(" ") for t in texts]
        new = set(chain.from_iterable(p for p in split if p)).difference(kept)
        # A word and the one sign at its end are two tokens or more, whatever stands before.
        apart = [p for p in new if len(p) > 1 and p[-1] in ENDS and p[-2] in PLAIN]
        alone = list(new.difference(apart).union(ENDS, (p[:-1] for p in apart)).difference(kept))
        if alone:
            # Between letters or digits the mark needs no blanks around it.
            plain = [p for p in alone if p and p[0] in PLAIN and p[-1] in PLAIN]
            others = list(set(alone).difference(plain))
            alone = plain + others
            blank = f" {MARK} "
            ids = self.whole(blank.join([MARK.join(plain), *others] if plain else others))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
            starts = np.append(0, ends[:-1] + 4)
            raw = ids.tobytes()
            kept.update(zip(alone, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))
        kept.update((p, kept[p[:-1]] + kept[p[-1]]) for p in apart)
        out = [
            self.whole(t) if pieces is None else np.frombuffer(b"".join(map(kept.__getitem__, pieces)), np.uint32)
            for t, pieces in zip(texts, split, strict=True)
        ]
        for p in [p for p in chain(alone, apart) if len(p) > LONG]:
            kept.pop(p, None)
        return out


class Whole:
    """Ids of each text by itself, for any tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]


def tokenized(docs: DataFrame, path: str, end: int | None = END, encoder: type = Pieces) -> DataFrame:
    """``(doc_id, row, tie, ids, counts)``: the ids of each text, as compressed 32-bit integers.

    ``row`` numbers the rows and ``tie`` is a hash of the ids; both order documents of one doc_id. The last row
    of a task is no document: it has no ``ids``, and in ``counts`` how often the task met each id.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_wide((encoder.__name__, path), lambda: encoder(path))
        pack = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 33
        last = np.array([] if end is None else [end], np.uint32)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for first, data, at in slices(batch.column("text")):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ids = [np.append(x, last) for x in encode(texts)]
                own = batch.column("doc_id").slice(first, len(texts))
                found = np.bincount(np.concatenate(ids), minlength=len(total))
                found[: len(total)] += total
                total = found
                yield pa.record_batch(
                    {
                        "doc_id": own.cast(pa.int64()),
                        "row": pa.array(range(row, row + len(texts)), pa.int64()),
                        "tie": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        "ids": pa.array([pack.compress(columns_of(x)) for x in ids], pa.binary()),
                        "counts": pa.nulls(len(texts), counts),
                    }
                )
                row += len(texts)
        used = np.flatnonzero(total)
        pairs = list(zip(used.tolist(), total[used].tolist(), strict=True))
        none = {c: pa.nulls(1, t) for c, t in zip(("doc_id", "row", "tie", "ids"), (pa.int64(),) * 3 + (pa.binary(),), strict=True)}
        yield pa.record_batch(none | {"counts": pa.array([pairs], counts)})

    counts = pa.map_(pa.int32(), pa.int64())
    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, row long, tie long, ids binary, counts map<int,bigint>"
    )


def columns_of(ids: np.ndarray) -> bytes:
    """The low bytes of all ids, then the next, and so on, which compresses better than one id after the other."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def ids_of(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(payload), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def id_counts(tokens: DataFrame) -> DataFrame:
    """``(id, n)``: how often each id occurs; a task has a row for each of its ids before the sums."""
    return tokens.select(F.explode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(
    docs: DataFrame, folder: str, path: str, end: int | None = END, encoder: type = Pieces, limit: int = huffman.LIMIT
) -> None:
    """Write the ids of ``docs(doc_id, text)`` to the files of ``folder``, in ascending order of doc_id.

    ``path`` is the tokenizer's file, on the driver and executors alike; ``end`` is appended to each document.
    Null texts are empty. Documents without doc_id come last; documents of one doc_id are all written, in the
    order of a hash of their ids. No documents give no blocks and an empty code. Other columns are ignored.
    To the driver goes the table of counts, which has no more rows than the vocabulary.
    """
    spark = docs.sparkSession
    tokens = stage(tokenized(docs, path, end, encoder), "tokens")
    rows = stage(id_counts(tokens), "counts").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    code = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(code, "id int, bits int").coalesce(1).write.parquet(f"{folder}/code")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // PART))
    order = (F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row"))
    ordered = tokens.filter("ids is not null").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(blocks_of(lengths), BLOCKS).write.parquet(f"{folder}/blocks")


BLOCKS = (
    "part int, block int, first long, n_tokens long, doc_ids array<bigint>, sizes array<bigint>,"
    " bits binary, checkpoints array<bigint>"
)


def blocks_of(lengths: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = huffman.code_words(lengths)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def closed() -> pa.RecordBatch:
            bits, checkpoints = huffman.encode(np.concatenate(held), lengths, words)
            big = pa.list_(pa.int64())
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "first": pa.array([first], pa.int64()),
                    "n_tokens": pa.array([size], pa.int64()),
                    "doc_ids": pa.array([names], big),
                    "sizes": pa.array([[len(x) for x in held]], big),
                    "bits": pa.array([bits], pa.binary()),
                    "checkpoints": pa.array([checkpoints], big),
                }
            )

        for batch in batches:
            for name, payload in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = ids_of(payload)
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    yield closed()
                    block, first = block + 1, first + size
                    names, held, size = [], [], 0
        if held:
            yield closed()

    return work


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of each document in the files of ``folder``.

    ``start`` is how many ids all documents before it have, and ``ids`` holds its own
    as little-endian unsigned 32-bit integers. The driver gets the code and one sum a part.
    """
    code = spark.read.parquet(f"{folder}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base = np.zeros(max(sums, default=-1) + 2, np.int64)
    for part, n in sums.items():
        base[part + 1] = n
    base = np.cumsum(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = huffman.look_up(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = huffman.decode(
                    row["bits"].as_py(), row["n_tokens"].as_py(), row["checkpoints"].values.to_numpy(), table, bits
                )
                sizes = row["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                start = base[row["part"].as_py()] + row["first"].as_py() + ends - sizes
                raw = ids.astype("<u4").tobytes()
                at = np.append(0, ends * 4).tolist()
                yield pa.record_batch(
                    {
                        "doc_id": row["doc_ids"].values,
                        "start": pa.array(start),
                        "ids": pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    }
                )

    wanted = blocks.select("part", "first", "n_tokens", "doc_ids", "sizes", "bits", "checkpoints")
    return wanted.mapInArrow(work, "doc_id long, start long, ids binary")


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{checkpoint_root(spark)}/phrasemine/{uuid.uuid4().hex}/token_files"
    write_ids(docs, folder, public_tokenizers.path(VOCABULARY))
    return read_ids(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


ship(__name__)
