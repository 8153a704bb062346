"""Suffix-array dedup: removes every byte that a string of 200 bytes covers which starts anywhere else too.

A window (200 bytes of a document) is owned by the smallest hash among the
50-byte grams in it, the leftmost if equal. Equal windows have equal owners, so
windows that can be equal meet by the hash of their owner, and an owner's
windows lie side by side: they and what they cover are one context. One
shuffle of hashes, without texts, drops owners that come once; owners of very many
contexts are counted before it, and their frequent contexts known to the tasks. Contexts that are
equal as a whole are repeated in full. Different contexts of an owner are put into shards, whose suffix
arrays (induced sorting) and permuted common prefixes tell which windows recur.
An owner with more than a shard of different contexts (a common line in many
surroundings) is not held in a task: its windows meet by a hash of their bytes.
Texts are joined with what is wanted of them once, and with their spans once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemine.llm.fetch import bitmap, slot
from phrasemine.llm.shipping import ship
from phrasemine.llm.suffixes import common_prefixes, suffix_array
from phrasemine.llm.words import mix, powers, slices, utf8
from phrasemine.operators.lookup import FREQUENT_SHARE
from phrasemine.plans.stage import stage

GRAM = 50
PLACE_BITS = 28  # bits of a gram's place in a slice; the other bits of the order are of its hash
SHARD = 1 << 19  # bytes of contexts whose suffixes are sorted together
BINS = 1 << 16  # contexts are counted by so many values of their owners' low bits
HOT_SHARE = FREQUENT_SHARE  # an owner with a larger share of all contexts is hot; 1 / HOT_SHARE owners can be
KEY = ["key", "mark"]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def contexts(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner's hash, row, first window's start in the row, number of windows, its place in ``data``) of each context."""
    n, per = len(data), length - GRAM + 1
    if n > 1 << PLACE_BITS:
        raise ValueError(f"a text of more than {1 << PLACE_BITS} bytes")
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none, none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    owner = (window_minima(keys, per) & low).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(owner)]
    valid = np.arange(len(owner)) + length <= at[row + 1]
    first = valid.copy()
    first[1:] &= (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none, none
    count = np.add.reduceat(valid.astype(np.int64), start)
    return grams[owner[start]], row[start], start - at[row[start]], count, start


def row_key() -> list[Column]:
    """What tells documents apart: the id, or without one a hash of the text, and another hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.hash("text")]


def long_texts(docs: DataFrame, length: int) -> DataFrame:
    key = [c.alias(name) for c, name in zip(row_key(), KEY, strict=True)]
    return docs.filter(F.octet_length("text") >= length).select(*key, "text")


def all_contexts(docs: DataFrame, length: int) -> DataFrame:
    """``(owner, content, key, mark, start, windows)`` of every context of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mark = (batch.column(c).to_numpy() for c in KEY)
            for first, data, at in slices(batch.column("text")):
                owner, row, start, count, place = contexts(data, at, length)
                view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
                ends = (place + count + length - 1).tolist()
                content = [digest(view[a:b]) for a, b in zip(place.tolist(), ends, strict=True)]
                yield pa.record_batch(
                    {
                        "owner": pa.array(owner.view(np.int64)),
                        "content": pa.array(np.array(content, np.uint64).view(np.int64)),
                        "key": pa.array(key[first + row]),
                        "mark": pa.array(mark[first + row]),
                        "start": pa.array(start.astype(np.int32)),
                        "windows": pa.array(count.astype(np.int16)),
                    }
                )

    schema = "owner long, content long, key long, mark int, start int, windows short"
    return long_texts(docs, length).mapInArrow(work, schema)


def repeated_in_shards(texts: DataFrame, length: int) -> DataFrame:
    """``(key, mark, start, windows)``: runs of windows that recur among ``(owner, key, mark, start, context)`` of an owner."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        t = np.full(sum(len(c) + 1 for *_, c in rows) + 1, 1, np.int64)
        ends, at = [], 0
        for *_, c in rows:
            t[at : at + len(c)] = np.frombuffer(c, np.uint8)
            t[at : at + len(c)] += 2
            at += len(c) + 1
            ends.append(at - 1)
        t[-1] = 0
        sa = suffix_array(t, 258)
        shared = common_prefixes(t, sa, 4 * length)
        most = shared.copy()
        most[sa[:-1]] = np.maximum(most[sa[:-1]], shared[sa[1:]])
        ends = np.array(ends)
        which = np.searchsorted(ends, np.arange(len(t) - 1), "left")
        whole = np.arange(len(t) - 1) + length <= ends[np.minimum(which, len(ends) - 1)]
        hit = np.append(whole & (most[:-1] >= length), False)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = which[a]
            _, key, mark, start, context = rows[k]
            out.append((key, mark, start + a - (int(ends[k]) - len(context)), b - a))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int16())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.record_batch(arrays, names=[*KEY, "start", "windows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                # Owners stay together; a shard ends with an owner.
                if held >= SHARD and row[0] != rows[-1][0]:
                    yield search(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield search(rows)

    dealt = texts.repartition("owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(work, "key long, mark int, start int, windows short")


def pieces_of_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(owner, key, mark, start, context, window)`` of the contexts ``(owner, key, mark, start, windows, large)`` in ``wanted``.

    A context of a large owner comes as a hash of each of its windows, any other one as its bytes.
    """

    def part(text: bytes, parts: list[dict]) -> Iterator[tuple]:
        view, digest = memoryview(text), xxhash.xxh3_64_intdigest
        for p in parts:
            owner, start, end = p["owner"], p["start"], p["start"] + p["windows"]
            if p["large"]:
                for at in range(start, end):
                    h = digest(view[at : at + length])
                    yield owner, at, None, h - (1 << 64) if h >> 63 else h
            else:
                yield owner, start, text[start : end + length - 1], None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for k, parts in enumerate(batch.column("parts")):
                made = list(part(data[at[k] : at[k + 1]].tobytes(), parts.as_py()))
                owner, start, context, window = (pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))
                own = [batch.column(c).take(pa.array([k] * len(made), pa.int64())) for c in KEY]
                yield pa.record_batch([owner, *own, start, context, window], names=["owner", *KEY, "start", "context", "window"])

    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("owner", "start", "windows", "large")).alias("parts"))
    joined = long_texts(docs, length).join(lists, KEY).select(*KEY, "text", "parts")
    return joined.mapInArrow(work, "owner long, key long, mark int, start int, context binary, window long")


def repeated_by_hash(rows: DataFrame, counts: DataFrame, most: float, among: DataFrame | None = None) -> DataFrame:
    """``(key, mark, start, windows)`` of the rows ``(owner, content, key, mark, start, windows)`` whose ``content``, a hash, comes again for their owner.

    ``counts(owner, content, n)`` tell how often each comes. Those that come more than ``most`` times, HOT_SHARE of all rows,
    are 1 / HOT_SHARE at most: they are known to the tasks and told where they are, neighbours in a document as one run. Of all
    others the equal ones meet, in groups of at most that share; a bitmap of the hashes that come again keeps most of those that
    come once where they are. With ``among(owner)``, as few, rows of other owners are left out.
    """
    again = bitmap(counts.filter(F.col("n") > 1).filter(F.col("n") <= most), "content")
    known = counts.filter(F.col("n") > most).select("owner", "content").orderBy("content").toArrow()
    owners, hashes = (known.column(c).to_numpy() for c in ("owner", "content"))
    only = None if among is None else among.select("owner").orderBy("owner").toArrow().column("owner").to_numpy()

    def place(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(values, sought), len(values) - 1)

    def is_known(batch: pa.RecordBatch) -> np.ndarray:
        owner, content = (batch.column(c).to_numpy() for c in ("owner", "content"))
        if not len(hashes):
            return np.zeros(len(owner), bool)
        at = place(hashes, content)
        return (hashes[at] == content) & (owners[at] == owner)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_known(batch)))
            if not len(batch):
                continue
            key, mark, start, windows = (batch.column(c).to_numpy() for c in (*KEY, "start", "windows"))
            first = np.ones(len(batch), bool)
            first[1:] = start[1:] != start[:-1] + windows[:-1]
            for x in (key, mark):
                first[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(first)
            runs = np.add.reduceat(windows.astype(np.int32), at, dtype=np.int32)
            yield pa.record_batch([key[at], mark[at], start[at], runs], names=[*KEY, "start", "windows"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.drop_columns(["slot"])
            wanted = ((again[at >> 6] >> (at & 63)) & 1 == 1) & ~is_known(batch)
            if only is not None:
                owner = batch.column("owner").to_numpy()
                wanted &= only[place(only, owner)] == owner
            yield batch.filter(pa.array(wanted))

    times = F.count("*").over(Window.partitionBy("owner", "content"))
    rest = rows.withColumn("slot", slot("content")).mapInArrow(others, rows.schema).withColumn("times", times).filter("times > 1")
    rest = rest.select(*KEY, "start", F.col("windows").cast("int").alias("windows"))
    return rest.unionAll(rows.mapInArrow(told, rest.schema))


def marked_side_by_side(every: DataFrame) -> DataFrame:
    """Contexts of owners that come again, whose rows meet in one task: with ``twin`` (an equal one is there),
    ``same`` (and stands before it), ``various`` (the owner has different ones)."""
    order = Window.partitionBy("owner").orderBy("content")
    group = Window.partitionBy("owner")
    same = F.coalesce(F.lag("content").over(order) == F.col("content"), F.lit(False))
    again = F.coalesce(F.lead("content").over(order) == F.col("content"), F.lit(False))
    return (
        every.withColumn("same", same)
        .withColumn("twin", same | again)
        .withColumn("various", F.min("content").over(group) != F.max("content").over(group))
        .filter("twin or various")
    )


def in_bins(column: str, bins: list[int]) -> Column:
    """Whether the low bits of a number are one of ``bins``, by one flag for each of the BINS."""
    words = [0] * (BINS // 64)
    for k in bins:
        words[k >> 6] |= 1 << (k & 63)
    flags = ", ".join(f"{w - (w >> 63 << 64)}L" for w in words)
    return F.expr(f"getbit(array({flags})[cast({column} & {BINS - 1} as int) div 64], cast({column} & 63 as int)) = 1")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(key, mark, spans)``: for documents with repeated windows, runs ``(start, windows)`` of their starts.

    Rows of an owner meet in one task if they are HOT_SHARE of all at most, and its
    contexts are sorted in one if they have SHARD bytes at most. A hot owner's rows are
    counted in the tasks; frequent contexts are told where they are, and only the others meet (``repeated_by_hash``).
    """
    every = stage(all_contexts(docs, length), "contexts")
    most = HOT_SHARE * every.count()
    # Bins and owners are 1 / HOT_SHARE rows at most.
    own_bin = F.col("owner").bitwiseAND(F.lit(BINS - 1).cast("long"))
    bins = every.groupBy(own_bin.alias("bin")).agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()
    # All four are of one row, the same one.
    one = [F.first(c).alias(c) for c in (*KEY, "start", "windows")]
    inside = every.filter(in_bins("owner", [row["bin"] for row in bins]))
    counted = stage(inside.groupBy("owner", "content").agg(F.count("*").alias("n"), *one), "counted")
    owners = (
        counted.groupBy("owner")
        .agg(F.sum("n").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter(F.col("n") > most)
        .select("owner", (F.col("low") != F.col("high")).alias("various"))
    )
    owners = stage(owners, "owners")
    where = ["owner", *KEY, "start", "windows"]
    twins = wanted = None
    if owners.head(1):
        counts = stage(counted.join(F.broadcast(owners), "owner"), "counts")
        twins = repeated_by_hash(every, counts, max(1, most), owners)
        every = every.join(F.broadcast(owners), "owner", "left_anti")
        wanted = counts.filter("various").select(*where)
    marked = stage(marked_side_by_side(every).drop("content"), "marked")
    side_by_side = marked.filter("various and not same").select(*where)
    wanted = side_by_side if wanted is None else wanted.unionAll(side_by_side)
    # Owners with more than a shard of contexts; there are at most as many as there are shards in all.
    large = wanted.groupBy("owner").agg(F.sum(F.col("windows") + F.lit(length - 1)).alias("n")).filter(F.col("n") > SHARD)
    large = stage(large.select("owner", F.lit(True).alias("large")), "large")
    told = wanted.join(F.broadcast(large), "owner", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    pieces = stage(pieces_of_texts(docs, told, length), "pieces")
    runs = marked.filter("twin").select(*KEY, "start", "windows")
    runs = runs.unionAll(repeated_in_shards(pieces.filter("window is null").drop("window"), length))
    if twins is not None:
        runs = runs.unionAll(twins)
    if large.head(1):
        windows = pieces.filter("window is not null").select(
            "owner", F.col("window").alias("content"), *KEY, "start", F.lit(1).cast("short").alias("windows")
        )
        counts = windows.groupBy("owner", "content").agg(F.count("*").alias("n"))
        runs = runs.unionAll(repeated_by_hash(windows, counts, max(1, HOT_SHARE * windows.count())))
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def kept_bytes(text: bytes, spans: list[dict], length: int) -> tuple[bytes, int, int]:
    """What is left of a text, how much was removed, and in how many maximal runs."""
    change = np.zeros(len(text) + 1, np.int64)
    start = np.array([s["start"] for s in spans], np.int64)
    end = start + np.array([s["windows"] for s in spans], np.int64) + length - 1
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def suffix_dedup(docs: DataFrame, length: int = 200, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``as_text``, ``kept`` is a string, without the characters that lost some of their bytes.

    Matches never cross documents, overlapping ones count, and all are judged
    on the input. Null and empty texts keep no bytes and lose none. A text that
    comes twice in any two rows loses every byte if it has at least ``length``. Rows are
    told apart by id and text: different texts with one id, or without any, are documents of their own. Columns of ``docs``
    with the names of the new ones are replaced.
    """
    rest = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    spans = repeated_spans(docs, length).select(*[F.col(c).alias(f"__{c}") for c in (*KEY, "spans")])
    names = [f"__{c}" for c in KEY]
    joined = rest.withColumns(dict(zip(names, row_key(), strict=True))).join(spans, names, "left").drop(*names)
    bare = F.coalesce(F.col("text"), F.lit(""))
    bare = bare if as_text else bare.cast("binary")
    whole = joined.filter("__spans is null").drop("__spans").select(
        "*",
        bare.alias("kept"),
        F.octet_length(bare).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, at = utf8(batch.column("text"))
            out = []
            for k, found in enumerate(batch.column("__spans")):
                text = data[at[k] : at[k + 1]].tobytes()
                if found.is_valid:
                    kept, removed, runs = kept_bytes(text, found.as_py(), length)
                    out.append((kept, len(text), removed, runs))
                else:
                    out.append((text, len(text), 0, 0))
            new = pa.record_batch(
                [
                    pa.array([x[0].decode(errors="ignore") if as_text else x[0] for x in out]),
                    *[pa.array([x[c] for x in out], pa.int64()) for c in (1, 2, 3)],
                ],
                names=["kept", "n_bytes", "n_removed", "n_spans"],
            )
            old = batch.drop_columns(["__spans"])
            yield pa.record_batch([*old.columns, *new.columns], names=[*old.schema.names, *new.schema.names])

    return joined.mapInArrow(cut, whole.schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ship(__name__)
