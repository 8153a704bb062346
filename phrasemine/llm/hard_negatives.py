"""Hard negatives of anchors by a vertical scan (BOND).

Vectors are kept in blocks with one array for each dimension. An anchor reads a block's
dimensions in descending order of its own magnitudes, adding up partial scores. What the
dimensions not yet read can still add lies between two sums, made of the block's smallest and largest
component in each; candidates that can no longer be among the first, or in no window, leave the
bitmap, until the scores of those that are left are exact.

Blocks and anchors meet in a grid of tasks: a block goes to a task for each 65,536 anchors, and
anchors to a task for each group of blocks. A task holds its anchors and streams the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasemine.llm.packing import pack, unpack
from phrasemine.llm.shipping import ship
from phrasemine.plans.stage import stage

BLOCK = 2048  # vectors of a block
ANCHORS = 1 << 16  # anchors that a task holds, about
BLOCKS_A_TASK = 64
READ = 8  # dimensions between two looks at the bounds
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max  # a null vec_id, which comes last


def components(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Floors of ``scale`` times the components of all valid vectors, their lengths, and the rows they are in."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    size = pc.list_value_length(column).drop_null().to_numpy().astype(np.int64)
    flat = column.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(x), len(size)) > 0
    x = np.floor(scale * x[np.repeat(~bad, size)])
    return x, size[~bad], rows[~bad]


def blocks_of(scale: float) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of vectors of one length, by label; a task closes what is left of each length at its end."""
        part, row, k = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list[tuple]] = {}

        def closed(size: int) -> pa.RecordBatch:
            nonlocal k
            ids, rows, labels, anchors, x = (np.concatenate(c) for c in zip(*held.pop(size), strict=True))
            order = np.lexsort((rows, ids, labels))
            x = x[order].T
            low, high = (x.min(), x.max()) if x.size else (0, 0)
            if max(-low, high) < EXACT:  # else the scores overflow, which is said when they are made
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                x = x.astype(kind)
            k += 1
            block, at = (part << 32) + k, np.flatnonzero(anchors[order])
            every = {"ids": ids[order], "rows": rows[order], "labels": labels[order]}
            payload = pack(**every, x=np.ascontiguousarray(x))
            mine = pack(**{c: v[at] for c, v in every.items()}, x=np.ascontiguousarray(x[:, at]), home=block)
            return pa.record_batch(
                {
                    "block": pa.array([block], pa.int64()),
                    "anchors": pa.array([len(at)], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                    "mine": pa.array([mine if len(at) else None], pa.binary()),
                }
            )

        for batch in batches:
            x, size, at = components(batch.column("embedding"), scale)
            ids = batch.column("vec_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()[at]
            labels = batch.column("label").cast(pa.int64()).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            anchors = batch.column("anchor").to_numpy(zero_copy_only=False)[at]
            rows = (part << 33) + row + np.arange(len(at))
            row += len(at)
            ends = np.cumsum(size)
            for n in np.unique(size).tolist():
                same = np.flatnonzero(size == n)
                place = (ends[same] - n)[:, None] + np.arange(n)
                for first in range(0, len(same), BLOCK):
                    own = same[first : first + BLOCK]
                    held.setdefault(n, []).append((ids[own], rows[own], labels[own], anchors[own], x[place[first : first + BLOCK]]))
                    if sum(len(h[0]) for h in held[n]) >= BLOCK:
                        yield closed(n)
        for n in list(held):
            yield closed(n)

    return work


class Scan:
    """A block as seen by an anchor: columns, and the order and bounds of reading them."""

    def __init__(self, x: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.x = x
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        self.a = anchor[self.order]
        ends = np.stack([self.a * low[self.order], self.a * high[self.order]])
        # What the dimensions from the j-th on can add at least and at most.
        self.least, self.most = (
            np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0))
        )

    def __call__(self, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``keep(lower, upper)`` leaves to the end, and their exact scores."""
        score = np.zeros(len(alive), self.a.dtype)
        for j in range(0, len(self.a), READ):
            dims = self.order[j : j + READ]
            score = score + self.a[j : j + READ] @ self.x[np.ix_(dims, alive)]
            k = j + len(dims)
            left = keep(score + self.least[k], score + self.most[k])
            if not left.all():
                alive, score = alive[left], score[left]
                if not len(alive):
                    break
        return alive, score


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k]


def first_of(held: list[tuple], scores, ids, rows, k: int) -> list[tuple]:
    """The first ``k`` of held ``(-score, id, row)`` and the new ones."""
    if len(scores) > k:
        good = np.flatnonzero(scores >= kth_largest(scores, k))
        good = good[np.lexsort((rows[good], ids[good], -scores[good]))[:k]]
        scores, ids, rows = scores[good], ids[good], rows[good]
    return sorted(held + list(zip((-scores).astype(np.int64).tolist(), ids.tolist(), rows.tolist(), strict=True)))[:k]


def positives_of(scan: Scan, b: dict, own: slice, row: int, held: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` of ``held`` and the block's rows ``own``, without the row itself."""
    alive = np.arange(own.start, own.stop)
    alive = alive[b["rows"][alive] != row]
    floor = -held[-1][0] if len(held) == k else -np.inf

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = max(floor, kth_largest(lower, k)) if len(lower) >= k else floor
        return upper >= least

    alive, score = scan(alive, keep)
    return first_of(held, score, b["ids"][alive], b["rows"][alive], k)


def negatives_of(scan: Scan, b: dict, own: slice, windows: list[tuple], held: list[list[tuple]], k: int) -> None:
    """Adds the block's rows outside ``own`` to the first ``k`` of each window ``(low, high)`` of scores."""
    alive = np.concatenate([np.arange(own.start), np.arange(own.stop, len(b["ids"]))])
    floors = [max(low, -h[-1][0]) if len(h) == k else low for (low, _), h in zip(windows, held, strict=True)]

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        left = np.zeros(len(lower), bool)
        for i, (low, high) in enumerate(windows):
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) >= k:
                floors[i] = max(floors[i], kth_largest(sure, k))
            left |= (upper >= floors[i]) & (lower <= high)
        return left

    alive, score = scan(alive, keep)
    for i, (low, high) in enumerate(windows):
        inside = (score >= low) & (score <= high)
        if inside.any():
            at = alive[inside]
            held[i] = first_of(held[i], score[inside], b["ids"][at], b["rows"][at], k)


CELL = "cell int, kind int, payload binary, windows array<struct<row:bigint,place:int,id:bigint,score:bigint>>"
FOUND = "home long, row long, id long, place int, positive_id long, positive_score long, score long, other long, other_row long"


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() if c.type != pa.binary() else c for c in batch.columns), strict=True)


def scan_cells(k: int, share: int, negatives: bool) -> Callable:
    """Looks at every block of a cell for every anchor of it; rows come by cell, windows before anchors before blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, windows = None, [], {}

        def found() -> pa.RecordBatch:
            out = []
            for a in anchors:
                for i, held in enumerate(a["held"]):
                    place, name, score = a["windows"][i] if negatives else (0, None, None)
                    out += [(a["home"], a["row"], a["id"], place, name, score, -s, other, row) for s, other, row in held]
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 5
            names = [c.split()[0] for c in FOUND.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for now, kind, payload, pairs in grouped(batches):
            if now != cell:
                if anchors:
                    yield found()
                cell, anchors, windows = now, [], {}
            if kind == 0:
                for w in pairs:
                    windows.setdefault(w["row"], []).append((w["place"], w["id"], w["score"]))
                continue
            b = unpack(payload.as_py())
            if kind == 1:
                for n in range(len(b["ids"])):
                    a = {"id": b["ids"][n], "row": int(b["rows"][n]), "label": b["labels"][n], "x": b["x"][:, n], "home": b["home"]}
                    a["windows"] = sorted(windows.get(a["row"], []))
                    a["held"] = [[] for _ in a["windows"]] if negatives else [[]]
                    if a["held"]:
                        anchors.append(a)
                continue
            largest = max(int(np.abs(b["x"].astype(np.float64)).max(initial=0)), 1)
            x = {t: b["x"].astype(t) for t in (np.float64,)}
            edges = {}
            for a in anchors:
                if len(a["x"]) != len(b["x"]):
                    continue
                size = float(np.abs(a["x"].astype(np.float64)).sum()) * largest
                kind_of = np.float64 if size * 100 < EXACT else np.int64
                if size * 100 >= 2.0**62:
                    raise ValueError("a score does not fit a long")
                if kind_of not in x:
                    x[kind_of] = b["x"].astype(kind_of)
                first, last = np.searchsorted(b["labels"], [a["label"], a["label"] + 1]).tolist()
                own = slice(first, last)
                part = (first, last, kind_of) if not negatives else kind_of
                if part not in edges:
                    seen = x[kind_of][:, own] if not negatives else x[kind_of]
                    edges[part] = (seen.min(1), seen.max(1)) if seen.size else (np.zeros(len(seen)),) * 2
                scan = Scan(x[kind_of], a["x"].astype(kind_of), *edges[part])
                if negatives:
                    bounds = [(-(-share * p // 100), p) for _, _, p in a["windows"]]
                    negatives_of(scan, b, own, bounds, a["held"], k)
                elif last > first:
                    a["held"][0] = positives_of(scan, b, own, a["row"], a["held"][0], k)
        if anchors:
            yield found()

    return work


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 5, share: int = 80
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors`` ``(vec_id, label, embedding)``.

    A component is the floor of ``scale`` times its value; the score of two rows is the inner product. An
    anchor's positives are the first ``positives`` other rows of its label by descending score; for each come
    the first ``negatives`` rows of other labels with a score of ``share`` percent to all of the positive's.
    Ties go by vec_id, nulls last, and then by where the row was read. Every row counts as one of its own, also if it
    repeats another. Rows with a null label or vector, or any null or non-finite component, take no part. Vectors of
    different lengths have no score. A positive with a negative score, or with no row in its window, gives
    no rows; an empty table gives none. Scores that could pass 2^62 / 100 end the job with an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ready = vectors.filter("label is not null and embedding is not null").select(
        "vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    blocks = stage(
        ready.mapInArrow(blocks_of(scale), "block long, anchors long, payload binary, mine binary"), "blocks"
    )
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors")).first()
    across = max(1, -(-size["anchors"] // ANCHORS))
    tasks = 4 * spark.sparkContext.defaultParallelism
    down = max(1, min(size["blocks"], max(-(-tasks // across), -(-size["blocks"] // BLOCKS_A_TASK))))
    column, line = F.pmod(F.xxhash64("block"), F.lit(across)), F.pmod(F.xxhash64("block", F.lit(1)), F.lit(down))

    def copies(n: int, cell: Column):
        """``n`` copies of a row, each with the cell made from its number ``at``."""
        every = F.sequence(F.lit(0), F.lit(n - 1))
        return F.explode(F.transform(every, lambda at: (cell(at)).cast("int"))).alias("cell")

    no_windows = F.lit(None).cast("array<struct<row:bigint,place:int,id:bigint,score:bigint>>").alias("windows")
    to_lines = blocks.select(
        copies(across, lambda at: at * down + line), F.lit(2).alias("kind"), "payload", no_windows
    )
    to_columns = blocks.filter("mine is not null").select(
        copies(down, lambda at: column * down + at), F.lit(1).alias("kind"), F.col("mine").alias("payload"), no_windows
    )

    def scanned(rows: DataFrame, k: int, last: bool) -> DataFrame:
        cells = rows.repartition(across * down, "cell").sortWithinPartitions("cell", "kind")
        found = cells.mapInArrow(scan_cells(k, share, last), FOUND)
        order = (F.col("score").desc(), "other", "other_row")
        first = Window.partitionBy("row", "place").orderBy(*order)
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    best = stage(scanned(to_lines.unionAll(to_columns), positives, False), "positives")
    window = F.struct("row", F.col("rank").alias("place"), F.col("other").alias("id"), "score")
    to_search = best.groupBy(F.col("home").alias("block")).agg(F.collect_list(window).alias("windows")).select(
        copies(down, lambda at: column * down + at), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), "windows"
    )
    found = scanned(to_lines.unionAll(to_columns).unionAll(to_search), negatives, True)
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        name("id").alias("anchor_id"),
        name("positive_id").alias("positive_id"),
        "rank",
        name("other").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e, row_number() over () as r
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, a.r as ar, v.r, v.vec_id, v.label = a.label as same,
    cast(list_inner_product(a.e, v.e) as bigint) as score
  from v as a join v on a.vec_id % 100 = 0 and a.r <> v.r and len(a.e) = len(v.e)
),
p as (
  select anchor_id, ar, vec_id as positive_id, score as positive_score,
    row_number() over (partition by ar order by score desc, vec_id, r) as i
  from s where same qualify i <= 5
),
n as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.ar, p.i order by s.score desc, s.vec_id, s.r) as rank
  from p join s on p.ar = s.ar and not s.same
    and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
  qualify rank <= 5
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n
"""

ship(__name__)
