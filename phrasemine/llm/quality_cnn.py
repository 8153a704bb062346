"""Quality classifier: a small byte-level convolutional network in numpy.

Bytes become learned vectors; learned filters of 12 bytes slide over the text by
4 bytes; each filter's response is max-pooled over chunks of 512 bytes that
overlap by half and cover the whole document; mean, maximum and minimum of the
chunks are combined into one probability. A document costs one pass over its
bytes, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.shipping import ship
from phrasemine.llm.words import slices

STEP, BLOCKS, HALF = 4, 3, 256  # bytes a filter moves, steps it spans, bytes of half a chunk
DIM, FILTERS = 4, 24


@dataclass(frozen=True)
class Training:
    """What a model is fitted on; these are the bounds of the sample.

    ``documents`` labelled texts at most are drawn in the order of a hash of their
    id, each whole; a text that does not fit into what is left of ``bytes`` is passed over.
    """

    documents: int = 4000
    bytes: int = 1 << 26
    steps: int = 640
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def layout(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to whole half chunks (at least two), and where each row's halves start."""
    sizes = np.diff(at)
    halves = np.maximum(2, -(-(sizes + STEP * (BLOCKS - 1)) // HALF))
    half_at = np.concatenate([[0], np.cumsum(halves)])
    padded = np.zeros(half_at[-1] * HALF, np.uint8)
    padded[np.arange(len(data)) + np.repeat(half_at[:-1] * HALF - at[:-1], sizes)] = data
    return padded, half_at


def respond(model: dict, padded: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Filter responses at each step of ``padded``; those that reach over a row's end (a step of ``ends``) do not count."""
    x = model["bytes"][padded].reshape(-1, STEP * DIM)
    parts = x @ model["filters"]
    out = parts[:, :FILTERS].copy()
    for k in range(1, BLOCKS):
        out[:-k] += parts[k:, k * FILTERS : (k + 1) * FILTERS]
    out += model["bias"]
    for k in range(1, BLOCKS):
        out[ends - k] = -np.inf
    return out


def pool(responses: np.ndarray) -> np.ndarray:
    """Maximum of each half chunk, not below 0."""
    tops = responses.reshape(-1, HALF // STEP, FILTERS).max(1)
    return np.maximum(tops, 0)


def slices_of(model: dict, padded: np.ndarray, half_at: np.ndarray) -> Iterator[np.ndarray]:
    """Filter responses at all steps of ``padded``, WIDE bytes at a time."""
    ends = half_at[1:] * (HALF // STEP)
    for a in range(0, len(padded), WIDE):
        # Some steps more, as windows reach over the cut; their own maxima are not used.
        piece = padded[a : a + WIDE + STEP * BLOCKS]
        steps = min(WIDE, len(padded) - a) // STEP
        inside = ends[(ends > a // STEP) & (ends <= a // STEP + steps)] - a // STEP
        yield respond(model, piece, inside)[:steps]


def combine(model: dict, halves: np.ndarray, half_at: np.ndarray) -> np.ndarray:
    """Probability of each row from the maxima of its halves; chunks are neighbouring halves."""
    chunks = np.maximum(halves[:-1], halves[1:])
    # The pair that spans two rows is no chunk: it is made neutral for each reduction.
    last = half_at[1:-1] - 1
    first = half_at[:-1]
    sums, low, high = chunks.copy(), chunks.copy(), chunks
    sums[last], low[last] = 0, np.inf
    high = chunks.copy()
    high[last] = -np.inf
    n = (np.diff(half_at) - 1)[:, None]
    features = np.hstack(
        [np.add.reduceat(sums, first) / n, np.maximum.reduceat(high, first), np.minimum.reduceat(low, first)]
    )
    z = np.maximum(features @ model["hidden"] + model["hidden_bias"], 0) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(model: dict, column: pa.Array) -> np.ndarray:
    """Probability of each whole text of a column; null is scored as an empty text."""
    out = np.empty(len(column))
    for first, data, at in slices(column):
        padded, half_at = layout(at, data)
        halves = np.vstack([pool(part) for part in slices_of(model, padded, half_at)])
        out[first : first + len(at) - 1] = combine(model, halves, half_at)
    return out


WIDE = HALF * 256


def new_model(seed: int) -> dict:
    r = np.random.default_rng(seed)
    draw = lambda *shape, by: (r.normal(size=shape) / np.sqrt(by)).astype(np.float32)
    return {
        "bytes": draw(256, DIM, by=1),
        "filters": draw(STEP * DIM, BLOCKS * FILTERS, by=STEP * DIM * BLOCKS),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": draw(3 * FILTERS, 16, by=3 * FILTERS),
        "hidden_bias": np.zeros(16, np.float32),
        "out": draw(16, by=16),
        "out_bias": np.zeros(1, np.float32),
    }


def gradients(model: dict, padded: np.ndarray, half_at: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy of whole rows.

    Responses are looked at in slices. Of each half chunk only the maxima and their
    places are kept, as nothing else has a gradient.
    """
    rows, f, steps = len(y), FILTERS, HALF // STEP
    best, tops = [], []
    for part in slices_of(model, padded, half_at):
        part = part.reshape(-1, steps, f)
        best.append(part.argmax(1))
        tops.append(np.maximum(np.take_along_axis(part, best[-1][:, None], 1)[:, 0], 0))
    best, tops = np.vstack(best), np.vstack(tops)
    left = tops[:-1] >= tops[1:]
    chunks = np.where(left, tops[:-1], tops[1:])
    # A row's chunks are those that do not span its end.
    own = list(zip(half_at[:-1].tolist(), (half_at[1:] - 1).tolist(), strict=True))
    high = np.stack([a + chunks[a:b].argmax(0) for a, b in own])
    low = np.stack([a + chunks[a:b].argmin(0) for a, b in own])
    c = np.arange(f)[None]
    features = np.hstack([np.stack([chunks[a:b].mean(0) for a, b in own]), chunks[high, c], chunks[low, c]])
    inner = features @ model["hidden"] + model["hidden_bias"]
    act = np.maximum(inner, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ model["out"] + model["out_bias"], -30, 30)))
    dz = ((p - y) / rows).astype(np.float32)
    d_inner = np.outer(dz, model["out"]) * (inner > 0)
    d_features = d_inner @ model["hidden"].T
    d_chunks = np.zeros_like(chunks)
    for k, (a, b) in enumerate(own):
        d_chunks[a:b] = d_features[k, :f] / (b - a)
    d_chunks[high, c] += d_features[:, f : 2 * f]
    d_chunks[low, c] += d_features[:, 2 * f :]
    d_tops = np.zeros_like(tops)
    d_tops[:-1] += d_chunks * left
    d_tops[1:] += d_chunks * ~left
    d_tops = d_tops * (tops > 0)
    d_filters, d_bytes = np.zeros_like(model["filters"]), np.zeros_like(model["bytes"])
    per = WIDE // HALF
    for a in range(0, len(best), per):
        part = padded[a * HALF : (a + per) * HALF + STEP * BLOCKS]
        pass_back(model, part, best[a : a + per], d_tops[a : a + per], d_filters, d_bytes)
    return {
        "bytes": d_bytes,
        "filters": d_filters,
        "bias": d_tops.sum(0),
        "hidden": features.T @ d_inner,
        "hidden_bias": d_inner.sum(0),
        "out": act.T @ dz,
        "out_bias": dz.sum(keepdims=True),
    }


def pass_back(
    model: dict, padded: np.ndarray, best: np.ndarray, d_tops: np.ndarray, d_filters: np.ndarray, d_bytes: np.ndarray
) -> None:
    """Adds what each maximum passes to the window it came from to both gradients."""
    f, steps = FILTERS, HALF // STEP
    at = (np.arange(len(best))[:, None] * steps + best).ravel()
    which = np.tile(np.arange(f), len(best))
    d = d_tops.ravel()
    use = d != 0
    at, which, d = at[use], which[use], d[use]
    x = model["bytes"][padded].reshape(-1, STEP * DIM)
    steps_of = padded.reshape(-1, STEP)
    for k in range(BLOCKS):
        inside = at + k < len(x)
        a, w, g = at[inside] + k, which[inside], d[inside]
        weights = np.zeros((len(a), f), np.float32)
        weights[np.arange(len(a)), w] = g
        part = slice(k * f, (k + 1) * f)
        d_filters[:, part] += x[a].T @ weights
        back = (weights @ model["filters"][:, part].T).reshape(-1, DIM)
        b = steps_of[a].ravel()
        for j in range(DIM):
            d_bytes[:, j] += np.bincount(b, back[:, j], 256)


def fit(texts: list[bytes], y: np.ndarray, how: Training) -> dict:
    """A model for the labels ``y`` (0 or 1) of whole ``texts``; without any, an untrained one."""
    model = new_model(how.seed)
    if not len(texts):
        return model
    r = np.random.default_rng(how.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    order = np.zeros(0, int)
    for t in range(1, how.steps + 1):
        while len(order) < how.batch:
            order = np.append(order, r.permutation(len(texts)))
        batch, order = order[: how.batch], order[how.batch :]
        rows = [texts[k] for k in batch]
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        padded, half_at = layout(at, np.frombuffer(b"".join(rows), np.uint8))
        g = gradients(model, padded, half_at, y[batch].astype(np.float32))
        rate = np.float32(how.rate * (1 - t / (how.steps + 1)))
        for k, v in g.items():
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            update = (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            model[k] = (model[k] - rate * update).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[list[bytes], np.ndarray]:
    """The sample: at most ``how.documents`` whole labelled texts of ``how.bytes`` in all, by a hash of their ids.

    Ids are chosen first and alone, then their texts' sizes are read, and only texts that fit are
    fetched. An id is one example: of several texts the least, of several labels the lower. Rows without
    text or with a null label are no examples.
    """
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(how.documents)
        .collect()
    )
    texts = docs.filter("text is not null").select(F.col("doc_id").alias("__id"), "text")

    def one_text(ids: list, value: Column) -> dict:
        wanted = docs.sparkSession.createDataFrame([(x,) for x in ids], docs.select(F.col("doc_id").alias("__id")).schema)
        return dict(texts.join(F.broadcast(wanted), "__id").groupBy("__id").agg(F.min("text").alias("text")).select("__id", value).collect())

    sizes = one_text([r["__id"] for r in chosen], F.octet_length("text"))
    fits, left = {}, how.bytes
    for r in chosen:
        if sizes.get(r["__id"], left + 1) <= left:
            fits[r["__id"]] = r["__quality"]
            left -= sizes[r["__id"]]
    found = one_text(list(fits), F.col("text"))
    return [found[k].encode() for k in fits], np.array(list(fits.values()), np.float32)


def held_out_column(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def score_quality(docs: DataFrame, labels: DataFrame, how: Training = Training(), threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (probability that ``quality`` is 1) and ``predicted`` (0 or 1).

    Learns from the rows of ``labels`` ``(doc_id, quality)`` that are passed in; of
    labels of one id that differ the lower counts.
    Only the text is scored; null and empty texts get the score of an empty
    text. Columns of ``docs`` named ``score`` or ``predicted`` are replaced.
    Repeated rows are each scored, the same text always alike.
    """
    model = fit(*training_rows(docs, labels, how), how)
    rest = docs.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(score_texts(model, batch.column("text"))))

    out = rest.mapInArrow(scored, rest.select("*", F.lit(0.0).alias("score")).schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = held_out_column()
    return score_quality(docs, labels.filter(~held)).select(
        "doc_id", held.alias("held_out"), "score", "predicted"
    )


ship(__name__)
