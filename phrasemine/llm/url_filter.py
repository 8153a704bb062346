"""URL filters: a blocked Bloom filter in front of an exact hash join.

A listing has canonical URLs ``host/path``. A listed URL stands for its host,
all subdomains, and all paths that start with its path. So the canonical keys of
a URL are its host's suffixes with its path's prefixes; the filter passes the keys that may
be listed, and a join on the keys removes those it passed by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.shipping import ship
from phrasemine.plans.stage import stage

LINE = 8  # 64-bit words of a block: one cache line
PROBES = 8  # bits set by a key, all in its block
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 20  # 64 MB; a longer listing gives more chance hits, which the join removes
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``.

    Both are empty for null and for URLs without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(1 << 30)), r"^[^?#]*", 0)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def blocks_of(keys: list[str], n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, 64-bit masks of the words of a block) of each key."""
    h = np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    masks = np.zeros((len(keys), LINE), np.uint64)
    rows, x = np.arange(len(keys)), h
    for _ in range(PROBES):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        bit = x >> np.uint64(55)
        masks[rows, (bit >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), masks


def bloom_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Blocked Bloom filter of the distinct keys, made by the tasks: ``(blocks, LINE)`` words.

    The driver gets one row for each block that is in use: MOST_BLOCKS at most.
    """
    count = keys.count()
    n_blocks = max(1, min(MOST_BLOCKS, -(-count * BITS_PER_KEY // (64 * LINE))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, masks = blocks_of(batch.column(0).to_pylist(), n_blocks)
            own, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(own), LINE), np.uint64)
            np.bitwise_or.at(words, at, masks)
            yield pa.record_batch(
                [pa.array(own), *[pa.array(words[:, k].view(np.int64)) for k in range(LINE)]],
                names=["block", *[f"w{k}" for k in range(LINE)]],
            )

    made = keys.select(column).mapInArrow(build, "block long, " + ", ".join(f"w{k} long" for k in range(LINE)))
    out = np.zeros((n_blocks, LINE), np.int64)
    for row in made.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LINE)]).collect():
        out[row["block"]] = row[1:]
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: list[str]) -> np.ndarray:
    block, masks = blocks_of(keys, len(words))
    return ((words[block] & masks) == masks).all(1)


def url_keys(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Keys that would list a URL: suffixes of the host by label with prefixes of the path, of the listed pairs of lengths."""
    keys = []
    for cut, tail in shapes:
        from_label = cut == len(host) or cut < len(host) and host[len(host) - cut - 1] == "."
        if from_label and tail <= len(path):
            keys.append(host[len(host) - cut :] + path[:tail])
    return keys


def listed_urls(pages: DataFrame, listing: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``pages`` with ``rule``, the longest listed URL that covers ``host`` and ``path``, or null, and its ``action``.

    ``listing`` is ``(rule, action)``; a rule is ``host/path``, its host up to
    the first ``/``. Equal rules are one: the one with the least action. A rule fits its host and all
    subdomains if the path starts with the rule's. Ties of length are between
    equal rules only, as a rule that fits is a suffix of the host and a prefix of the path;
    of two rules of the same length the one with the longer host is taken.
    Pages without a host fit no rule. Repeated rows are each judged; columns of ``pages`` with the names of the
    new ones are replaced.
    """
    rules = stage(
        listing.filter("rule is not null")
        .groupBy("rule")
        .agg(F.min("action").alias("action"))
        .withColumn("cut", F.when(F.instr("rule", "/") > 0, F.instr("rule", "/") - 1).otherwise(F.length("rule")))
        .withColumn("tail", F.length("rule") - F.col("cut")),
        "listing",
    )
    # Bounded by the lengths of the longest listed host and path.
    shapes = sorted((row["cut"], row["tail"]) for row in rules.select("cut", "tail").distinct().collect())
    filter_words = pages.sparkSession.sparkContext.broadcast(bloom_filter(rules, "rule"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_words.value
        for batch in batches:
            hosts, paths = batch.column("__host").to_pylist(), batch.column("__path").to_pylist()
            keys = [url_keys(h, p, shapes) if h else [] for h, p in zip(hosts, paths, strict=True)]
            every = [k for own in keys for k in own]
            hit = may_hold(words, every) if every else np.zeros(0, bool)
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            kept = [[every[j] for j in range(a, b) if hit[j]] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield batch.append_column("__keys", pa.array(kept, pa.list_(pa.string())))

    rest = pages.drop("rule", "action")
    urls = rest.filter(F.col(host) != "").select(F.col(host).alias("__host"), F.col(path).alias("__path")).distinct()
    passed = urls.mapInArrow(candidates, "__host string, __path string, __keys array<string>")
    # The exact join: a rule that covers very many URLs is dealt over SALTS tasks.
    keyed = passed.select("__host", "__path", F.explode("__keys").alias("__rule")).withColumn(
        "__salt", F.pmod(F.xxhash64("__host", "__path"), F.lit(SALTS)).cast("int")
    )
    dealt = rules.select(
        F.col("rule").alias("__rule"), "rule", "action", "cut", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    )
    best = F.struct(F.length("rule").alias("length"), "cut", "rule", "action")
    found = (
        keyed.join(dealt, ["__rule", "__salt"])
        .groupBy("__host", "__path")
        .agg(F.max(best).alias("__best"))
        .select("__host", "__path", "__best.rule", "__best.action")
    )
    same = (F.col(host) == F.col("__host")) & (F.col(path) == F.col("__path"))
    return rest.join(found, same, "left").drop("__host", "__path")


#: The rules of the query, as a listing.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UNLISTED = "allow"


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    listing = spark.createDataFrame(RULES, "rule string, action string")
    judged = listed_urls(pages, listing)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(UNLISTED)).alias("verdict"))


OP1_SQL = r"""
WITH rules(rule, action, h, p) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM urls JOIN rules ON starts_with(path, p) AND (host = h OR ends_with(host, '.' || h))
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)
"""


ship(__name__)
