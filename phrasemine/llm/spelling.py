"""Spelling variants: words one letter apart, found in a trie of letter counts.

A word's vector has how often it has each common letter, and then each of four groups of all others. The trie arranges
words by one count after the other. Words that differ by one inserted, deleted or replaced letter have vectors that differ by a
surplus of one and a deficit of one at most; a depth-first search spends
this budget, and compares the letters of the words in the leaves it reaches.

The trie's top, cut where no more than some thousands of words hang on a node, is known to all tasks. There, words
learn which of the cut nodes their search enters, and go to the tasks that have these nodes' words.
All queries of a node are searched together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.shipping import ship
from phrasemine.plans.stage import stage

COMMON = "etaoinsrhdlu"
OTHERS = 4
GROUPS = len(COMMON) + OTHERS
TOP = 15  # larger counts are cut to this, so that a count is a hexadecimal digit
NODE = 4096  # words below which a node is not divided among tasks
NODES = 4096  # and no node has less than this part of all words divided
FEW = 8  # words that are looked at together at the end of a search
PAIRS = 1 << 15
WIDE = 64  # letters beyond which words are compared one pair at a time
HELD = 1 << 19  # words that a task counts before it passes them on

RUN = re.compile("[a-zÀ-ÿ]+")


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the number of each word's."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts, a row for each word."""
    codes, sizes = letters(words)
    group = len(COMMON) + (codes % OTHERS).astype(np.int64)
    for k, c in enumerate(COMMON):
        group[codes == ord(c)] = k
    flat = np.repeat(np.arange(len(words)) * GROUPS, sizes) + group
    counts = np.bincount(flat, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.minimum(counts, TOP).astype(np.int8)


def search(
    rows: np.ndarray, depth: np.ndarray, queries: np.ndarray, found: Callable[[np.ndarray, np.ndarray], None]
) -> None:
    """Depth-first search of all ``queries`` in the trie of the sorted vectors ``rows``, each known to its ``depth``.

    ``found`` gets places in ``rows`` and ``queries`` that are a surplus of one and a deficit of one apart at most.
    """
    if not len(rows) or not len(queries):
        return
    none = np.zeros(len(queries), np.int8)
    todo = [(0, 0, len(rows), np.arange(len(queries)), none, none)]
    while todo:
        level, low, high, alive, more, less = todo.pop()
        if high - low <= FEW or depth[low] == level:
            to = int(depth[low:high].max())
            for k in range(low, high):
                own = min(to, int(depth[k]))
                apart = rows[k, level:own] - queries[alive, level:own]
                good = (np.maximum(apart, 0).sum(1) + more <= 1) & (np.maximum(-apart, 0).sum(1) + less <= 1)
                if good.any():
                    at = alive[good]
                    found(np.full(len(at), k), at)
            continue
        values, first = np.unique(rows[low:high, level], return_index=True)
        wanted = queries[alive, level]
        for c, a, b in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), high - low], strict=True):
            apart = c - wanted
            good = (apart == 0) | ((apart == 1) & (more == 0)) | ((apart == -1) & (less == 0))
            if good.any():
                spent = apart[good]
                todo.append((level + 1, low + a, low + b, alive[good], more[good] | (spent == 1), less[good] | (spent == -1)))


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Words:
    """Words as rows of a matrix of code points, which are never 0."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, self.sizes = letters(words)
        width = int(min(self.sizes.max(initial=0), WIDE)) + 1
        self.codes = np.zeros((len(words), width), np.uint32)
        ends = np.cumsum(self.sizes)
        column = np.arange(len(codes)) - np.repeat(ends - self.sizes, self.sizes)
        fits = column < width
        self.codes[np.repeat(np.arange(len(words)), self.sizes)[fits], column[fits]] = codes[fits] + 1

    def near(self, other: Words, mine: np.ndarray, its: np.ndarray) -> np.ndarray:
        """Which of the pairs of words at ``mine`` and at ``its`` in ``other`` are one letter apart."""
        width = max(self.codes.shape[1], other.codes.shape[1])
        a, b = (np.pad(x.codes[at], ((0, 0), (0, width - x.codes.shape[1]))) for x, at in ((self, mine), (other, its)))
        longer = self.sizes[mine] - other.sizes[its]
        swap = longer > 0
        a[swap], b[swap] = b[swap], a[swap]
        differ = a != b
        first = differ.argmax(1)
        shifted = a[:, :-1] != b[:, 1:]
        shifted &= np.arange(width - 1) >= first[:, None]
        out = np.where(longer == 0, differ.sum(1) == 1, (np.abs(longer) == 1) & ~shifted.any(1))
        for k in np.flatnonzero(np.maximum(self.sizes[mine], other.sizes[its]) > WIDE).tolist():
            out[k] = one_apart(self.words[mine[k]], other.words[its[k]])
        return out


def hexed(v: np.ndarray) -> list[str]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[v]
    return [x.decode() for x in np.ascontiguousarray(digits).view(f"S{GROUPS}").reshape(-1).tolist()]


def with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield pa.record_batch({"word": batch.column("word"), "n": batch.column("n"), "vector": pa.array(hexed(vectors(words)), pa.string())})


def top_of_trie(words: DataFrame) -> list[tuple[str, int]]:
    """Cut nodes as prefixes of vectors, with their words' number, in order.

    A node with more than NODE words, or a NODES-th of all, is divided. So at each of the GROUPS levels NODES nodes are
    at most, of TOP + 1 children each; there are as many rows for the driver, however many words.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(GROUPS)), lambda k: F.substring("vector", F.lit(1), k))
    counts = stage(words.select(F.explode(prefixes).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "nodes")
    total = counts.filter("node = ''").select("n").first()
    if total is None:
        return []
    most = max(NODE, -(-total["n"] // NODES))
    divided = F.col("n") > most
    inner = counts.filter(divided & (F.length("node") < GROUPS)).select(F.col("node").alias("parent"))
    if total["n"] <= most:
        return [("", total["n"])]
    at_end = F.length("node") == GROUPS
    cut = counts.filter(~divided | at_end).join(
        F.broadcast(inner), F.expr(f"node <> '' and substring(node, 1, length(node) - 1) = parent")
    )
    return sorted((r["node"], r["n"]) for r in cut.select("node", "n").collect())


ROUTED = "leaf int, role int, word string, n long"


def routes(nodes: list[tuple[str, int]]) -> tuple[Callable, int]:
    """Sends each word to its own leaf (role 0) and, as a query (role 1), to all that its search enters.

    Words that share a whole vector beyond a node's size are dealt to several leaves, all of which a query enters.
    """
    most = max(NODE, -(-sum(n for _, n in nodes) // NODES))
    parts = np.array([-(-n // most) for _, n in nodes], np.int64)
    first = np.cumsum(parts) - parts
    depth = np.array([len(p) for p, _ in nodes])
    rows = np.array([[int(c, 16) for c in p.ljust(GROUPS, "0")] for p, _ in nodes], np.int8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            queries, pairs = vectors(words), []
            search(rows, depth, queries, lambda node, query: pairs.append((node, query)))
            node, query = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            within = np.arange(GROUPS) < depth[node][:, None]
            own = ((rows[node] == queries[query]) | ~within).all(1)
            dealt = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            leaves, roles, picks = [], [], []
            for k in range(int(parts.max(initial=0))):
                some = np.flatnonzero(parts[node] > k)
                leaves.append(first[node[some]] + k)
                roles.append(np.ones(len(some), int))
                picks.append(query[some])
            home = node[own]
            leaves.append(first[home] + dealt[query[own]] % parts[home])
            roles.append(np.zeros(len(home), int))
            picks.append(query[own])
            pick = pa.array(np.concatenate(picks))
            yield pa.record_batch(
                {
                    "leaf": pa.array(np.concatenate(leaves), pa.int32()),
                    "role": pa.array(np.concatenate(roles), pa.int32()),
                    "word": batch.column("word").take(pick),
                    "n": batch.column("n").take(pick),
                }
            )

    return work, int(parts.sum())


NEAR = "word string, near long, best struct<less:bigint,word:string>"


def search_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words that each query finds in a leaf: how many, and the most frequent. A leaf's words come before its queries."""
    leaf, held, members = None, [], None
    for batch in batches:
        leaves, roles = (batch.column(c).to_numpy() for c in ("leaf", "role"))
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        edge = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(roles) != 0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(words)], strict=True):
            if a == b:
                continue
            if leaves[a] != leaf:
                leaf, held, members = int(leaves[a]), [], None
            if roles[a] == 0:
                held.append((words[a:b], n[a:b]))
                continue
            if members is None:
                members = Leaf([w for x, _ in held for w in x], np.concatenate([x for _, x in held]))
            yield members.near(words[a:b])


class Leaf:
    """The words of a cut node, as a trie."""

    def __init__(self, words: list[str], n: np.ndarray):
        v = vectors(words)
        order = np.lexsort(v.T[::-1])
        self.rows, self.n = v[order], n[order]
        self.words = Words([words[k] for k in order.tolist()])
        by_rank = sorted(range(len(order)), key=lambda k: (-self.n[k], self.words.words[k]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[by_rank] = np.arange(len(order))
        self.by_rank = by_rank
        self.depth = np.full(len(order), GROUPS)

    def near(self, words: list[str]) -> pa.RecordBatch:
        queries, count = Words(words), np.zeros(len(words), np.int64)
        best = np.full(len(words), len(self.n), np.int64)
        waiting, size = [], 0

        def verify() -> None:
            nonlocal waiting, size
            if waiting:
                mine, its = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for k in range(0, len(mine), PAIRS):
                    m, q = mine[k : k + PAIRS], its[k : k + PAIRS]
                    good = self.words.near(queries, m, q)
                    np.add.at(count, q[good], 1)
                    np.minimum.at(best, q[good], self.rank[m[good]])
                waiting, size = [], 0

        def found(row: np.ndarray, query: np.ndarray) -> None:
            nonlocal size
            waiting.append((row, query))
            size += len(row)
            if size >= PAIRS:
                verify()

        search(self.rows, self.depth, vectors(words), found)
        verify()
        some = np.flatnonzero(count)
        top = [self.by_rank[r] for r in best[some].tolist()]
        kind = pa.struct([("less", pa.int64()), ("word", pa.string())])
        return pa.record_batch(
            {
                "word": pa.array([words[k] for k in some.tolist()], pa.string()),
                "near": pa.array(count[some]),
                "best": pa.array([{"less": -int(self.n[k]), "word": self.words.words[k]} for k in top], kind),
            }
        )


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``words(word, n)``, whose words are distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts
    a word's near words. Its ``form`` is the one of largest n, the smallest of equal ones in code-point order, if that n is ``ratio`` times
    its own at least, else null; ``root`` is where forms lead in the end, the word itself if it has none.
    Empty words count as words. Rows with a null take no part. An empty table gives no rows. Other columns are ignored.
    """
    spark = words.sparkSession
    known = words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null and n is not null")
    known = stage(known.mapInArrow(with_vectors, "word string, n long, vector string"), "words")
    route, leaves = routes(top_of_trie(known))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves // 16)
    routed = known.select("word", "n").mapInArrow(route, ROUTED)
    dealt = routed.repartition(parts, "leaf").sortWithinPartitions("leaf", "role")
    near = dealt.mapInArrow(search_leaves, NEAR).withColumn("n", F.lit(None).cast("long"))
    alone = known.selectExpr("word", "0L as near", "cast(null as struct<less:bigint,word:string>) as best", "n")
    sums = near.unionByName(alone).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")
    )
    often = -F.col("best.less") >= ratio * F.col("n")
    variants = stage(
        sums.select(
            "word", F.when(often, F.col("best.word")).alias("form"), "n", "n_near",
            F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    roots = followed(variants.filter("form is not null").select("word", F.col("form").alias("root")))
    out = variants.join(roots.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """``links(word, root)`` with roots that have no link of their own.

    Each step doubles how far a link leads. A form is ``ratio`` times as frequent as its word, so there
    are no circles, and steps are few.
    """
    links = stage(links, "links")
    while True:
        further = links.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        step = links.join(further, F.col("root") == F.col("__word"), "left")
        links = stage(
            step.select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")),
            "links",
        )
        if not links.filter("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def run_counts(docs: DataFrame, least_letters: int, least: int, every: int) -> DataFrame:
    """``(word, n)`` of the runs of letters in ``docs(doc_id, text)``, some of which lose a letter by a hash of id and run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        long_run = re.compile(f"{RUN.pattern[:-1]}{{{least_letters},}}")

        def counted() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b":" if name is None else b"%d:" % name)
                # Of the bytes, only A-Z are lower-cased.
                for w, n in Counter(long_run.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % every == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least_letters:
                            continue
                    total[w] = total.get(w, 0) + n
                if len(total) >= HELD:
                    yield counted()
                    total = {}
        yield counted()

    found = docs.select("doc_id", "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """A null doc_id has no digits before the colon."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(run_counts(docs, least_letters=6, least=5, every=199))


OP13_SQL = """
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) as c from range(256) r(i)
  )
),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 6 group by all
),
codes as (
  select w, n, flatten(list_transform(
    list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || w, ''), lambda x: cast(ord(x) as bigint)),
    lambda o: case when o < 128 then [o] else [192 + (o >> 6), 128 + (o & 63)] end
  )) as bytes
  from runs
),
hashed as (
  select w, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h
  from codes, crc
),
words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed
  ) where length(word) >= 6 group by word having sum(n) >= 5
),
cuts as (
  select word, n, p, left(word, p) || substr(word, p + 2) as v
  from (select word, n, unnest(range(length(word))) as p from words)
),
pairs as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.p = b.p and a.v = b.v and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.v = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.v = b.word
),
best as (
  select word, count(*) as n_near, max(other_n) as top_n, arg_min(other, (-other_n, encode(other))) as top from pairs group by word
),
forms as (
  select w.word, case when top_n >= 5 * n then top end as form, n, coalesce(n_near, 0) as n_near, case when top_n >= 5 * n then top_n end as form_n
  from words w left join best b on w.word = b.word
),
chain as (
  select word, coalesce(form, word) as root from forms
  union
  select c.word, f.form from chain c join forms f on c.root = f.word where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f
join chain c on f.word = c.word join forms r on c.root = r.word and r.form is null
"""

ship(__name__)
