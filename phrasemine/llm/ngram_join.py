"""N-gram Jaccard join: documents linked by a similarity of 0.8 or more of their 5-word shingles.

The search is a T-occurrence search. A document that links with a query of n
shingles shares T = ceil(0.8 n) of them. Its inverted lists are divided: the
longest T - 1 are set aside, so that a partner must occur in one of the n - T + 1
others. These short lists are merged first, by one shuffle on the shingle, with the number
of occurrences that the sizes of both sides ask for; a side may be a group that is known to be
connected. What passes is searched exactly: partners are indexed in chunks,
their short lists are heap-merged, and the long ones are probed by binary search (DivideSkip).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemine.llm.fetch import of_chosen
from phrasemine.llm.graph import components
from phrasemine.llm.shipping import ship
from phrasemine.llm.words import mix, shingle_sets, slices
from phrasemine.plans.stage import stage

BINS = 1 << 21  # bins in which shingles are counted: 8 MB, whatever the corpus
PARTS = 64
BANDS = 8
GROUP = 256  # partners of a query that are indexed together
MU = 0.01  # cost of a probe against a merge step, as in DivideSkip's choice of the long lists


def bin_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(43)).astype(np.int64)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' sets fall in each bin, over all documents.

    Tasks count their own rows, and the counts are summed by part of the bins.
    The driver gets BINS numbers. They only order the shingles, from rare to
    frequent, so bins that several shingles share do no harm.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(BINS, np.int64), [], 0
        for batch in batches:
            for _, data, at in slices(batch.column("text")):
                for s in shingle_sets(data, at, size):
                    waiting.append(s)
                    held += len(s)
                if held > BINS:
                    total += np.bincount(bin_of(np.concatenate(waiting)), minlength=BINS)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(bin_of(np.concatenate(waiting)), minlength=BINS)
        if total.any():
            yield packed(enumerate(total.reshape(PARTS, -1)))

    def packed(parts) -> pa.RecordBatch:
        rows = [(k, x.astype(np.int64 if x.max(initial=0) >> 32 else np.uint32)) for k, x in parts]
        return pa.record_batch(
            {
                "part": pa.array([k for k, _ in rows], pa.int32()),
                "width": pa.array([x.itemsize for _, x in rows], pa.int32()),
                "counts": pa.array([x.tobytes() for _, x in rows], pa.binary()),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, width, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(k, np.zeros(BINS // PARTS, np.int64))
                sums[k] += np.frombuffer(x, np.uint32 if width == 4 else np.int64)
        if sums:
            yield packed(sums.items())

    schema = "part int, width int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema)
    out = np.zeros((PARTS, BINS // PARTS), np.int64)
    for row in summed.collect():
        out[row["part"]] += np.frombuffer(row["counts"], np.uint32 if row["width"] == 4 else np.int64)
    return out.ravel()


def list_column(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def bands_of(s: np.ndarray) -> np.ndarray:
    """BANDS hashes of the three smallest of a set under different orders."""
    out = np.empty(BANDS, np.uint64)
    for k in range(BANDS):
        x = mix(s + np.uint64(0xBF58476D1CE4E5B9 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        out[k] = np.sort(x[: len(x)] if len(x) <= 3 else np.partition(x, 2)[:3]).dot(
            np.array([3, 5, 7], np.uint64)[: min(3, len(x))]
        ) + np.uint64(k)
    return out


def describe(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """``(doc_id, n, d1, d2, bands, prefix, common)`` of each document.

    ``prefix`` has the shingles of the n - T + 1 short lists: those of the
    rarest bins, ties by hash. ``common`` is how often its shingles occur, on average.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = (
        "doc_id long, n long, d1 long, d2 long, bands array<long>, prefix array<long>, common double"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bin = shared.value
        for batch in batches:
            for first, data, at in slices(batch.column("text")):
                n, d, bands, prefix, common = [], [], [], [], []
                for s in shingle_sets(data, at, size):
                    n.append(len(s))
                    d.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                    if not len(s):
                        bands.append(s)
                        prefix.append(s)
                        common.append(0.0)
                        continue
                    often = by_bin[bin_of(s)]
                    order = np.argsort(often, kind="stable")[: len(s) - (percent * len(s) + 99) // 100 + 1]
                    bands.append(bands_of(s))
                    prefix.append(s[order])
                    common.append(float(often.mean()))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, len(n)).cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(np.array([x & 0xFFFFFFFFFFFFFFFF for x in d], np.uint64).view(np.int64)),
                        pa.array(np.array([x >> 64 for x in d], np.uint64).view(np.int64)),
                        list_column(bands),
                        list_column(prefix),
                        pa.array(common, pa.float64()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "bands", "prefix", "common"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def needed(a, b, percent: int):
    """Least overlap of sets of ``a`` and ``b`` shingles that link; for columns and numbers."""
    return (percent * (a + b) + 99 + percent) // (100 + percent) if isinstance(a, int) else F.ceil(
        percent * (a + b) / F.lit(100 + percent) - 1e-9
    )


def build_index(sets: list[np.ndarray]) -> tuple:
    """Inverted lists of some sets: shingles in order, whose they are, and the sets themselves."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    return tokens[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], sets


def divide_skip(query: np.ndarray, index: tuple, percent: int) -> list[int]:
    """Which of the indexed sets link with ``query``; all are sorted arrays.

    Heap-merges the short inverted lists, and probes the long ones for the sets
    that occur often enough in the short ones.
    """
    tokens, owner, sets = index
    need = [needed(len(query), len(s), percent) for s in sets]
    low, high = np.searchsorted(tokens, query), np.searchsorted(tokens, query, "right")
    length = high - low
    least = min(need)
    aside = min(least - 1, int(least / (MU * np.log2(max(2, length.max(initial=1))) + 1)))
    by_length = np.argsort(length, kind="stable")
    short, long = by_length[: len(query) - aside], by_length[len(query) - aside :]
    lists = [owner[low[k] : high[k]].tolist() for k in short.tolist() if length[k]]
    probes = query[np.sort(long)]
    linked = []
    for who, seen in groupby(heapq.merge(*lists)):
        often = sum(1 for _ in seen)
        if often < need[who] - aside:
            continue
        s = sets[who]
        place = np.minimum(np.searchsorted(s, probes), len(s) - 1)
        if often + int((s[place] == probes).sum()) >= need[who]:
            linked.append(who)
    return linked


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(doc_id, shingles)`` of the documents in ``ids(id)``, made anew from their texts."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [s.tobytes() for _, data, at in slices(batch.column("text")) for s in shingle_sets(data, at, size)]
        return pa.record_batch(
            {"doc_id": batch.column("doc_id").cast(pa.int64()), "shingles": pa.array(made, pa.binary())}
        )

    return stage(of_chosen(docs, ids, "id", sets, "doc_id long, shingles binary"), "sets")


def searched(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` that link, among the rows of each ``(key, chunk)``.

    ``rows(key, chunk, asks, id, shingles)``: those that do not ask are indexed, GROUP
    at most, and come first; then each that asks is searched for.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who, sets, index = None, [], [], None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for group, chunk, asks, own, raw in zip(*columns, batch.column(4), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if (group, chunk) != key:
                    key, who, sets, index = (group, chunk), [], [], None
                if not asks:
                    who.append(own)
                    sets.append(s)
                elif sets:
                    index = index or build_index(sets)
                    found = divide_skip(s, index, percent)
                    a += [own] * len(found)
                    b += [who[k] for k in found]
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asks", "id")
    return dealt.mapInArrow(search, "a long, b long")


def chunk_of(column: str, many: str) -> Column:
    return F.pmod(F.xxhash64(column), F.ceil(F.col(many) / GROUP)).cast("int").alias("chunk")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that link: ``a`` is searched for among its partners, GROUP at a time."""
    found = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size)
    many = pairs.groupBy("a").agg(F.count("*").alias("__n"))
    dealt = pairs.join(many, "a").select("a", "b", chunk_of("b", "__n"))
    asked = dealt.select("a", "chunk").distinct().join(found, F.col("a") == F.col("doc_id"))
    given = dealt.join(found, F.col("b") == F.col("doc_id"))
    rows = given.select(F.col("a").alias("key"), "chunk", F.lit(0).alias("asks"), F.col("b").alias("id"), "shingles")
    asking = asked.select(F.col("a").alias("key"), "chunk", F.lit(1).alias("asks"), F.col("a").alias("id"), "shingles")
    return searched(rows.unionAll(asking), percent)


def verified_groups(
    asked: DataFrame, members: DataFrame, docs: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links of each ``rep`` with the members of the component ``other`` of ``asked(rep, other, size)``.

    ``members`` is ``(rep, component)``. A component is cut into chunks of GROUP
    members or so; each is indexed once, for all that ask for it.
    """
    groups = asked.select(F.col("other").alias("component"), "size").distinct()
    dealt = members.join(groups, "component").select("component", "rep", chunk_of("rep", "size"))
    dealt = stage(dealt, "members")
    ids = dealt.select(F.col("rep").alias("id")).unionAll(asked.select(F.col("rep").alias("id"))).distinct()
    found = sets_of(docs, ids, size)
    chunks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / GROUP).cast("int") - 1)).alias("chunk")
    rows = dealt.join(found, F.col("rep") == F.col("doc_id")).select(
        F.col("component").alias("key"), "chunk", F.lit(0).alias("asks"), F.col("rep").alias("id"), "shingles"
    )
    asking = (
        asked.join(found, F.col("rep") == F.col("doc_id"))
        .select("other", chunks, "rep", "shingles")
        .select(F.col("other").alias("key"), "chunk", F.lit(1).alias("asks"), F.col("rep").alias("id"), "shingles")
    )
    return searched(rows.unionAll(asking), percent)


def stars(known: DataFrame, now: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most one partner ``(a, b)`` for each document ``b``, out of another component.

    Documents whose smallest shingles agree point to one of them: in the first
    turn to the one whose shingles are the most common, which is what edited copies were
    made from, as edits are rare shingles; then to any. This ties the members of a
    large group to a few, so that the full search need not compare all with all.
    """
    order = F.struct(F.when(F.lit(turn) == 0, -F.col("common")).alias("c"), F.xxhash64("rep", F.lit(turn)).alias("h"))
    rows = (
        known.join(now, "rep").select("rep", "n", "component", F.explode("bands").alias("band"), order.alias("o"))
    )
    leader = rows.groupBy("band").agg(F.min(F.struct("o", "rep", "n", "component")).alias("l"))
    apart = rows.join(leader, "band").filter(
        (F.col("component") != F.col("l.component")) & sizes_fit(F.col("n"), F.col("l.n"), percent)
    )
    chosen = apart.groupBy("rep").agg(F.min(F.struct("l.o", "l.rep")).alias("l"))
    return chosen.select(F.col("l.rep").alias("a"), F.col("rep").alias("b"))


def current(reps: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """``(rep, component)`` for all ``reps``."""
    if not edges:
        return reps.select("rep", F.col("rep").alias("component"))
    all_edges = edges[0]
    for more in edges[1:]:
        all_edges = all_edges.unionAll(more)
    found = components(all_edges).withColumnRenamed("id", "rep")
    return stage(
        reps.select("rep").join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")),
        "components",
    )


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs`` ``(doc_id, text)``.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets; a component is what links reach, named by its smallest
    ``doc_id``. Null, empty and blank texts have no shingles and link with
    nothing. Documents with equal sets are one class, searched once. Rows with a
    null ``doc_id`` are in their class's component, null if it has no id.
    Repeated rows are returned as often as they come. Other columns are ignored.
    """
    described = stage(describe(docs, shingle_counts(docs, size), size, percent), "described")
    classes = described.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes, "classes")
    one = described.select("d1", "d2", F.col("doc_id").alias("rep"), "n", "bands", "prefix", "common")
    known = stage(one.join(classes, ["d1", "d2", "rep"]).dropDuplicates(["d1", "d2"]).drop("d1", "d2"), "known")
    reps = known.select("rep").distinct()

    edges: list[DataFrame] = []
    now = current(reps, edges)
    for turn in range(rounds):
        tied = stage(verified(stage(stars(known, now, turn, percent), "stars"), docs, size, percent), "edges")
        edges.append(tied)
        now = current(reps, edges)

    # Short lists: a shingle whose documents are all in one component has nothing to add. A
    # document asks for the components that are larger than its own, each as a whole.
    groups = stage(
        known.join(now, "rep")
        .groupBy("component")
        .agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most")),
        "groups",
    )
    members = known.join(now, "rep").join(groups.select("component", "size"), "component")
    entries = members.select("rep", "component", "size", F.explode("prefix").alias("shingle"))
    group = Window.partitionBy("shingle")
    mixed = entries.withColumn("mixed", F.min("component").over(group) < F.max("component").over(group))
    lists = stage(mixed.filter("mixed").drop("mixed"), "lists")
    others = lists.select("shingle", F.col("component").alias("other"), F.col("size").alias("other_size")).distinct()
    met = (
        lists.join(others, "shingle")
        .filter(F.struct("other_size", "other") > F.struct("size", "component"))
        .groupBy("rep", "other")
        .agg(F.count("*").alias("often"))
    )
    met = met.join(known.select("rep", "n", F.size("prefix").alias("p")), "rep").join(
        groups.withColumnRenamed("component", "other"), "other"
    )
    # Beyond the earlier of both prefixes' ends, there are no more common shingles than the set-aside
    # lists of that document: of this one, with the smallest partner, or of the largest partner.
    low = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100 - 1e-9))
    high = F.least(F.col("most"), F.col("n") * 100 / percent)
    own = needed(F.col("n"), low, percent) - (F.col("n") - F.col("p"))
    theirs = (F.col("n") + high) * percent / (100 + percent) - high * percent / 100 - 1e-6
    fits = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    asked = stage(met.filter(fits & (F.col("often") >= F.least(own, theirs))).select("rep", "other", "size"), "asked")
    edges.append(stage(verified_groups(asked, now, docs, size, percent), "edges"))

    named = classes.join(current(reps, edges), "rep").select("d1", "d2", "component")
    return described.join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ship(__name__)
