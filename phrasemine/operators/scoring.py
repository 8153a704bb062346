"""Chunk scores: each chunk against its two halves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemine.functions.association import DEGENERATE_SCORE, chi_square, clamped_cells
from phrasemine.functions.text import (
    chunk_words,
    contiguous_type,
    left_constituent,
    left_word_count,
    right_constituent,
)
from phrasemine.operators.chunks import (
    BEGINS_MANY,
    COMMON_SHARE,
    Layout,
    attach_right,
    cut_windows,
    line_total,
    multi_word,
    note_halves,
    number_lines,
    pair_counts,
    stage_words,
    window_tasks,
)
from phrasemine.operators.lookup import attach, frequent
from phrasemine.plans.stage import stage, stage_by_key
from phrasemine.shapes import UNIGRAM, chunk_shapes, constituent_codes

# Fixed value: chunks that score below this are kept.
CHUNK_THRESHOLD = 7.0
CELLS = ("n11", "n10", "n01", "n00")


def constituents(chunks: DataFrame) -> DataFrame:
    """Add the left and right half of each chunk, cut at the gap, with their types."""
    text, code = F.col("text"), F.col("type")
    left = left_word_count(code)
    return chunks.select(
        "*",
        left_constituent(text, code).alias("left_text"),
        contiguous_type(left).alias("left_type"),
        right_constituent(text, code).alias("right_text"),
        contiguous_type(chunk_words(code) - left).alias("right_type"),
    )


def settle(df: DataFrame, cells: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """``df`` with the given columns computed once and for all.

    A filter on a score would be pushed below the projection that computes the
    cells, with the score spelled out in terms of the counts: every cell is then
    worked out a dozen times per row, in a method too long to be compiled (5
    times slower, measured). Filters do not pass a generator.
    """
    row = F.struct(*[cell.alias(name) for name, cell in cells.items()])
    return df.select(*keep, F.inline(F.array(row)).alias(*cells))


def stage_halves(counts: DataFrame, max_words: int = 2) -> DataFrame:
    """``(text, n)`` of the words and contiguous chunks that can be halves, staged by text.

    Their texts tell their types: as many words as spaces and one. Both lookups read the table
    where it lies; only the chunks move.
    """
    halves = counts.filter(F.col("type").isin(constituent_codes(max_words))).select("text", "n")
    buckets = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_by_key(halves.repartition(buckets, "text"), "halves", ["text"], compression="zstd")


def contingency(
    counts: DataFrame, lines: Column, max_words: int = 2, chunks: DataFrame | None = None
) -> DataFrame:
    """``(text, type, n11, n10, n01, n00)`` of each chunk; ``lines`` is the corpus size.

    ``chunks`` limits the work to some rows of ``counts``. A half that was never
    counted is worth 0. The number of times a half occurs bounds the chunks it
    is a half of, so it is the weight of its key in the lookups.
    """
    cut = (multi_word(counts) if chunks is None else chunks).select("text", "type", "n")
    halves = stage_halves(counts, max_words)
    # Halves are parts of the text, cut where they are compared: a chunk's text moves once a lookup.
    for side, half in (("left", left_constituent), ("right", right_constituent)):
        cut = attach(
            cut, halves, {"half": "text"}, {"n": f"{side}_n"}, weight="n",
            made={"half": half(F.col("text"), F.col("type"))},
        )
    cells = clamped_cells(
        F.col("n"),
        F.coalesce("left_n", F.lit(0)),
        F.coalesce("right_n", F.lit(0)),
        lines,
    )
    return settle(cut, cells, keep=["text", "type"])


def window_contingency(
    lines: DataFrame, max_words: int = 2, max_gap: int = 1, single_occurrences: bool = True, several: bool = False
) -> tuple[DataFrame, Layout]:
    """``(__key, text, type, n11, n10, n01, n00)`` of the chunks of ``lines(line)``, and how the texts are dealt.

    Same cells as those of ``contingency``. The counts of the halves come to the positions of the lines, of which there are
    far fewer than chunks, and go with the windows to the tasks that count the chunks; chunks are neither staged nor
    moved. With ``several``, texts of one type are left out.
    """
    numbered = number_lines(lines)
    words = stage_words(numbered.select("line"))
    shapes = chunk_shapes(max_words, max_gap)
    known = words.filter(F.col("type") == UNIGRAM).select(F.col("text").alias("__begin"), F.col("n").alias("__begin_n"))
    begins = stage(frequent(known, "__begin_n", BEGINS_MANY), "begins")
    positions = known.agg(F.sum("__begin_n")).first()[0] or 0
    layout = Layout(begins, window_tasks(lines, shapes, positions))
    noted = note_halves(numbered, begins, positions, max_words - 1)
    occurrences = cut_windows(
        noted, shapes, begins.select("__begin"), F.col("__words"), positions, notes=F.col("__noted"), parts=layout.parts
    )
    counts = {"n": F.count(F.lit(1)), "left_n": F.first("left_n"), "right_n": F.first("right_n")}
    rows = occurrences.groupBy("__key", "text", "type").agg(*[count.alias(name) for name, count in counts.items()])
    if several:
        rows = rows.withColumn("__types", F.count(F.lit(1)).over(W.partitionBy("__key", "text"))).filter("__types > 1")
    if not single_occurrences:
        rows = rows.filter("n <> 1")
    cells = clamped_cells(F.col("n"), F.col("left_n"), F.col("right_n"), line_total(words))
    return settle(rows, cells, keep=["__key", "text", "type"]), layout


def pair_contingency(
    lines: DataFrame,
    max_gap: int = 1,
    single_occurrences: bool = True,
    below: float | None = None,
    several: bool = False,
    degenerate: float = DEGENERATE_SCORE,
) -> DataFrame:
    """``(text, type, n11, n10, n01, n00, types)`` of the chunks of two words of ``lines(line)``.

    Same cells as those of ``contingency``; ``types`` is how many types the text was counted under. The
    halves are words: both come to the texts, which are not moved for them unless the second word is rare
    (``pair_counts``, ``attach_right``). With ``several``, texts of one type are left out. With ``below``,
    chunks are left out whose score is not below that, as far as it is known before the rare words are.
    """
    words = stage_words(lines)
    size = line_total(words)
    codes = [shape.code for shape in chunk_shapes(2, max_gap)]
    names = [f"n{code}" for code in codes]
    types = sum((F.col(name).isNotNull().cast("int") for name in names), F.lit(0))
    pairs = pair_counts(lines, words, max_gap).withColumn("types", types)
    if several:
        pairs = pairs.filter("types > 1")
    entries = F.array(*[F.struct(F.lit(code).alias("type"), F.col(name).alias("n")) for code, name in zip(codes, names)])
    rows = pairs.select("text", "left_n", "right_n", "types", F.inline(entries).alias("type", "n")).filter("n is not null")
    if not single_occurrences:
        rows = rows.filter("n <> 1")
    if below is not None:
        total = words.filter(F.col("type") == UNIGRAM).agg(F.sum("n").alias("total")).scalar()
        rows = drop_not_below(rows, F.ceil(total * COMMON_SHARE), size, below, degenerate)
    rows = attach_right(stage(rows, "pairs", compression="zstd"), words)
    cells = clamped_cells(F.col("n"), F.coalesce("left_n", F.lit(0)), F.coalesce("right_n", F.lit(0)), size)
    return settle(rows, cells, keep=["text", "type", "types"]).select("text", "type", *CELLS, "types")


def pair_tables(lines: DataFrame, max_gap: int = 1) -> DataFrame:
    """``(n11, n10, n01, n00)`` of the chunks of ``pair_contingency``, and for each text of several types the sum of its tables.

    No text comes with them, so the sums are taken in the row that has all types of a text, and only second words that are
    not common are staged and moved. Tables may come several times.
    """
    words = stage_words(lines)
    codes = [shape.code for shape in chunk_shapes(2, max_gap)]
    names = [f"n{code}" for code in codes]
    word = F.when(F.col("right_n").isNull(), F.substring_index("text", " ", -1)).alias("text")
    pairs = pair_counts(lines, words, max_gap).select(word, *names, "left_n", "right_n")
    rows = attach_right(stage(pairs, "pairs", compression="zstd"), words)
    left, right = (F.coalesce(side, F.lit(0)) for side in ("left_n", "right_n"))
    size = line_total(words)
    worked = {
        f"{cell}_{name}": column
        for name in names
        for cell, column in clamped_cells(F.col(name), left, right, size).items()
    }
    settled = settle(rows, worked, keep=names)

    def table(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{cell}_{name}").alias(cell) for cell in CELLS]))

    def pooled(cell: str) -> Column:
        return sum((F.when(F.col(name).isNotNull(), F.col(f"{cell}_{name}")).otherwise(0) for name in names), F.lit(0).cast("long"))

    types = sum((F.col(name).isNotNull().cast("int") for name in names), F.lit(0))
    total = F.when(types > 1, F.struct(*[pooled(cell).alias(cell) for cell in CELLS]))
    return settled.select(F.inline(F.array(*map(table, names), total)).alias(*CELLS)).filter("n11 is not null")


def drop_not_below(rows: DataFrame, most: Column, lines: Column, below: float, degenerate: float) -> DataFrame:
    """``rows`` without those whose score cannot be below a threshold; ``right_n`` is ``most`` at most where it is null.

    While ``left * right < n * lines`` and ``right`` is no more than half of the lines, the score falls as ``right`` grows,
    so it is at least that with ``most``. Where this does not hold, or a count is beyond the lines, a row stays.
    """
    n, left, right = F.col("n"), F.coalesce("left_n", F.lit(0)), F.coalesce("right_n", most)
    known = F.col("right_n").isNotNull()
    falling = (most * 2 <= lines) & (left.cast("double") * most < n.cast("double") * lines)
    told = falling & (n <= most) & (n <= left) & (left < lines)
    worked = {**clamped_cells(n, left, right, lines), "__known": known, "__told": known | told}
    scored = settle(rows, worked, keep=rows.columns)
    limit = F.when(F.col("__known"), F.lit(below)).otherwise(F.lit(below * (1 + 1e-9)))
    least = chi_square(*map(F.col, CELLS), degenerate=degenerate)
    return scored.filter(~F.col("__told") | (least < limit)).select(*rows.columns)


def score(cells: DataFrame, degenerate: float = DEGENERATE_SCORE) -> DataFrame:
    """Add ``chi2`` to a frame with the four cells."""
    return cells.withColumn("chi2", chi_square(*map(F.col, CELLS), degenerate=degenerate))


def keep_chunks(scored: DataFrame, threshold: float = CHUNK_THRESHOLD) -> DataFrame:
    """Chunks whose halves are no more than weakly associated (strictly below the threshold)."""
    return scored.filter(F.col("chi2") < threshold)
