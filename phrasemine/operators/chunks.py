"""Chunk extraction and counting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemine.functions.text import tokenize
from phrasemine.operators.lookup import frequent
from phrasemine.plans.stage import stage, stage_by_key
from phrasemine.shapes import UNIGRAM, Shape, all_shapes, chunk_shapes

# Type of the rows that count lines; chunk types are not negative.
LINES = -1
# A word with more than this share of all words is looked up in a broadcast, of at most one row in as many words.
COMMON_SHARE = 2e-6
# From this many shapes of several words on, windows are shuffled in place of their chunks.
MANY_SHAPES = 2
# Share of the lines in which words that begin very many windows are looked for, and how frequent such words are.
LOOKED_AT, BEGINS_MANY = 0.02, 1e-3
# Occurrences of chunks that a task counts, about, so that its table of counts fits into memory.
A_TASK = 1 << 22


def emit_chunks(
    lines: DataFrame,
    shapes: Sequence[Shape],
    words: Column | None = None,
    keep: Sequence[str] = (),
    mark_lines: bool = False,
) -> DataFrame:
    """One row ``(keep..., text, type)`` per occurrence of every shape in every line.

    ``words`` is the array to slide over, by default the tokens of ``line``. A
    null element breaks every window that would use it.

    Two generators in a row do all shapes in one pass over the line: the first
    lays the array beside its own shifted copies, so that each position becomes
    a row holding its whole window, and the second picks the tokens of each
    shape from that window. Shifts run out into nulls at the end of the line,
    which null the chunk text. All of it stays in generated code.

    With ``mark_lines`` each line, blank ones too, adds one row of type ``LINES``
    with an empty text, so that one pass counts chunks and lines.
    """
    span = max(shape.span for shape in shapes)
    window = [f"__w{k}" for k in range(span)]
    arrays = lines.select(
        *keep, (tokenize(F.col("line")) if words is None else words).alias("__words")
    )
    shifted = [F.col("__words")] + [
        F.slice("__words", k + 1, F.size("__words")) for k in range(1, span)
    ]
    if mark_lines:
        # True at the first position; a line without any still gives a row, of nulls.
        size = F.greatest(F.size("__words"), F.lit(1)) - 1
        shifted.append(F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), size)))
        positions = arrays.select(*keep, F.inline_outer(F.arrays_zip(*shifted)).alias(*window, "__first"))
    else:
        positions = arrays.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*window))

    def chunk(shape: Shape) -> Column:
        parts: list[Column] = []
        for offset in shape.offsets:
            parts += [F.lit(" "), F.col(window[offset])]
        return F.struct(F.concat(*parts[1:]).alias("text"), F.lit(shape.code).alias("type"))

    rows = [chunk(shape) for shape in shapes]
    if mark_lines:
        mark = F.when(F.coalesce("__first", F.lit(True)), F.lit(""))
        rows.append(F.struct(mark.alias("text"), F.lit(LINES).alias("type")))
    chunks = positions.select(*keep, F.inline(F.array(*rows)).alias("text", "type"))
    return chunks.filter(F.col("text").isNotNull())


def extract_chunks(lines: DataFrame, max_words: int = 2, max_gap: int = 1) -> DataFrame:
    """Every word and every chunk occurrence of ``lines(line)``, duplicates kept."""
    return emit_chunks(lines, all_shapes(max_words, max_gap))


def count_shapes(
    lines: DataFrame,
    shapes: Sequence[Shape],
    words: Column | None = None,
    copies: str | None = None,
    mark_lines: bool = False,
) -> DataFrame:
    """Occurrences of the given shapes.

    ``copies`` names a column that says how many times each line stands for. Words, lines and a few shapes
    are combined before the shuffle; many shapes are counted by ``count_windows``.
    """
    wide = [shape for shape in shapes if shape.words > 1]
    if len(wide) >= MANY_SHAPES:
        counted = count_windows(lines, wide, words, copies)
        rest = [shape for shape in shapes if shape.words == 1]
        if not rest:
            return counted
        return counted.unionByName(count_shapes(lines, rest, words, copies, mark_lines))
    occurrence = F.count(F.lit(1)) if copies is None else F.sum(copies)
    return (
        emit_chunks(lines, shapes, words, [copies] if copies else [], mark_lines)
        .groupBy("text", "type")
        .agg(occurrence.alias("n"))
    )


def count_windows(
    lines: DataFrame, shapes: Sequence[Shape], words: Column | None = None, copies: str | None = None
) -> DataFrame:
    """``count_shapes`` for shapes of two words or more, by one shuffled row a position.

    Most chunks come once, so combining them first saves little and costs a great table in each task. All chunks
    of a position begin with its word: the whole window goes to the task of that word, and is cut into
    chunks there. Words that begin many windows, as a part of the lines tells, are
    dealt by their pair with the second word of the chunk, in one row for each place
    that it can have. Which words are dealt so changes no count.
    """
    token = tokenize(F.col("line")) if words is None else words
    sample = lines.sample(LOOKED_AT, seed=1).select(F.explode(token).alias("__begin"))
    begun = stage(sample.groupBy("__begin").agg(F.count(F.lit(1)).alias("__uses")), "begun")
    positions = (begun.agg(F.sum("__uses")).first()[0] or 0) / LOOKED_AT
    begins = frequent(begun, "__uses", BEGINS_MANY).filter("__begin is not null").select("__begin")
    occurrence = F.count(F.lit(1)) if copies is None else F.sum(copies)
    keep = [] if copies is None else [copies]
    if any(shape.words > 2 for shape in shapes):
        cut = cut_windows(lines, shapes, begins, token, positions, keep)
        return cut.groupBy("__key", "text", "type").agg(occurrence.alias("n")).drop("__key")
    cut = cut_windows(lines, shapes, begins, token, positions, keep, rare=True)
    counted = cut.groupBy("__key", "text", "type").agg(occurrence.alias("n")).drop("__key")
    often = begun_chunks(lines, shapes, begins, token, keep)
    return counted.unionByName(often.groupBy("text", "type").agg(occurrence.alias("n")))


def begun_chunks(
    lines: DataFrame, shapes: Sequence[Shape], begins: DataFrame, token: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """``(keep..., text, type)`` of every occurrence of two words whose first is in ``begins(__begin)``.

    Pairs with a frequent word come often, so unlike others they are worth combining before their shuffle.
    """
    offsets = [shape.offsets[1] for shape in shapes]
    arrays = lines.select(*keep, token.alias("__words"))
    names = ["__w0", *[f"__w{k}" for k in offsets]]
    shifted = [F.col("__words"), *[F.slice("__words", k + 1, F.size("__words")) for k in offsets]]
    placed = arrays.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*names))
    pairs = F.array(*[
        F.struct(F.concat("__w0", F.lit(" "), F.col(f"__w{k}")).alias("text"), F.lit(shape.code).alias("type"))
        for k, shape in zip(offsets, shapes)
    ])
    return (
        placed.join(F.broadcast(begins), F.col("__w0") == F.col("__begin"))
        .select(*keep, F.inline(pairs).alias("text", "type"))
        .filter(F.col("text").isNotNull())
    )


def cut_windows(
    lines: DataFrame,
    shapes: Sequence[Shape],
    begins: DataFrame,
    token: Column,
    positions: float,
    keep: Sequence[str] = (),
    notes: Column | None = None,
    parts: int | None = None,
    rare: bool = False,
) -> DataFrame:
    """``(keep..., __key, text, type)`` of every chunk occurrence, in the task of its ``__key``.

    The key is the chunk's first word, or if ``begins(__begin)`` has that, a line feed, the first
    word, a space and the second word, which no word equals. It is cut from the window on both sides of
    the shuffle and not moved itself. All chunks of one text have one key. ``positions``, the number of
    words or about that, sets the number of tasks, so that a task's share does not grow with the lines; or ``parts``
    does, for frames that shall lie alike. With ``rare``, chunks whose first word is in ``begins`` are left to ``begun_chunks``.

    With ``notes``, an array beside the words as ``note_halves`` makes it, ``left_n`` and ``right_n`` come along: how often
    the halves of the chunk occur.
    """
    span = max(shape.span for shape in shapes)
    runs = max(shape.words for shape in shapes) - 1
    window = [f"__w{k}" for k in range(span)]
    noted = [] if notes is None else [f"__c{k}" for k in range(span)]
    arrays = lines.select(*keep, token.alias("__words"), *([] if notes is None else [notes.alias("__noted")]))
    shifted = [
        F.col(array) if k == 0 else F.slice(array, k + 1, F.size(array))
        for array, columns in (("__words", window), ("__noted", noted))
        for k in range(len(columns))
    ]
    placed = arrays.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*window, *noted)).filter("__w0 is not null")

    def joined(used: set[int]) -> Column:
        """The words at these places as one text; a null is an empty word, words themselves are not empty."""
        fields: list[Column] = []
        for k in range(span if noted else max(used) + 1):
            fields += [F.lit(" "), F.coalesce(window[k], F.lit("")) if k in used else F.lit("")]
        if noted:
            fields.append(F.lit(" "))
            for k in range(max(used) + 1):
                blank = F.lit("," * (runs - 1))
                fields += [F.lit(","), F.coalesce(noted[k], blank) if k in used else blank]
            del fields[2 * span + 1]
        return F.concat(*fields[1:]).alias("window")

    def places(some: Sequence[Shape]) -> set[int]:
        return {offset for shape in some for offset in shape.offsets}

    seconds = sorted({shape.offsets[1] for shape in shapes})
    alone = F.struct(F.lit(0).alias("second"), joined(places(shapes)))
    paired = [
        F.struct(F.lit(k).alias("second"), joined(places([shape for shape in shapes if shape.offsets[1] == k])))
        for k in seconds
    ]
    rows = F.array(alone) if rare else F.when(F.col("__begin").isNull(), F.array(alone)).otherwise(F.array(*paired))
    parts = window_tasks(lines, shapes, positions) if parts is None else parts
    first = F.substring_index("__window", " ", 1)
    second = F.get(F.split("__window", " ", -1), F.col("__second"))
    key = F.when(F.col("__second") == 0, first).otherwise(F.concat(F.lit("\n"), first, F.lit(" "), second))
    moved = (
        placed.join(F.broadcast(begins), F.col("__w0") == F.col("__begin"), "left_anti" if rare else "left")
        .select(*keep, F.inline(rows).alias("__second", "__window"))
        .repartition(parts, key)
        .select(*keep, "__second", key.alias("__key"), F.split("__window", " ", -1).alias("__words"))
        # Words are columns before the shapes are made of them, so that the generated method stays short.
        .select(
            *keep, "__second", "__key",
            *[F.nullif(F.get("__words", F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(window)],
            *([] if notes is None else [read_notes(F.get("__words", F.lit(span))).alias("__notes")]),
        )
    )

    def cut(shape: Shape) -> Column:
        texts: list[Column] = []
        for offset in shape.offsets:
            texts += [F.lit(" "), F.col(window[offset])]
        here = F.col("__second").isin(0, shape.offsets[1])
        fields = [F.when(here, F.concat(*texts[1:])).alias("text"), F.lit(shape.code).alias("type")]
        if notes is not None:
            left, right = shape.left_words, shape.words - shape.left_words
            begin = shape.offsets[left]
            fields += [F.lit(left - 1).alias("left"), F.lit(begin * runs + right - 1).alias("right")]
        return F.struct(*fields)

    rows = F.inline(F.array(*map(cut, shapes)))
    if notes is None:
        return moved.select(*keep, "__key", rows.alias("text", "type")).filter(F.col("text").isNotNull())
    occurrences = moved.select(*keep, "__key", "__notes", rows.alias("text", "type", "__left", "__right"))
    return occurrences.filter(F.col("text").isNotNull()).select(
        *keep, "__key", "text", "type",
        F.get("__notes", F.col("__left")).alias("left_n"), F.get("__notes", F.col("__right")).alias("right_n"),
    )


@dataclass(frozen=True)
class Layout:
    """How texts are dealt over ``parts`` tasks: by the first word, or by the first two if the first is in ``begins(__begin)``."""

    begins: DataFrame
    parts: int


def window_tasks(lines: DataFrame, shapes: Sequence[Shape], positions: float) -> int:
    """Number of tasks that chunks of ``positions`` words are counted in."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) * -(-len(shapes) // 9)
    return max(parts, int(positions * len(shapes) / A_TASK) + 1)


def read_notes(field: Column) -> Column:
    """Numbers that ``note_halves`` wrote; an empty one is 1."""
    return F.transform(F.split(field, ",", -1), lambda n: F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(1).cast("long")))


def text_key(text: Column, begin: Column) -> Column:
    """The ``__key`` that ``cut_windows`` gives a text of two words or more; ``begin`` is null unless its first word is in ``begins``."""
    first = F.substring_index(text, " ", 1)
    return F.when(begin.isNull(), first).otherwise(F.concat(F.lit("\n"), F.substring_index(text, " ", 2)))


def number_lines(lines: DataFrame) -> DataFrame:
    """``(__line, line)``: lines with numbers, staged, as numbers must not change when a lost task runs again."""
    return stage(lines.select(F.monotonically_increasing_id().alias("__line"), "line"), "lines")


def note_halves(numbered: DataFrame, begins: DataFrame, positions: float, runs: int) -> DataFrame:
    """``(__words, __noted)`` of each line that has words: its words, and as a text how often what begins there occurs.

    That is the counts of the word and of the contiguous runs of up to ``runs`` words, with commas between and
    nothing for a 1. ``numbered`` comes from ``number_lines``, ``begins(__begin, __begin_n)`` are the words that begin many
    windows, with their counts. A position goes with its run to the task of its word (of its first two words if the first is one
    of ``begins``), where all counts but those of ``begins`` are told, and comes back to its line with them.
    """
    words = [F.slice("__words", k + 1, F.size("__words")) if k else F.col("__words") for k in range(runs)]
    names = [f"__w{k}" for k in range(runs)]
    placed = (
        numbered.select("__line", tokenize(F.col("line")).alias("__words"))
        .select("__line", F.posexplode(F.arrays_zip(*[word.alias(name) for word, name in zip(words, names)])).alias("__at", "__w"))
        .select("__line", "__at", F.concat_ws(" ", *[F.col(f"__w.{name}") for name in names]).alias("__run"))
    )
    first = F.substring_index("__run", " ", 1)
    key = text_key(F.col("__run"), F.col("__begin_n"))
    moved = (
        placed.join(F.broadcast(begins), first == F.col("__begin"), "left")
        .select("__line", "__at", "__run", "__begin_n")
        .repartition(window_tasks(numbered, chunk_shapes(), positions), key)
        .select("__line", "__at", "__run", "__begin_n", key.alias("__key"))
    )
    counts = []
    for k in range(runs, 0, -1):
        # What is shorter than that ends its line, and its count is not asked for.
        parts = [F.substring_index("__run", " ", size).alias(f"__r{size}") for size in range(2, k + 1)]
        moved = moved.withColumn(f"__n{k}", F.count(F.lit(1)).over(W.partitionBy("__key", *parts)))
        counts.insert(0, F.col(f"__n{k}") if k > 1 else F.coalesce("__begin_n", "__n1"))
    note = F.concat_ws(",", *[F.when(n == 1, F.lit("")).otherwise(n.cast("string")) for n in counts])
    return (
        moved.select("__line", F.struct("__at", first.alias("word"), note.alias("note")).alias("__at"))
        .groupBy("__line")
        .agg(F.sort_array(F.collect_list("__at")).alias("__at"))
        .select(F.col("__at.word").alias("__words"), F.col("__at.note").alias("__noted"))
    )


def stage_words(lines: DataFrame) -> DataFrame:
    """``(text, type, n)`` of the words of ``lines(line)`` and of the lines themselves, written once, by text and a folder per type.

    Joins on the text read it where it lies. No word is empty, so the text alone tells the row of the lines.
    """
    counted = emit_chunks(lines, [Shape(1)], mark_lines=True).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("text") == "", LINES).otherwise(UNIGRAM).alias("type")
    return stage_by_key(counted.select("text", code, "n"), "words", ["text"], "zstd", partition_by=["type"])


def pair_counts(lines: DataFrame, words: DataFrame, max_gap: int = 1) -> DataFrame:
    """One row ``(text, n<code>..., left_n, right_n)`` a text of two words, with the counts of its shapes and words.

    A text is counted in the task of its first word, where that word's count comes to it. Common words are
    looked up in a broadcast; ``right_n`` is null where the second word is not common (see ``attach_right``).
    No text moves for either. ``words`` come from ``stage_words`` of the same lines.
    """
    shapes = chunk_shapes(2, max_gap)
    known = words.filter(F.col("type") == UNIGRAM).select(F.col("text").alias("__word"), F.col("n").alias("__n"))
    begins = frequent(known, "__n", BEGINS_MANY).select(F.col("__word").alias("__begin"), F.col("__n").alias("__begin_n"))
    common = common_words(words).select(F.col("text").alias("__common"), F.col("n").alias("right_n"))
    positions = known.agg(F.sum("__n")).first()[0] or 0
    token, begin = tokenize(F.col("line")), begins.select("__begin")
    occurrences = cut_windows(lines, shapes, begin, token, positions, rare=True)
    often = begun_chunks(lines, shapes, begin, token)
    counters = [F.count(F.when(F.col("type") == shape.code, F.lit(1))).alias(f"n{shape.code}") for shape in shapes]
    names = [f"n{shape.code}" for shape in shapes]
    counted = occurrences.groupBy("__key", "text").agg(*counters)
    counted = counted.join(known.hint("shuffle_hash"), F.col("__key") == F.col("__word"), "left")
    often = often.groupBy("text").agg(*counters)
    often = often.join(F.broadcast(begins), F.substring_index("text", " ", 1) == F.col("__begin"), "left")
    return (
        counted.select("text", *names, F.col("__n").alias("left_n"))
        .unionByName(often.select("text", *names, F.col("__begin_n").alias("left_n")))
        .join(F.broadcast(common), F.substring_index("text", " ", -1) == F.col("__common"), "left")
        .select(
            "text",
            *[F.nullif(F.col(f"n{shape.code}"), F.lit(0)).alias(f"n{shape.code}") for shape in shapes],
            "left_n",
            "right_n",
        )
    )


def common_words(words: DataFrame) -> DataFrame:
    """Words with more than ``COMMON_SHARE`` of all occurrences, ``1 / COMMON_SHARE`` at most."""
    return frequent(words.filter(F.col("type") == UNIGRAM), "n", COMMON_SHARE)


def attach_right(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Staged ``pair_counts`` with every ``right_n``: only texts whose second word is not common move."""
    known = words.filter(F.col("type") == UNIGRAM).select(F.col("text").alias("__word"), F.col("n").alias("__n"))
    second = F.substring_index("text", " ", -1) == F.col("__word")
    rest = [c for c in pairs.columns if c != "right_n"]
    found = pairs.filter("right_n is null").select(*rest).join(known, second, "left")
    return pairs.filter("right_n is not null").unionByName(found.select(*rest, F.col("__n").alias("right_n")))


def count_chunks(lines: DataFrame, max_words: int = 2, max_gap: int = 1) -> DataFrame:
    """``(text, type, n)`` for all words and chunks of ``lines(line)``."""
    return count_shapes(lines, all_shapes(max_words, max_gap))


def stage_counts(lines: DataFrame, max_words: int = 2, max_gap: int = 1) -> DataFrame:
    """Counts of ``lines(line)`` and of the lines themselves, written once, one folder per type.

    Scoring reads them as chunks, as left halves and as right halves. With a
    folder per type each of these reads opens only the types it needs.
    """
    counts = count_shapes(lines, all_shapes(max_words, max_gap), mark_lines=True)
    return stage(counts, "counts", partition_by=["type"], compression="zstd")


def line_total(counts: DataFrame) -> Column:
    """The number of lines behind staged counts, as a scalar subquery over their smallest folder."""
    return counts.filter(F.col("type") == LINES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).scalar()


def multi_word(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("type") > UNIGRAM)


def drop_single_occurrences(counts: DataFrame) -> DataFrame:
    """Optional filter: leave out chunks seen only once (words stay, they are margins)."""
    return counts.filter((F.col("type") == UNIGRAM) | (F.col("n") != 1))
