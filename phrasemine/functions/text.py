"""Column functions on lines, tokens and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(line: Column) -> Column:
    """Parts of a line between single spaces, empty parts included."""
    return F.split(line, " ", -1)


def tokenize(line: Column) -> Column:
    """Tokens of a line: cut at U+0020 only, empty tokens dropped."""
    return F.array_remove(pieces(line), "")


def chunk_words(code: Column) -> Column:
    """Number of words of a chunk, from its type code (0 stands for one word)."""
    return F.when(code == 0, 1).otherwise((code / 100).cast("int"))


def left_word_count(code: Column) -> Column:
    words = chunk_words(code)
    gap = (code % 100 / 10).cast("int")
    variant = code % 10
    return F.when((words == 3) & (gap > 0), 2 - variant).otherwise(variant + 1)


def contiguous_type(words: Column) -> Column:
    return F.when(words == 1, 0).otherwise(words * 100)


def left_constituent(text: Column, code: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(" "), left_word_count(code))


def right_constituent(text: Column, code: Column) -> Column:
    right = chunk_words(code) - left_word_count(code)
    return F.call_function("substring_index", text, F.lit(" "), -right)


def chunk_key(text: Column, code: Column) -> Column:
    """The ``text@type`` form used by the text sinks and for breaking ties."""
    return F.concat(text, F.lit("@"), code.cast("string"))
