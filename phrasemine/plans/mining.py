"""The three jobs, from corpora to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemine.functions.association import DEGENERATE_SCORE
from phrasemine.operators import groups, scoring, translation
from phrasemine.operators.chunks import Layout, drop_single_occurrences, line_total


def score_corpus(
    lines: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    single_occurrences: bool = True,
    degenerate: float = DEGENERATE_SCORE,
    counts: DataFrame | None = None,
    below: float | None = None,
) -> DataFrame:
    """``(text, type, n11, n10, n01, n00, chi2)`` of every chunk of ``lines(line)``.

    ``counts`` takes what ``stage_counts`` made of the same lines, to share it between jobs. With ``below``,
    chunks that do not score below that may be left out.
    """
    if counts is None and max_words == 2:
        cells = scoring.pair_contingency(lines, max_gap, single_occurrences, below, degenerate=degenerate)
        return scoring.score(cells.drop("types"), degenerate)
    if counts is None:
        cells, _ = scoring.window_contingency(lines, max_words, max_gap, single_occurrences)
        return scoring.score(cells.drop("__key"), degenerate)
    chunks = None
    if not single_occurrences:
        chunks = drop_single_occurrences(counts).filter("type > 0")
    cells = scoring.contingency(counts, line_total(counts), max_words, chunks)
    return scoring.score(cells, degenerate)


def mine_chunks(
    lines: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    threshold: float = scoring.CHUNK_THRESHOLD,
    single_occurrences: bool = True,
    degenerate: float = DEGENERATE_SCORE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Chunks of a monolingual corpus that score below the threshold."""
    scored = score_corpus(lines, max_words, max_gap, single_occurrences, degenerate, counts, threshold)
    return scoring.keep_chunks(scored, threshold)


def mine_dealt_chunks(
    lines: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    threshold: float = scoring.CHUNK_THRESHOLD,
    single_occurrences: bool = True,
    degenerate: float = DEGENERATE_SCORE,
) -> tuple[DataFrame, Layout]:
    """``mine_chunks`` with the ``__key`` by which a chunk is dealt, and the layout, so that lines can come to the chunks."""
    cells, layout = scoring.window_contingency(lines, max_words, max_gap, single_occurrences)
    return scoring.keep_chunks(scoring.score(cells, degenerate), threshold), layout


def mine_groups(
    lines: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    threshold: float = groups.GROUP_THRESHOLD,
    degenerate: float = DEGENERATE_SCORE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Groups of chunks with the same words whose pooled score is below the threshold."""
    if counts is None:
        scored = groups.line_group_scores(lines, max_words, max_gap, degenerate)
    else:
        scored = groups.group_scores(counts, line_total(counts), max_words, max_gap, degenerate)
    return groups.keep_groups(scored, threshold)


def candidate_scores(
    chunks: DataFrame,
    pairs: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    match: str = "substring",
    degenerate: float = DEGENERATE_SCORE,
) -> tuple[DataFrame, translation.Bitext]:
    """Scored candidates, by number, and the tables that name them."""
    kept = chunks.select("text", "type", F.col("chi2").alias("chunk_chi2"))
    bitext = translation.prepare_bitext(kept, pairs, max_words, max_gap)
    joint = translation.joint_counts(bitext, match)
    return translation.translation_scores(joint, bitext.size, degenerate), bitext


def mine_translations(
    chunks: DataFrame,
    pairs: DataFrame,
    max_words: int = 2,
    max_gap: int = 1,
    match: str = "substring",
    top_k: int = translation.TOP_K,
    candidates_over: int = translation.CANDIDATES_OVER,
    weakest: bool = False,
    degenerate: float = DEGENERATE_SCORE,
) -> DataFrame:
    """``(text, type, chunk_chi2, rank, dst_text, dst_type, score)`` of the best candidates.

    ``chunks(text, type, chi2)`` come from ``mine_chunks``; ``pairs(src, dst)``
    are line-aligned.
    """
    scored, bitext = candidate_scores(chunks, pairs, max_words, max_gap, match, degenerate)
    best = translation.select_candidates(scored, top_k, candidates_over, weakest)
    return translation.name_chunks(best, bitext).select(
        "text", "type", "chunk_chi2", "rank", "dst_text", "dst_type", "score"
    )
