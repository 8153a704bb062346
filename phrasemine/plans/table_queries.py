"""One query per operator over the ``documents`` and ``conversations`` tables.

Each takes ``(spark, folder)`` and reads whole tables. Extraction and scoring
run on the documents; queries over all 27 shapes run on the conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phrasemine.functions.association import chi_square
from phrasemine.functions.text import tokenize
from phrasemine.operators import chunks as chunk_ops
from phrasemine.operators import groups, matching, scoring, translation
from phrasemine.plans import mining
from phrasemine.plans.stage import stage
from phrasemine.shapes import MAX_GAP, MAX_WORDS, Shape, chunk_shapes
from phrasemine.sinks import text as sinks
from phrasemine.sources import parallel
from phrasemine.sources.lines import corpus_size
from phrasemine.sources.tables import (
    conversation_lines,
    document_lines,
    mixed_text,
    parallel_pairs,
)

LINE_KEY = ["conv_id", "turn"]
CHUNK = ["text", "type"]
TARGET = ["dst_text", "dst_type"]
CELLS = list(scoring.CELLS)
# Decimals of the scores in the printed forms.
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    return document_lines(spark, folder)


def parallel_parse(spark: SparkSession, folder: str) -> DataFrame:
    return parallel.parse_parallel(mixed_text(spark, folder))


def parallel_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return parallel.rejected_lines(mixed_text(spark, folder))


def parallel_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected lines, counted in the scan that writes the accepted ones."""
    seen = Observation()
    accepted = stage(parallel.parse_observed(mixed_text(spark, folder), seen), "parallel")
    counts = seen.get
    return accepted.agg(F.count(F.lit(1)).alias("accepted")).select(
        F.lit(counts["lines"]).cast("long").alias("lines"), "accepted", F.lit(counts["rejected"]).cast("long").alias("rejected")
    )


def corpus_size_query(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_size(document_lines(spark, folder))


def tokenize_query(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tokenize(F.col("line"))
    return document_lines(spark, folder).select(
        "line", F.size(tokens).alias("n_tokens"), F.concat_ws("\n", tokens).alias("tokens")
    )


def _counted(shapes: list[Shape]) -> Query:
    return lambda spark, folder: chunk_ops.count_shapes(document_lines(spark, folder), shapes)


def _shapes_of(words: int) -> list[Shape]:
    gapped = chunk_shapes(words, MAX_GAP)
    return [shape for shape in gapped if shape.words == words and not shape.contiguous]


def _conversation_counts(shapes: list[Shape]) -> Query:
    return lambda spark, folder: chunk_ops.count_shapes(conversation_lines(spark, folder), shapes)


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_ops.count_chunks(document_lines(spark, folder))


def chunk_counts_full(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_ops.count_chunks(conversation_lines(spark, folder), MAX_WORDS, MAX_GAP)


def chunk_constituents(spark: SparkSession, folder: str) -> DataFrame:
    counts = chunk_ops.count_chunks(conversation_lines(spark, folder), MAX_WORDS, MAX_GAP)
    return scoring.constituents(chunk_ops.multi_word(counts)).drop("n")


def chunk_contingency(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.pair_contingency(document_lines(spark, folder)).drop("types")


def chunk_scores(spark: SparkSession, folder: str) -> DataFrame:
    return mining.score_corpus(document_lines(spark, folder)).select(*CHUNK, "chi2")


def chunk_scores_full(spark: SparkSession, folder: str) -> DataFrame:
    lines = conversation_lines(spark, folder)
    return mining.score_corpus(lines, MAX_WORDS, MAX_GAP).select(*CHUNK, *CELLS, "chi2")


def chi_square_expr(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all distinct tables of the documents, single and pooled by text.

    Each table also comes with its last cell negated and with an empty first
    cell, as such tables occur among translations and give scores below zero.
    """
    # Margins stay in all forms of a table, so each task has all of them once it has the tables of a margin.
    cells = F.struct("n11", "n00")
    found = scoring.pair_tables(document_lines(spark, folder)).groupBy("n10", "n01").agg(F.collect_set(cells).alias("found"))
    forms = F.array(
        cells,
        F.struct("n11", (-F.col("n00")).alias("n00")),
        F.struct(F.lit(0).cast("long").alias("n11"), "n00"),
    )
    tables = (
        found.select("n10", "n01", F.inline("found"))
        .select("n10", "n01", F.inline(forms).alias("n11", "n00"))
        .distinct()
        .select(*CELLS)
    )
    return tables.select("*", chi_square(*map(F.col, CELLS)).alias("chi2"))


def filtered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return mining.mine_chunks(document_lines(spark, folder)).select(*CHUNK, *CELLS, "chi2")


def filtered_chunks_no_hapax(spark: SparkSession, folder: str) -> DataFrame:
    kept = mining.mine_chunks(document_lines(spark, folder), single_occurrences=False)
    return kept.select(*CHUNK, *CELLS, "chi2")


def _group_rows(scored: DataFrame) -> DataFrame:
    types = F.concat(F.lit("#"), F.array_join(F.col("types").cast("array<string>"), "#"))
    code = F.coalesce("type", F.lit(0)).alias("type")
    return scored.select("text", "level", code, types.alias("types"), "chi2")


def chunk_type_groups(spark: SparkSession, folder: str) -> DataFrame:
    grouped = groups.type_groups(chunk_ops.count_chunks(document_lines(spark, folder)))
    listed = F.transform("types", lambda t: F.concat_ws(":", t["type"].cast("string"), t["n"].cast("string")))
    return grouped.select("text", F.array_join(listed, "#").alias("types"))


def group_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _group_rows(groups.pair_group_scores(document_lines(spark, folder)))


def group_scores_full(spark: SparkSession, folder: str) -> DataFrame:
    return _group_rows(groups.line_group_scores(conversation_lines(spark, folder), MAX_WORDS, MAX_GAP))


def filtered_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _group_rows(mining.mine_groups(document_lines(spark, folder)))


def origin_counts(spark: SparkSession, folder: str) -> DataFrame:
    return translation.side_counts(parallel_pairs(spark, folder), "src")


def destination_counts(spark: SparkSession, folder: str) -> DataFrame:
    return translation.side_counts(parallel_pairs(spark, folder), "dst")


def match_substring(spark: SparkSession, folder: str) -> DataFrame:
    pairs = parallel_pairs(spark, folder)
    kept = mining.mine_chunks(conversation_lines(spark, folder), MAX_WORDS, 0)
    return matching.match_lines(kept, pairs, LINE_KEY, MAX_WORDS, 0)


def match_gapped(spark: SparkSession, folder: str) -> DataFrame:
    pairs = parallel_pairs(spark, folder)
    kept, layout = mining.mine_dealt_chunks(conversation_lines(spark, folder), MAX_WORDS, MAX_GAP)
    gapped = kept.filter("type % 100 > 0")
    return matching.match_lines(gapped, pairs, LINE_KEY, MAX_WORDS, MAX_GAP, match="token", layout=layout)


def chunk_line_matches(spark: SparkSession, folder: str) -> DataFrame:
    kept = mining.mine_chunks(document_lines(spark, folder))
    return matching.match_lines(kept, parallel_pairs(spark, folder), LINE_KEY)


def _bitext(spark: SparkSession, folder: str) -> translation.Bitext:
    kept = mining.mine_chunks(document_lines(spark, folder))
    return translation.prepare_bitext(kept.select(*CHUNK), parallel_pairs(spark, folder))


def joint_counts(spark: SparkSession, folder: str) -> DataFrame:
    return translation.joint_counts(_bitext(spark, folder), named=True).select(*CHUNK, *TARGET, "n")


def translation_scores(spark: SparkSession, folder: str) -> DataFrame:
    bitext = _bitext(spark, folder)
    scored = translation.translation_scores(translation.joint_counts(bitext, named=True), bitext.size)
    return scored.select(*CHUNK, *TARGET, *CELLS, "score")


def ranked_translations(spark: SparkSession, folder: str) -> DataFrame:
    bitext = _bitext(spark, folder)
    parts = translation.joint_parts(bitext, named=True)
    scored = [None if p is None else translation.translation_scores(p, bitext.size).drop(*CELLS) for p in parts]
    return translation.rank_parts(*scored).select(*CHUNK, "rank", *TARGET, "score")


def _translations(spark: SparkSession, folder: str, **options) -> DataFrame:
    kept = mining.mine_chunks(document_lines(spark, folder))
    return mining.mine_translations(kept, parallel_pairs(spark, folder), **options)


def top_translations(spark: SparkSession, folder: str) -> DataFrame:
    return _translations(spark, folder)


def top_translations_token(spark: SparkSession, folder: str) -> DataFrame:
    return _translations(spark, folder, match="token")


def weakest_translations(spark: SparkSession, folder: str) -> DataFrame:
    return _translations(spark, folder, weakest=True, top_k=translation.WEAKEST_K)


def render_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.render_chunks(mining.mine_chunks(document_lines(spark, folder)), DIGITS)


def render_groups(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.render_groups(mining.mine_groups(document_lines(spark, folder)), DIGITS)


def render_translations(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.render_translations(_translations(spark, folder), digits=DIGITS)


def parsed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks read back from the form that loses no digit; so are groups and translations."""
    return sinks.parse_chunks(sinks.render_chunks(mining.mine_chunks(document_lines(spark, folder))))


def parsed_groups(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.parse_groups(sinks.render_groups(mining.mine_groups(document_lines(spark, folder))))


def parsed_translations(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.parse_translations(sinks.render_translations(_translations(spark, folder)))


QUERIES: dict[str, Query] = {
    "corpus_lines": corpus_lines,
    "parallel_parse": parallel_parse,
    "parallel_rejects": parallel_rejects,
    "parallel_line_counts": parallel_line_counts,
    "corpus_size": corpus_size_query,
    "tokenize": tokenize_query,
    "unigram_counts": _counted([Shape(1)]),
    "ngram_counts": _counted(chunk_shapes(MAX_WORDS, 0)),
    "skip_bigram_counts": _counted(_shapes_of(2)),
    "skip_trigram_counts": _conversation_counts(_shapes_of(3)),
    "skip_4gram_counts": _conversation_counts(_shapes_of(4)),
    "chunk_counts": chunk_counts,
    "chunk_counts_full": chunk_counts_full,
    "chunk_constituents": chunk_constituents,
    "chunk_contingency": chunk_contingency,
    "chi_square_expr": chi_square_expr,
    "chunk_scores": chunk_scores,
    "chunk_scores_full": chunk_scores_full,
    "filtered_chunks": filtered_chunks,
    "filtered_chunks_no_hapax": filtered_chunks_no_hapax,
    "chunk_type_groups": chunk_type_groups,
    "group_scores": group_scores,
    "group_scores_full": group_scores_full,
    "filtered_groups": filtered_groups,
    "origin_counts": origin_counts,
    "destination_counts": destination_counts,
    "match_substring": match_substring,
    "match_gapped": match_gapped,
    "chunk_line_matches": chunk_line_matches,
    "joint_counts": joint_counts,
    "translation_scores": translation_scores,
    "ranked_translations": ranked_translations,
    "top_translations": top_translations,
    "top_translations_token": top_translations_token,
    "weakest_translations": weakest_translations,
    "render_chunks": render_chunks,
    "parsed_chunks": parsed_chunks,
    "render_groups": render_groups,
    "parsed_groups": parsed_groups,
    "render_translations": render_translations,
    "parsed_translations": parsed_translations,
}
