"""Chunk shapes: which tokens of a window make a chunk, and how it is cut in two.

A shape keeps ``words`` tokens around one run of ``gap`` skipped tokens and has
the integer code ``100 * words + 10 * gap + variant``. The variant says where
the gap sits. Code 0 is a single word.
"""

from __future__ import annotations

from dataclasses import dataclass

MAX_WORDS = 4
MAX_GAP = 4
UNIGRAM = 0


@dataclass(frozen=True)
class Shape:
    words: int
    gap: int = 0
    variant: int = 0

    @property
    def code(self) -> int:
        return UNIGRAM if self.words == 1 else 100 * self.words + 10 * self.gap + self.variant

    @property
    def left_words(self) -> int:
        """Words before the gap; a contiguous chunk is cut after its first word."""
        if self.gap and self.words == 3:
            return 2 - self.variant
        return self.variant + 1

    @property
    def offsets(self) -> tuple[int, ...]:
        """Positions, within the window, of the tokens that are kept."""
        left = self.left_words
        return tuple(k if k < left else k + self.gap for k in range(self.words))

    @property
    def span(self) -> int:
        return self.words + self.gap

    @property
    def contiguous(self) -> bool:
        return self.gap == 0


def contiguous_code(words: int) -> int:
    return Shape(words).code


def check_limits(max_words: int, max_gap: int) -> None:
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"max_words must be between 2 and {MAX_WORDS}, got {max_words}")
    if not 0 <= max_gap <= MAX_GAP:
        raise ValueError(f"max_gap must be between 0 and {MAX_GAP}, got {max_gap}")


def chunk_shapes(max_words: int = 2, max_gap: int = 1) -> list[Shape]:
    """All multi-word shapes up to the two limits."""
    check_limits(max_words, max_gap)
    return [
        Shape(words, gap, variant)
        for words in range(2, max_words + 1)
        for gap in range(max_gap + 1)
        for variant in range(words - 1 if gap else 1)
    ]


def all_shapes(max_words: int = 2, max_gap: int = 1) -> list[Shape]:
    return [Shape(1), *chunk_shapes(max_words, max_gap)]


def constituent_codes(max_words: int) -> list[int]:
    """Codes that can be a half of a chunk: words, then contiguous 2 and 3 grams."""
    return [contiguous_code(words) for words in range(1, max_words)]
