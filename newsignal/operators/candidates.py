"""Positions of tokens that may match a word table.

A word table short enough to list is tested inside each token array, so that
only hits are exploded and joined. A longer one makes every token a candidate;
results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTED_WORDS = 20_000


def listed_words(table: DataFrame, column: str) -> list[str] | None:
    """The words as a list, or None when there are more than LISTED_WORDS."""
    rows = table.select(column).limit(LISTED_WORDS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= LISTED_WORDS else None


def positions(tokens: Column, words: list[str] | None) -> Column:
    """0-based places of the tokens that are among the words; all without a list."""
    if words is None:
        return F.transform(tokens, lambda token, i: i)
    return F.array_compact(F.transform(tokens, lambda token, i: F.when(token.isin(words), i)))
