"""Column functions that turn scores into flags and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(value: Column, threshold) -> Column:
    """1 where value >= threshold; NULL counts as 0."""
    return F.when(value >= F.lit(threshold), 1).otherwise(0)


def below(value: Column, threshold) -> Column:
    """The inverted flag: 0 where value >= threshold, else 1."""
    return F.when(value >= F.lit(threshold), 0).otherwise(1)


def five_way(polarity: Column, edge: float = 0.5) -> Column:
    return (
        F.when(polarity < -edge, "Very_Negative")
        .when(polarity < 0, "Slight_Negative")
        .when(polarity == 0, "Neutral")
        .when(polarity <= edge, "Slight_Positive")
        .when(polarity > edge, "Very_Positive")
    )


def three_way(polarity: Column) -> Column:
    return (
        F.when(polarity > 0, "positive")
        .when(polarity == 0, "neutral")
        .when(polarity < 0, "negative")
    )


def label_or_unknown(label: Column) -> Column:
    return F.coalesce(label, F.lit("UNKNOWN"))


def signed(label: Column, score: Column, negative: str = "NEGATIVE") -> Column:
    """Score turned negative for the negative label; a missing score is 0."""
    score = F.coalesce(score, F.lit(0.0))
    return F.when(label == negative, -score).otherwise(score)


def movement(forward_return: Column) -> Column:
    """1 for a rise, 0 for a fall, no change or no future row."""
    return F.coalesce(forward_return > 0, F.lit(False)).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, NULL for a zero divisor."""
    return F.try_divide(part, whole) * 100
