"""Wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str = "sentiment_type",
    value: str = "value",
) -> DataFrame:
    """One row per id row and value column; values become text, NULL stays NULL."""
    as_text = df.select(*ids, *[F.col(v).cast("string").alias(v) for v in values])
    return as_text.unpivot(list(ids), list(values), name, value)


def slice_of(long: DataFrame, kind: str, name: str = "sentiment_type", value: str = "value") -> DataFrame:
    """Rows of one value column, with the value back as a number."""
    return long.where(F.col(name) == kind).withColumn(value, F.col(value).try_cast("double"))
