"""Cleaning of articles, index links and price bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.functions.labels import at_least, below
from newsignal.functions.text import (
    compact_day,
    contains_any,
    day,
    empty_to_null,
    first_digits,
    number,
    strip,
)

# Texts that stand for a missing article, and the mark of an error page.
MISSING_TEXTS = ("", "None")
ERROR_MARK = "forbidden"

# Tickers the price source cannot serve.
SKIPPED_TICKERS = ("IPG", "BRK.B", "BF.B")

# The 50 states and three names of the country.
US_PLACES = (
    "United States", "US", "USA",
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado",
    "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine",
    "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi",
    "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina",
    "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "West Virginia", "Wisconsin", "Wyoming",
)


def drop_missing(
    df: DataFrame, text: str = "text", sentinels: Sequence[str] = MISSING_TEXTS
) -> DataFrame:
    """Sentinel texts become NULL, then rows with any NULL go."""
    return df.withColumn(text, empty_to_null(F.col(text), sentinels)).na.drop()


def drop_error_pages(df: DataFrame, text: str = "text", mark: str = ERROR_MARK) -> DataFrame:
    """Adds `exception_flag` and keeps the rows where it is 0."""
    flag = F.col(text).contains(mark).cast("int")
    return df.withColumn("exception_flag", flag).where("exception_flag = 0")


def dedupe(df: DataFrame, key: str, wide: Sequence[str] = ()) -> DataFrame:
    """One row per distinct combination of all columns but `key`; lowest key stays.

    Columns in `wide` are compared by SHA-256 digest, so the shuffle hashes and
    sorts short keys. Map-side combine reduces a heavily copied text to one row
    per task before the shuffle.
    """
    rest = [c for c in df.columns if c != key and c not in wide]
    digests = {f"_digest_{c}": F.sha2(F.col(c), 256) for c in wide}
    return (
        df.withColumns(digests)
        .groupBy(*rest, *digests)
        .agg(F.min(key).alias(key), *[F.first(c).alias(c) for c in wide])
        .select(*df.columns)
    )


def clean_articles(
    df: DataFrame, key: str, text: str = "text", trim_to: int = 10_000
) -> DataFrame:
    """Missing and error pages out, copies out, trimmed text added.

    `trimmed_text` is the first `trim_to` characters without outer white space;
    `text` stays whole. Rows whose whole text is blank go. Trimming only
    depends on the text, so one removal of copies serves before and after it.
    """
    kept = drop_error_pages(drop_missing(df, text), text)
    trimmed = strip(F.substring(text, 1, trim_to))
    return dedupe(kept.where(strip(F.col(text)) != ""), key, wide=[text]).withColumn("trimmed_text", trimmed)


def null_profile(df: DataFrame) -> DataFrame:
    """One row: `row_count` and `<column>_nulls`, in one pass."""
    return df.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns],
    )


def date_flags(links: DataFrame, start: str, stop: str, late: str, name: str = "text") -> DataFrame:
    """File links with their date, kept when start <= date < stop.

    `recent` is 1 from `start` on, `before_late` and `before_stop` are the
    inverted flags of the two later thresholds.
    """
    dated = links.withColumn("date", compact_day(first_digits(F.col(name))))
    edge = {k: F.to_date(F.lit(v)) for k, v in {"start": start, "stop": stop, "late": late}.items()}
    return dated.where((F.col("date") >= edge["start"]) & (F.col("date") < edge["stop"])).withColumns(
        {
            "recent": at_least(F.col("date"), edge["start"]),
            "before_late": below(F.col("date"), edge["late"]),
            "before_stop": below(F.col("date"), edge["stop"]),
        }
    )


def since_days(df: DataFrame, days: int, date: str = "date") -> DataFrame:
    """Rows of today and of the `days` days before it, by the session's calendar."""
    return df.where(F.col(date) >= F.date_sub(F.current_date(), days))


def keep_any_of(df: DataFrame, column: str, terms: Sequence[str] = US_PLACES) -> DataFrame:
    """Rows whose column contains any of the terms, case kept."""
    return df.where(contains_any(F.col(column), terms))


def clean_bars(raw: DataFrame, skip: Sequence[str] = SKIPPED_TICKERS) -> DataFrame:
    """Typed bars from text columns; rows without a numeric close go."""
    typed = raw.where(~F.col("ticker").isin(*skip)).withColumns(
        {
            "date": day(F.col("date")),
            **{c: number(F.col(c)) for c in ("open", "high", "low", "close")},
            "volume": number(F.col("volume")).cast("long"),
        }
    )
    return typed.na.drop(subset=["close"])


def latest(df: DataFrame, n: int, date: str = "date", key: str | None = None) -> DataFrame:
    """The n newest rows: a top-k per task, merged once."""
    order = [F.desc(date)] + ([F.asc(key)] if key else [])
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, length: int, *order: str) -> DataFrame:
    """Rows offset .. offset + length of an ordered table. For all batches of a
    table use `ordered.batch_ids`."""
    return df.orderBy(*order).offset(offset).limit(length)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; absent columns become NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
