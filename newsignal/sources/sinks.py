"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_FILE = 5_000_000


def write_parquet(
    df: DataFrame, path: str, by: str | None = "date", mode: str = "overwrite", days_only: bool = False
) -> None:
    """Parquet, one folder per value of `by`.

    Rows are rebalanced by that column first: quiet days share a task, and
    adaptive execution splits a day too large for one. With `days_only`, a run
    replaces the folders that it has rows for and leaves the others.
    """
    if by is None:
        df.write.mode(mode).parquet(path)
        return
    writer = df.hint("rebalance", by).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    writer = writer.option("partitionOverwriteMode", "dynamic" if days_only else "static")
    writer.partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = "ticker", mode: str = "overwrite") -> None:
    """CSV with header and doubled quotes, one folder per value of `by`."""
    if by is not None:
        df = df.hint("rebalance", by)
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_bucketed(df: DataFrame, table: str, by: str, order: str, buckets: int, mode: str = "overwrite") -> None:
    """A table of the catalog in `buckets` buckets of `by`, each sorted by `by` and `order`.

    Joins, groups and windows on `by` read it without an exchange. Rows are dealt
    to the buckets first, so a bucket is one file, not one per task. A value of
    `by` that holds a large share of the rows makes a large bucket: bucket by a
    finer key then.
    """
    dealt = df.repartition(buckets, by)
    dealt.write.mode(mode).bucketBy(buckets, by).sortBy(by, order).saveAsTable(table)
