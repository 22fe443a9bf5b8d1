"""Row order without a task that holds a whole key or the whole table.

Two shapes are served:

* per-key series (`with_position`, `in_blocks`, `block_totals_before`): rows of
  a key are numbered through calendar chunks, then cut into blocks of fixed
  length; windows run per (key, block), and rows near a block edge are copied
  into the neighbour that needs them.
* one global order (`totals_before`, `row_index`): values are cut into quantile
  ranges; each range is sorted on its own and gets the totals of the ranges
  before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newsignal.session import materialise

BLOCK_ROWS = 1024
ROWS_PER_RANGE = 1_000_000


def with_position(
    df: DataFrame, key: str, order: str, ties: Sequence[str] = (), chunk: str = "month"
) -> DataFrame:
    """Adds `_pos`, the 0-based place of each row in its key's order.

    Rows without key or order value are dropped. `chunk` is the calendar unit
    one task sorts at a time; pick one that holds few rows of the busiest key.
    """
    df = df.na.drop(subset=[key, order]).withColumn("_chunk", F.date_trunc(chunk, order))
    counts = df.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(order, *ties)
    return (
        df.withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_chunk"])
        .withColumn("_pos", F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_local", "_offset")
    )


def block_of(rows: int) -> Column:
    return F.floor(F.col("_pos") / rows).cast("long")


def in_blocks(positioned: DataFrame, rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """Adds `_block` and `_core`.

    Each block also receives the last `before` rows of earlier blocks and the
    first `after` rows of later ones, marked `_core = false`. Drop them once the
    windows are computed.
    """
    lowest = F.greatest(F.floor((F.col("_pos") - after) / rows), F.lit(0)).cast("long")
    highest = F.floor((F.col("_pos") + before) / rows).cast("long")
    return positioned.withColumn(
        "_block", F.explode(F.sequence(lowest, highest))
    ).withColumn("_core", F.col("_block") == block_of(rows))


def block_window(key: str) -> WindowSpec:
    return Window.partitionBy(key, "_block").orderBy("_pos")


def block_totals_before(totals: DataFrame, key: str, value: str, fan: int = BLOCK_ROWS) -> DataFrame:
    """Running total over the blocks before each block of a key.

    `totals` has one row per (key, _block). Blocks are summed in groups of
    `fan` first, so the longest run sorted in one task is rows / fan**2.
    """
    totals = totals.withColumn("_group", F.floor(F.col("_block") / fan))
    inside = (
        Window.partitionBy(key, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        totals.groupBy(key, "_group")
        .agg(F.sum(value).alias("_sum"))
        .select(key, "_group", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_outer"))
    )
    return (
        totals.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(groups, [key, "_group"])
        .select(key, "_block", (F.col("_inner") + F.col("_outer")).alias(value))
    )


def with_range(df: DataFrame, *order: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """`df` with `_range`, ascending ranges of the given columns, and their number.

    Spark's range partitioner cuts any type of key, NULL first. The dealt rows are
    written, so that a row keeps its range. The cuts only balance the work;
    results do not depend on them.
    """
    if ranges is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, ceil(df.count() / ROWS_PER_RANGE))
    dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    return materialise(dealt), ranges


def range_offsets(ranged: DataFrame, measures: dict[str, Column], ranges: int) -> DataFrame:
    """Totals of each measure over the ranges before a range.

    Ranges are summed in groups first: a range sends its totals to the later
    ranges of its group and a group to the later groups, about ranges**1.5 small
    rows with map-side combine, instead of one global window.
    """
    fan = ceil(sqrt(ranges))
    totals = ranged.groupBy("_range").agg(*[m.alias(n) for n, m in measures.items()])
    totals = totals.withColumn("_part", F.floor(F.col("_range") / fan).cast("int"))

    def to_later(sums: DataFrame, place: str, last: Column, prefix: str, *within: str) -> DataFrame:
        later = F.filter(F.sequence(place, last), lambda i: i > F.col(place))
        sent = sums.withColumn("_to", F.explode(later)).groupBy(*within, F.col("_to").alias(place))
        return sent.agg(*[F.sum(n).alias(f"{prefix}{n}") for n in measures])

    inner = to_later(totals, "_range", (F.col("_part") + 1) * fan - 1, "_in_", "_part").drop("_part")
    parts = totals.groupBy("_part").agg(*[F.sum(n).alias(n) for n in measures])
    outer = to_later(parts, "_part", F.lit((ranges - 1) // fan), "_out_")
    zero = F.lit(0)
    return (
        totals.select("_range", "_part")
        .join(inner, "_range", "left")
        .join(outer, "_part", "left")
        .select(
            "_range",
            *[(F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_out_{n}", zero)).alias(f"_before_{n}") for n in measures],
        )
    )


def totals_before(
    df: DataFrame, value: str, measures: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Adds `before_<m>`: the total of measure m over all smaller values.

    `df` must hold one row per distinct value (aggregate first), so that a
    value shared by many rows is a single row here. NULL values are left out.
    """
    ranged, ranges = with_range(df.where(F.col(value).isNotNull()), value, ranges=ranges)
    offsets = range_offsets(ranged, {m: F.sum(m) for m in measures}, ranges)
    earlier = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, "_range").select(
        *df.columns,
        *[
            (F.coalesce(F.sum(m).over(earlier), F.lit(0)) + F.col(f"_before_{m}")).alias(f"before_{m}")
            for m in measures
        ],
    )


def row_index(df: DataFrame, key: str, name: str = "row_index", ranges: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row by a key of any type.

    NULL keys come first; rows with equal keys are ordered by a hash of all
    columns, so that they spread over several ranges.
    """
    ranged, ranges = with_range(df.withColumn("_tie", F.xxhash64(*df.columns)), key, "_tie", ranges=ranges)
    offsets = range_offsets(ranged, {"n": F.count("*")}, ranges)
    inside = Window.partitionBy("_range").orderBy(key, "_tie")
    return ranged.join(offsets, "_range").select(
        *df.columns,
        (F.row_number().over(inside) - 1 + F.col("_before_n")).alias(name),
    )


def batch_ids(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds `batch_id`: consecutive batches of `size` rows by key."""
    return (
        row_index(df, key, "_i")
        .withColumn("batch_id", F.floor(F.col("_i") / size).cast("long"))
        .drop("_i")
    )
