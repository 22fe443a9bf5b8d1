"""Weighted shards by rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.llm.common import unit_hash, unused
from newsignal.session import materialise

BLOCK_ROWS = 50_000


def cost(key: Column, shard: int, weight: float) -> Column:
    """What it costs to put a key into a shard; depends on the key, the shard and its weight only.

    The cost is an exponential variable with the weight as its rate, so the
    cheapest of all shards is shard s for a share of weight / total of the keys.
    """
    return -F.ln(unit_hash(key, f"shard-{shard}")) / F.lit(float(weight))


def cheapest(key: Column, shards: Mapping[int, float]) -> Column:
    """(cost, shard) of the cheapest shard; equal costs go to the lower number."""
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need weights above 0")
    return F.array_min(
        F.array(*[F.struct(cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in shards.items()])
    )


def assign(
    df: DataFrame,
    key: str,
    shards: Mapping[int, float],
    added: Mapping[int, float] | None = None,
    shard: str = "shard",
    grown: str = "grown_shard",
) -> DataFrame:
    """Adds the shard of each row: every shard bids for every key and the cheapest gets it.

    Bids of other shards do not change when a shard is added or removed. A new
    shard therefore takes rows only into itself, about its share of the weight,
    and the rows of a removed one spread over the rest by weight. With `added`,
    the column `grown` holds the shard once those shards have joined.

    Rows with equal keys, NULL keys among themselves, share a shard; a NULL key
    counts as an empty one. Nothing is shuffled. Own columns of these names are
    replaced; an empty table stays empty.
    """
    key_column, best = F.col(f"`{key}`"), unused(df, "best")
    out = df.withColumn(best, cheapest(key_column, shards))
    new = {shard: F.col(f"{best}.shard")}
    if added:
        new[grown] = F.least(F.col(best), cheapest(key_column, added)).getField("shard")
    return out.withColumns(new).drop(best)


def shard_slots(rows: DataFrame, key: str, shard: str = "shard", slot: str = "slot", seed: str = "slot") -> DataFrame:
    """`rows` with their places in their shard, gapless from 0, in the order of a hash of the key.

    Rows that are equal in every column are counted before the shuffle and are
    given neighbouring places afterwards, in chunks that are dealt anew, so many
    copies of one row are no hot group. Everything else is numbered in blocks of
    the hash, some 50,000 rows each; per shard one task adds up the block sizes.
    Rows of equal key are ordered by their other columns, from left to right,
    NULLs first. An own column `slot` is replaced; an empty table stays empty.
    """
    rows = rows.drop(slot)
    # Own names inside, so that no column of `rows` can clash with them.
    inner = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    columns, where = [F.col(c) for c in inner.values()], inner[shard]
    groups = materialise(
        rows.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
        .groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .withColumn("hash", unit_hash(F.col(inner[key]), seed))
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    blocked = groups.withColumn("block", F.floor(F.col("hash") * ceil(max(total, 1) / BLOCK_ROWS)))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(F.col(where).alias("s"), F.col("block").alias("b"))
        .agg(F.sum("n").alias("size"))
        .select("s", "b", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy(where, "block").orderBy("hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocked.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, F.col(where).eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("first", F.col("earlier") + F.col("offset"))
    )
    last_chunk = F.floor((F.col("n") - 1) / BLOCK_ROWS)
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    low = F.col("chunk") * BLOCK_ROWS
    high = F.least(low + BLOCK_ROWS, F.col("n")) - 1
    return chunks.repartition("hash", "chunk").select(
        *[F.col(n).alias(c) for c, n in inner.items()],
        F.explode(F.sequence(F.col("first") + low, F.col("first") + high)).alias(slot),
    )


def write_shards(df: DataFrame, folder: str, shard: str = "shard", columns: Sequence[str] | None = None) -> None:
    """Parquet files in one folder per shard; tasks write the rows that they hold, without a shuffle."""
    out = df if columns is None else df.select(*[f"`{c}`" for c in columns], f"`{shard}`")
    out.write.partitionBy(shard).parquet(folder)
