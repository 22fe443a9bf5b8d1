"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def same(value: Column, name: str, build) -> Column:
    """`build(v)` where v holds the value of an expression that is computed once.

    Spark inlines an expression wherever it is used, also into the function of
    `transform` or `filter`, where it would be computed again for each element.
    The variable of a lambda is computed once.
    """
    return F.transform(F.array(value), lambda v: build(v)).getItem(0).alias(name)


BITMAP_BITS = 1 << 25


def bitmap(keys: DataFrame) -> DataFrame:
    """The hashes of the only column of `keys` as a written bitmap of 2**25 bits.

    (word, bits): at most 2**25 / 64 = 524,288 rows, whatever the number of keys,
    so it may be broadcast.
    """
    at = F.pmod(F.xxhash64(F.col(f"`{keys.columns[0]}`")), F.lit(BITMAP_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    return materialise(words.agg(F.bit_or(one).alias("bits")))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """`df` with `out`: false if `key`, of the type of the keys, is surely not in the bitmap of `keys`.

    True for all keys, and for others by a chance that grows with the number of
    keys. Nothing is shuffled.
    """
    word, bits = unused(df, "word"), unused(df, "bits")
    at = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BITMAP_BITS))
    words = F.broadcast(bitmap(keys).withColumnsRenamed({"word": word, "bits": bits}))
    near = df.withColumn(word, F.shiftright(at, 6)).join(words, word, "left")
    found = F.coalesce(F.getbit(F.col(bits), (at % 64).cast("int")) == 1, F.lit(False))
    return near.withColumn(out, found).drop(word, bits)


def without_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `key` is not in the only column of `keys`; NULL keys stay.

    Rows that a bitmap of the keys rules out stay where they are; the exact join
    shuffles only the rest. `df` is read twice.
    """
    maybe, gone = unused(df, "maybe"), unused(df, "gone")
    marked = maybe_in(df, key, keys, maybe)
    lost = keys.select(F.col(f"`{keys.columns[0]}`").alias(gone))
    rest = marked.where(F.col(maybe)).join(lost, F.col(f"`{key}`") == F.col(gone), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(rest).drop(maybe)


def unit_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only.

    The first 52 bits of an MD5 digest, so any engine can compute the same.
    NULL counts as the empty string.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which rows of one key are neighbours.

    Holds one key's rows and one batch.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
