"""Accuracy, AUC and summary statistics by partial aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.operators.ordered import totals_before
from newsignal.session import materialise


def binary_metrics(
    df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.0
) -> DataFrame:
    """One row (accuracy, auc) for a 0/1 label; a score above the threshold is 1.

    Rows are counted per score first, so equal scores are one row. The area is
    the rank sum with ties counted half, from counts below each score.
    """
    hit = (F.col(label) == 1) == (F.col(score) > threshold)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).alias("_score")
    ).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
        F.count_if(hit).alias("hit"),
    )
    ranked = totals_before(materialise(counts), "_score", ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg(
        (F.sum("hit") / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"),
        F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
    )


# Bits of a code that one pass settles, from the top.
DIGITS = (13, 13, 13, 13, 12)


def ordered_codes(values: np.ndarray) -> np.ndarray:
    """64-bit codes with the order of the doubles: -0.0 equals 0.0, NaN comes last."""
    values = values.astype(np.float64) + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def decoded(code: int) -> float:
    sign = 1 << 63
    bits = code ^ sign if code & sign else ~code & (2 * sign - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def digit_counts(numbers: DataFrame, prefixes: list[list[int]], settled: int, width: int) -> dict[tuple[int, int], np.ndarray]:
    """How often each next digit follows each prefix, by (column, prefix); one pass over all columns.

    `numbers` has columns of doubles. Tasks count by themselves and send the digits that occur.
    """
    bins = 1 << width

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [np.zeros((len(p), bins), np.int64) for p in prefixes]
        for batch in batches:
            for c, known in enumerate(prefixes):
                codes = ordered_codes(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                top = codes >> np.uint64(64 - settled) if settled else np.zeros(len(codes), np.uint64)
                digit = (codes >> np.uint64(64 - settled - width)) & np.uint64(bins - 1)
                for k, prefix in enumerate(known):
                    tally[c][k] += np.bincount(digit[top == np.uint64(prefix)].astype(np.int64), minlength=bins)
        for c, counts in enumerate(tally):
            k, digit = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), c)), pa.array(k), pa.array(digit), pa.array(counts[k, digit])], ["c", "k", "digit", "n"]
            )

    found = numbers.mapInArrow(count, "c long, k long, digit long, n long").groupBy("c", "k", "digit").agg(F.sum("n").alias("n"))
    out = {(c, k): np.zeros(bins, np.int64) for c, known in enumerate(prefixes) for k in range(len(known))}
    for c, k, digit, n in found.collect():  # at most 8,192 per prefix
        out[c, k][digit] = n
    return out


def values_at(numbers: DataFrame, ranks: list[list[int]]) -> list[list[float]]:
    """Per column of `numbers` the values at the given 0-based ranks of its ascending order; exact.

    A radix select on order-preserving codes: each of five passes settles one more
    digit of every wanted value of every column. Nothing is sorted or dealt out;
    the driver holds a count per digit of the wanted values.
    """
    prefix = [[0] * len(r) for r in ranks]
    left = [list(r) for r in ranks]
    settled = 0
    for width in DIGITS:
        known = [sorted(set(p)) for p in prefix]
        counts = digit_counts(numbers, known, settled, width)
        for c, wanted in enumerate(left):
            for i, rank in enumerate(wanted):
                below = np.cumsum(counts[c, known[c].index(prefix[c][i])])
                digit = int(np.searchsorted(below, rank, side="right"))
                left[c][i] = rank - (int(below[digit - 1]) if digit else 0)
                prefix[c][i] = prefix[c][i] << width | digit
        settled += width
    return [[decoded(p) for p in column] for column in prefix]


def describe(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated quantiles per column.

    One pass for the moments and five for the quantiles, each over all columns;
    see `values_at`. NULLs are not counted; a column without values has NULLs.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    measures = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    row = numbers.agg(*[f(c) for c in numbers.columns for f in measures]).first()
    moments = [row[i * len(measures) : (i + 1) * len(measures)] for i in range(len(columns))]
    places = [[(n - 1) * s for s in shares] if n else [] for n, *_ in moments]
    found = values_at(numbers, [[r for p in at for r in (floor(p), ceil(p))] for at in places])

    def between(low: float, high: float, part: float) -> float:
        return low if low == high or not part else low + (high - low) * part

    rows = []
    for name, (n, mean, std, low, high), at, values in zip(columns, moments, places, found):
        picks = [between(values[2 * i], values[2 * i + 1], p - floor(p)) for i, p in enumerate(at)]
        rows.append((name, n, mean, std, low, *(picks or [None] * len(shares)), high))
    doubles = ["mean", "std", "min", *[f"p{round(s * 100)}" for s in shares], "max"]
    schema = "`column` string, count long, " + ", ".join(f"{c} double" for c in doubles)
    return df.sparkSession.createDataFrame(rows, schema)
