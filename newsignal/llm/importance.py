"""Importance resampling: ratio of hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import unit_hash
from newsignal.llm.near_dups import WordHashes, mixed
from newsignal.session import materialise

BITS = 14
CUTS = 4096


def features(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words of a text, A-Z lower cased."""
    words = (text or b"").lower().split()
    one = mixed(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    two = mixed(one[:-1] * np.uint64(3) + one[1:])
    return (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts per bucket over all documents and over the target ones; `docs` has text, target.

    Each task adds up its documents; the driver gets 2**14 pairs of numbers.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.bincount(features(text, hashes), minlength=1 << BITS)
                total[0] += here
                if target:
                    total[1] += here
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(total[0][met]), pa.array(total[1][met])], ["bucket", "raw", "target"]
        )

    plain = docs.select(F.col("text").cast("binary").alias("text"), "target")
    rows = (
        plain.mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    where = rows.column("bucket").to_numpy()
    raw[where], target[where] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), both with one count added to every bucket."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """id, n_features and log_weight, the sum of the log ratios of a document's features."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [features(text, hashes) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([float(ratio[f].sum()) if len(f) else None for f in found], pa.float64()),
                ],
                ["id", "n_features", "log_weight"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        weigh, f"id {kind}, n_features long, log_weight double"
    )


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column `key`, exactly; the smallest one if there are fewer.

    Cuts the range that holds it into equal parts, counts each part and goes on
    with the part that holds it, until all values in it are equal.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n:
        return None
    k = min(max(k, 1), n)
    above = 0
    while low < high:
        part = F.least(F.floor((F.col("key") - low) / (high - low) * CUTS), F.lit(CUTS - 1))
        parts = (
            keys.where(F.col("key").between(low, high))
            .groupBy(part.alias("part"))
            .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            .orderBy(F.desc("low"))
            .collect()
        )
        for p in parts:
            if above + p.n >= k:
                low, high = p.low, p.high
                break
            above += p.n
    return low


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    share: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = 20_000,
    seed: str = "resample",
) -> DataFrame:
    """One row per row of `docs`: id_col, n_features, log_weight, key, sampled.

    `target` (column id_col) names documents that the result should resemble;
    the target model is fitted on about `target_rows` of them, drawn evenly by a
    hash of the id, the raw model on all documents. A document's key is its log
    weight plus Gumbel noise from a hash of its id, and the documents with the
    largest keys are sampled: `share` of all that have words. This draws without
    replacement in proportion to the weights.

    NULL and blank texts have no features, a NULL weight and are never sampled.
    Rows with equal keys, as repeated rows have, are sampled together. NULL ids
    draw as the empty string and are no target. Without any target all weights
    are equal. Other columns are not read.
    """
    wanted = materialise(target.select(F.col(id_col).alias("id")).where("id is not null").distinct())
    part = F.lit(target_rows / max(wanted.count(), 1))
    chosen = wanted.where(unit_hash(F.col("id"), seed + "-target") < part).withColumn("target", F.lit(True))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most some target_rows ids.
    raw, aim = bucket_counts(plain.join(F.broadcast(chosen), "id", "left"))
    ratio = log_ratio(raw, aim) if aim.any() else np.zeros(len(raw))
    gumbel = -F.log(-F.log(unit_hash(F.col("id"), seed)))
    keys = materialise(weighed(plain, ratio).withColumn("key", F.col("log_weight") + gumbel))
    words = keys.where("key is not null")
    k = round(share * words.count())
    least = kth_largest(words, k) if k else None
    sampled = F.lit(False) if least is None else F.coalesce(F.col("key") >= least, F.lit(False))
    return keys.select(F.col("id").alias(id_col), "n_features", "log_weight", "key", sampled.alias("sampled"))
