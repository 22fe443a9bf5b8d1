"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import unit_hash

UNDETERMINED = "und"
BITS = 14
GRAMS = (2, 3, 4)
# Everything in ASCII but letters becomes a space.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets(text: str) -> np.ndarray:
    """Bucket numbers of all byte n-grams of the lower-cased words, word ends included."""
    plain = text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY)
    data = np.frombuffer(b" " + b" ".join(plain.split()) + b" ", np.uint8).astype(np.uint32)
    found, packed = [], data
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            break
        packed = (packed[:-1] << np.uint32(8)) | data[n - 1 :]
        if n in GRAMS:
            found.append((packed * np.uint32(2654435761 + 2 * n) + np.uint32(n)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def averaged(text: str) -> np.ndarray:
    """The share of each bucket among the n-grams of a text."""
    counts = np.bincount(buckets(text), minlength=1 << BITS).astype(np.float32)
    return counts / max(counts.sum(), 1.0)


@dataclass
class LanguageModel:
    """`scores` is embedding times output layer: logits are averages of its rows."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        logits = (averaged(text) @ self.scores + self.bias) / self.temperature
        p = softmax(logits[None])[0]
        best = int(p.argmax())
        return self.languages[best], min(float(p[best]), 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (where, share) in enumerate(rows):
        x[i, where] = share
    return x


def fit_softmax(rows, y: np.ndarray, n_labels: int, width: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over minibatches; returns embedding @ output and bias."""
    rng = np.random.default_rng(7)
    embedding = rng.uniform(-1 / width, 1 / width, (1 << BITS, width)).astype(np.float32)
    output = np.zeros((width, n_labels), np.float32)
    bias = np.zeros(n_labels, np.float32)
    step, steps = 0, max(1, epochs * -(-len(rows) // 32))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 32):
            batch = order[start : start + 32]
            x = dense([rows[i] for i in batch])
            hidden = x @ embedding
            slope = softmax(hidden @ output + bias)
            slope[np.arange(len(batch)), y[batch]] -= 1
            slope *= rate * (1 - step / steps)
            back = slope @ output.T
            output -= hidden.T @ slope
            bias -= slope.sum(0) / 32
            embedding -= x.T @ back
            step += 1
    return embedding @ output, bias


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows."""
    grid = np.geomspace(0.05, 20, 60)

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())

    return float(min(grid, key=loss))


def rejection_threshold(score: np.ndarray, correct: np.ndarray, risk: float) -> float:
    """The smallest score at which the accepted rows err at a rate of at most `risk`."""
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(~correct[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= risk)
    if not len(fine):
        return 1.0
    last = fine[-1]
    return 0.0 if last == len(order) - 1 else float(score[order[last]])


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    width: int = 16,
    epochs: int = 8,
    rate: float = 0.5,
    risk: float = 0.01,
) -> LanguageModel:
    """Fits on a bounded sample of `labelled`: about `per_language` documents of each language.

    The sample is drawn by a hash of the id, evenly over all rows, and its
    documents are read whole; the driver gets their n-gram shares, at most
    2**14 numbers a document. A fifth of the sample is held back for the
    temperature and for the rejection threshold, which lets at most `risk` of
    the accepted documents be wrong. Rows without a label or a letter are no
    examples. Without examples the model knows no language.
    """
    plain = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in plain.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    share = F.lit(None).cast("double")
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(per_language / counts[lang])).otherwise(share)
    draw = unit_hash(F.col("id"), "language-sample")

    def shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, share = [], []
            for text in batch.column(2).to_pylist():
                x = averaged(text)
                where.append(np.flatnonzero(x).astype(np.int32))
                share.append(x[where[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(where, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                ["lang", "draw", "bucket", "share"],
            )

    sample = (
        plain.withColumn("draw", draw)
        .where(F.col("draw") < share)
        .select("lang", "draw", "text")
        .mapInArrow(shares, "lang string, draw double, bucket array<int>, share array<float>")
        .toArrow()
    )
    rows = sorted(
        zip(
            sample.column("lang").to_pylist(),
            sample.column("draw").to_pylist(),
            (np.asarray(v.values) for v in sample.column("bucket")),
            (np.asarray(v.values) for v in sample.column("share")),
        ),
        key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()),
    )
    number = {lang: i for i, lang in enumerate(languages)}
    held = np.arange(len(rows)) % 5 == 4
    vectors = [(r[2], r[3]) for r in rows]
    y = np.array([number[r[0]] for r in rows])
    fit = np.flatnonzero(~held)
    scores, bias = fit_softmax([vectors[i] for i in fit], y[fit], len(languages), width, epochs, rate)
    check = np.flatnonzero(held)
    if not len(check):
        return LanguageModel(languages, scores, bias, 1.0, 0.0)
    logits = np.concatenate([dense([vectors[i]]) @ scores for i in check]) + bias
    temperature = temperature_of(logits, y[check])
    p = softmax(logits / temperature)
    threshold = rejection_threshold(p.max(1), p.argmax(1) == y[check], risk)
    return LanguageModel(languages, scores, bias, temperature, threshold)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """`docs` with the struct column `out`: lang_pred, score, rejected.

    Reads the text only, and all of it. Texts that are NULL or hold no letter
    get `und`, 0 and are rejected. A score below the model's threshold rejects
    too. Rows and other columns stay; an own column `out` is replaced.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts):
        import pandas as pd

        found = [model.predict(t) for t in texts]
        return pd.DataFrame(
            {
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
                "rejected": [f[0] == UNDETERMINED and f[1] == 0.0 or f[1] < model.reject_below for f in found],
            }
        )

    return docs.withColumn(out, predict(F.col(text_col)))


def fold(id_column: Column) -> Column:
    """0, 1 or 2 by the id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3
