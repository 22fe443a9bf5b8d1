"""Batch scoring of texts with any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsignal.functions.labels import label_or_unknown
from newsignal.schemas import SCORE

# A scorer maps a batch of texts to a frame with columns label and score.
Scorer = Callable[[pd.Series], pd.DataFrame]


class Model(NamedTuple):
    """`load` returns the scorer; `max_words` cuts its input, by default texts stay whole."""

    load: Callable[[], Scorer]
    max_words: int | None = None


def first_words(texts: pd.Series, n: int | None) -> pd.Series:
    return texts if n is None else texts.map(lambda t: t if t is None else " ".join(t.split(None, n)[:n]))


def mini_batches(texts: pd.Series, rows: int, words: int | None) -> Iterator[pd.Series]:
    """The texts by length, at most `rows` at a time.

    A model pads the texts of a batch to its longest one. Texts of like length
    pad little, and a batch ends before `words` padded words are reached, though
    one text always fits.
    """
    sizes = texts.fillna("").str.count(r"\S+").sort_values(kind="stable")
    start = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or words is not None and size * (i - start + 1) > words):
            yield texts[sizes.index[start:i]]
            start = i
    if start < len(sizes):
        yield texts[sizes.index[start:]]


def score_texts(
    df: DataFrame, text: str, models: Mapping[str, Model], batch: int | None = None, batch_words: int | None = None
) -> DataFrame:
    """Adds a struct (label, score) per model, named like the model; own columns of these names are replaced.

    All models run in one pass over the texts: each row crosses to Python once.
    Models are loaded once per task. Texts arrive in Arrow batches and are handed
    over in mini-batches of up to `batch` rows and `batch_words` padded words,
    texts of like length together. Without a label a row gets UNKNOWN and 0.
    """
    found = T.StructType([T.StructField(name, SCORE) for name in models])

    @F.pandas_udf(found)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorers = {name: m.load() for name, m in models.items()}
        for texts in batches:
            texts = texts.reset_index(drop=True)
            out = {}
            for name, scorer in scorers.items():
                cut = first_words(texts, models[name].max_words)
                parts = [
                    scorer(part)[["label", "score"]].set_axis(part.index)
                    for part in mini_batches(cut, batch or max(len(cut), 1), batch_words)
                ]
                scored = pd.concat(parts).sort_index() if parts else pd.DataFrame({"label": [], "score": []})
                out[name] = scored.where(scored.notna(), None).to_dict("records")
            yield pd.DataFrame(out, columns=list(models))

    inside = [c for c in df.columns if c not in models]
    scored = df.select(*inside, run(F.col(text)).alias("_scored"))
    label, score = lambda n: F.col(f"_scored.{n}.label"), lambda n: F.col(f"_scored.{n}.score")
    return scored.select(
        *inside,
        *[
            F.struct(
                label_or_unknown(label(n)).alias("label"), F.coalesce(score(n), F.lit(0.0)).alias("score")
            ).alias(n)
            for n in models
        ],
    )


def score_text(
    df: DataFrame,
    text: str,
    load: Callable[[], Scorer],
    label: str = "label",
    score: str = "score",
    batch: int | None = None,
    max_words: int | None = None,
) -> DataFrame:
    """Adds a label and a score per row from one model; see `score_texts`."""
    scored = score_texts(df, text, {"_model": Model(load, max_words)}, batch)
    return scored.withColumns({label: F.col("_model.label"), score: F.col("_model.score")}).drop("_model")


class KeywordScorer:
    """Share of positive over all keyword hits; a plain stand-in for a model.

    POSITIVE when positive hits prevail, NEGATIVE when negative ones do, no
    label otherwise; the score is the size of the balance in [0, 1].
    """

    def __init__(self, positive: Sequence[str], negative: Sequence[str]):
        self.positive = "|".join(positive)
        self.negative = "|".join(negative)

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        body = texts.fillna("").str.lower()
        up, down = body.str.count(self.positive), body.str.count(self.negative)
        balance = (up - down) / (up + down).where(up + down > 0)
        label = pd.Series(pd.NA, index=texts.index, dtype="object")
        label = label.mask(balance > 0, "POSITIVE").mask(balance < 0, "NEGATIVE")
        return pd.DataFrame(
            {"label": label.where(label.notna(), None), "score": balance.abs().where(label.notna())}
        )


def text_classifier(
    labelled: DataFrame, text: str, label: str, features: int = 1 << 14, max_iter: int = 10
) -> PipelineModel:
    """A linear text model trained by Spark; scores without leaving the JVM."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol=label, probabilityCol="_probability",
            rawPredictionCol="_margin", predictionCol="_prediction", maxIter=max_iter, regParam=0.01,
        ),
    ]
    return Pipeline(stages=stages).fit(labelled)


def classify_text(df: DataFrame, model: PipelineModel, label: str = "label", score: str = "score") -> DataFrame:
    """Label and probability of that label from `text_classifier`."""
    positive = F.get(vector_to_array(F.col("_probability")), F.lit(1))
    out = model.transform(df).withColumns(
        {
            label: F.when(positive >= 0.5, "POSITIVE").otherwise("NEGATIVE"),
            score: F.greatest(positive, 1 - positive),
        }
    )
    return out.select(*df.columns, label, score)
