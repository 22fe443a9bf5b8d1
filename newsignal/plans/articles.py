"""Raw articles to scored and long tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.functions.labels import five_way, signed, three_way
from newsignal.operators.cleaning import clean_articles
from newsignal.operators.lexicon import Rules, attach_daily_mean, lexicon_polarity
from newsignal.operators.mentions import finance_flag
from newsignal.operators.reshape import to_long
from newsignal.operators.scoring import Model, score_texts
from newsignal.session import materialise

LONG_IDS = ("date", "exception_flag", "finance_flag")
LONG_VALUES = ("lexicon_polarity", "mean_polarity", "polarity_class")


def polarity_table(
    articles: DataFrame, lexicon: DataFrame, key: str, rules: Rules = Rules(), text: str = "text"
) -> DataFrame:
    """(key, date, lexicon_polarity) of cleaned articles; texts are scored whole."""
    return lexicon_polarity(articles, lexicon, [key, "date"], text, rules)


def scored_articles(
    raw: DataFrame,
    lexicon: DataFrame,
    key: str,
    rules: Rules = Rules(),
    scorers: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """Clean, score, average per day and classify.

    `scorers` add their own columns, for example `scoring.score_text` with a
    model bound to it. The cleaned articles are written once, because both the
    scores and the wide rows they are joined to come from them.
    """
    clean = materialise(clean_articles(raw, key))
    polarity = polarity_table(clean, lexicon, key, rules)
    wide = clean.join(attach_daily_mean(polarity).drop("date"), key)
    for add in scorers:
        wide = add(wide)
    return wide.withColumns(
        {
            "polarity_class": five_way(F.col("lexicon_polarity")),
            "polarity_sign": three_way(F.col("lexicon_polarity")),
        }
    )


def long_table(scored: DataFrame, key: str, values: Sequence[str] = LONG_VALUES) -> DataFrame:
    """One row per article and score. The key stands for the text columns,
    which would otherwise be repeated once per score."""
    ids = [key, *[c for c in LONG_IDS if c in scored.columns]]
    return to_long(scored, ids, values)


def finance_long(
    raw: DataFrame,
    lexicon: DataFrame,
    key: str,
    models: Mapping[str, Model],
    terms: Sequence[str],
    rules: Rules = Rules(),
    **batches: int | None,
) -> DataFrame:
    """The long table of the articles that name one of the finance `terms`.

    Values are the lexicon polarity, its mean over all articles of the day, its
    class, and every model's label and score at full precision. The models see
    only the articles that stay, in one pass; `batches` go to `score_texts`.
    """
    clean = materialise(clean_articles(raw, key))
    polarity = attach_daily_mean(polarity_table(clean, lexicon, key, rules)).drop("date")
    financial = finance_flag(clean, terms).where("finance_flag = 1")
    fields = {f"{n}_{f}": F.col(f"{n}.{f}") for n in models for f in ("label", "score")}
    scored = score_texts(financial, "text", models, **batches).select(
        key, *LONG_IDS, *[c.alias(name) for name, c in fields.items()]
    )
    wide = scored.join(polarity, key).withColumn("polarity_class", five_way(F.col("lexicon_polarity")))
    return long_table(wide, key, (*LONG_VALUES, *fields))


def signed_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.withColumn(score, signed(F.col(label), F.col(score)))
