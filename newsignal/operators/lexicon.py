"""Sentiment by joining tokens to a valence lexicon.

Rules and constants follow the published rule-based model of Hutto & Gilbert
(2014): boosters and negations up to three words back, emphasis by capitals and
punctuation, a contrast word that shifts weight to what follows, and
s / sqrt(s^2 + 15) as the normalised total.

Each candidate token carries its three predecessors, so no window and no
shuffle is needed before the map-side sums; one short row per article is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.operators.candidates import listed_words, positions
from newsignal.operators.joins import per_day
from newsignal.operators.phrases import normal, phrases_of, symbols_of, units
from newsignal.session import materialise

SHOUTED = r"^\p{Lu}{2,}$"

# A small own lexicon; any (term, valence) table can take its place.
DEFAULT_VALENCES = {
    "advance": 1.2, "agree": 1.3, "amazing": 2.8, "approve": 1.6, "award": 2.2,
    "benefit": 1.9, "best": 3.0, "better": 1.8, "boost": 1.7, "bright": 1.8,
    "calm": 1.2, "celebrate": 2.6, "clean": 1.5, "confident": 2.1, "delight": 2.9,
    "easy": 1.7, "enjoy": 2.2, "excellent": 2.9, "fair": 1.3, "favor": 1.6,
    "fine": 0.9, "gain": 1.8, "good": 1.9, "grand": 1.9, "great": 3.0,
    "growth": 1.7, "happy": 2.7, "help": 1.6, "hope": 1.9, "improve": 1.8,
    "love": 3.1, "nice": 1.8, "outperform": 2.0, "peace": 2.4, "praise": 2.5,
    "profit": 1.9, "progress": 1.8, "rally": 1.3, "recover": 1.5, "rely": 1.1,
    "rest": 0.8, "rise": 1.1, "safe": 1.9, "secure": 1.5, "strong": 2.2,
    "success": 2.6, "support": 1.6, "surge": 1.2, "trust": 2.3, "upbeat": 2.1,
    "win": 2.7, "wonderful": 2.8,
    "abuse": -3.1, "accident": -2.0, "afraid": -1.9, "anger": -2.6, "attack": -2.2,
    "awful": -2.1, "bad": -2.5, "bankrupt": -2.6, "blame": -1.4, "clown": -1.2,
    "collapse": -2.2, "conflict": -1.4, "crash": -1.9, "crime": -2.5, "crisis": -2.9,
    "damage": -2.1, "danger": -2.3, "dead": -3.2, "decline": -1.4, "default": -1.3,
    "disaster": -3.1, "disgusting": -2.5, "downgrade": -1.7, "fail": -2.4, "fall": -1.0,
    "fear": -2.2, "fraud": -2.8, "garbage": -2.0, "guilty": -1.9, "hate": -2.8,
    "hurt": -2.3, "idiot": -2.4, "kill": -3.5, "lawsuit": -1.4, "layoff": -1.8,
    "loser": -2.3, "loss": -1.6, "miss": -0.8, "moron": -2.5, "panic": -2.3,
    "pathetic": -2.6, "poor": -2.0, "problem": -1.6, "recession": -2.0, "risk": -1.1,
    "sad": -2.1, "slump": -1.7, "stupid": -2.4, "terrible": -2.4, "threat": -2.3,
    "trash": -1.7, "ugly": -2.2, "war": -2.9, "weak": -1.8, "worry": -1.9,
    "worst": -3.0, "worthless": -2.1,
}

NEGATIONS = (
    "ain't", "aren't", "can't", "cannot", "couldn't", "didn't", "doesn't", "don't",
    "hadn't", "hasn't", "haven't", "isn't", "neither", "never", "no", "nobody",
    "none", "nor", "not", "nothing", "nowhere", "shouldn't", "wasn't", "weren't",
    "without", "won't", "wouldn't",
)

STRONGER = (
    "absolutely", "completely", "deeply", "especially", "exceptionally", "extremely",
    "fully", "greatly", "highly", "hugely", "incredibly", "more", "most",
    "particularly", "really", "remarkably", "so", "strongly", "totally", "very",
)

WEAKER = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally",
    "partly", "scarcely", "slightly", "somewhat", "sorta",
)


@dataclass(frozen=True)
class Rules:
    """Word roles and the published constants."""

    negations: Sequence[str] = NEGATIONS
    stronger: Sequence[str] = STRONGER
    weaker: Sequence[str] = WEAKER
    contrast: str = "but"
    boost: float = 0.293
    negate: float = -0.74
    capitals: float = 0.733
    fade: Sequence[float] = (1.0, 0.95, 0.9)
    before_contrast: float = 0.5
    after_contrast: float = 1.5
    exclamation: float = 0.292
    most_exclamations: int = 4
    question: float = 0.18
    many_questions: float = 0.96
    alpha: float = 15.0
    symbols: Sequence[str] = ()
    phrases: Sequence[str] = ()


def rules_for(terms: Iterable[str], rules: Rules = Rules()) -> Rules:
    """Rules that also meet the emoticons, hyphenated words and phrases among the
    lexicon's terms and the rules' own words."""
    roles = {"negations": rules.negations, "stronger": rules.stronger, "weaker": rules.weaker}
    entries = [*terms, *(e for words in roles.values() for e in words)]
    symbols = symbols_of(entries)
    roles = {name: tuple(normal(e, symbols) for e in words) for name, words in roles.items()}
    return replace(rules, symbols=symbols, phrases=phrases_of(entries, symbols), **roles)


def lexicon_table(spark: SparkSession, valences: Mapping[str, float] = DEFAULT_VALENCES) -> DataFrame:
    """A (term, valence) table. Built from Arrow, so its size is known to the
    planner and small ones are broadcast without a hint."""
    return spark.createDataFrame(
        pa.table({"term": list(valences), "valence": [float(v) for v in valences.values()]})
    )


def _candidates(
    df: DataFrame, keys: Sequence[str], text: str, rules: Rules, terms: list[str] | None
) -> DataFrame:
    """One row per token that may be in the lexicon, with its three predecessors
    and the article's marks. An article without candidates keeps one NULL row."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = df.select(
        *keys,
        units(body, rules.symbols, rules.phrases).alias("_t"),
        (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).alias("_bang"),
        (F.length(body) - F.length(F.replace(body, F.lit("?"), F.lit("")))).alias("_ask"),
    )
    raw, low = F.col("_t"), F.col("_l")

    def loud(token: Column) -> Column:
        return (F.replace(token, F.lit(" "), F.lit("")) if rules.phrases else token).rlike(SHOUTED)

    marked = tokens.select(
        "*",
        F.transform(raw, F.lower).alias("_l"),
        (
            F.exists(raw, loud) & F.exists(raw, lambda t: ~loud(t))
        ).alias("_mixed"),
    )

    def with_predecessors(i: Column) -> Column:
        return F.struct(
            i.alias("at"),
            F.get(low, i).alias("word"),
            *[F.get(low, i - k).alias(f"back{k}") for k in (1, 2, 3)],
            *[loud(F.get(raw, i - k)).alias(f"loud{k}") for k in (0, 1, 2, 3)],
        )

    found = F.transform(positions(low, terms), with_predecessors)
    rows = marked.select(
        *keys, "_bang", "_ask", "_mixed",
        (F.array_position(low, rules.contrast) - 1).alias("_turn"),
        F.explode_outer(found).alias("_z"),
    )
    names = ("at", "word", "back1", "back2", "back3", "loud0", "loud1", "loud2", "loud3")
    return rows.select(
        *keys, "_bang", "_ask", "_mixed", "_turn", *[F.col(f"_z.{n}").alias(f"_{n}") for n in names]
    )


def _contribution(rules: Rules, capitals: bool) -> Column:
    """Valence of one token after all rules, in millionths, as an integer.

    Integers make the article total independent of the order of addition.
    """
    base = F.col("valence")
    sign = F.signum(base)

    def louder(k: int) -> Column:
        return F.when(F.col(f"_loud{k}"), rules.capitals).otherwise(0.0) if capitals else F.lit(0.0)

    value = base + sign * louder(0)
    for k in (1, 2, 3):
        word = F.col(f"_back{k}")
        # A weaker word in capitals lowers the score further.
        nudge = (
            F.when(word.isin(*rules.stronger), F.lit(rules.boost) + louder(k))
            .when(word.isin(*rules.weaker), -(F.lit(rules.boost) + louder(k)))
            .otherwise(0.0)
        )
        value = value + sign * nudge * rules.fade[k - 1]
        value = value * F.when(word.isin(*rules.negations), rules.negate).otherwise(1.0)
    shifted = (
        F.when(F.col("_turn") < 0, value)
        .when(F.col("_at") < F.col("_turn"), value * rules.before_contrast)
        .when(F.col("_at") > F.col("_turn"), value * rules.after_contrast)
        .otherwise(value)
    )
    return F.round(shifted * 1e6).cast("long")


def lexicon_polarity(
    df: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    rules: Rules = Rules(),
    name: str = "lexicon_polarity",
) -> DataFrame:
    """(keys, name): polarity in [-1, 1] of every article, over its whole text.

    Terms are single words unless `rules` come from `rules_for`, which makes
    phrases and symbols of the lexicon known. Terms must differ as tokens.
    """
    term = F.col("term")
    if rules.symbols or rules.phrases:
        term = F.lower(F.array_join(units(term, rules.symbols), " "))
    lexicon = lexicon.select(term.alias("_word"), "valence")
    rows = _candidates(df, keys, text, rules, listed_words(lexicon, "_word"))
    totals = (
        rows.join(lexicon, "_word", "left")
        .groupBy(*keys, "_bang", "_ask", "_mixed")
        .agg(
            F.coalesce(F.sum(_contribution(rules, False)), F.lit(0)).alias("_plain"),
            F.coalesce(F.sum(_contribution(rules, True)), F.lit(0)).alias("_capital"),
        )
    )
    total = F.when(F.col("_mixed"), F.col("_capital")).otherwise(F.col("_plain")) / 1e6
    emphasis = F.least(F.col("_bang"), F.lit(rules.most_exclamations)) * rules.exclamation + (
        F.when(F.col("_ask") > 3, rules.many_questions)
        .when(F.col("_ask") > 1, F.col("_ask") * rules.question)
        .otherwise(0.0)
    )
    marked = F.col("_s") + F.signum("_s") * F.col("_e")
    return (
        totals.select(*keys, total.alias("_s"), emphasis.alias("_e"))
        .select(*keys, marked.alias("_s"))
        .select(*keys, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + rules.alpha)).alias(name))
    )


def daily_mean(scored: DataFrame, score: str = "lexicon_polarity", name: str = "mean_polarity") -> DataFrame:
    """Mean score per day; rows without a day are left out."""
    return scored.where(F.col("date").isNotNull()).groupBy("date").agg(F.avg(score).alias(name))


def attach_daily_mean(scored: DataFrame, score: str = "lexicon_polarity", name: str = "mean_polarity") -> DataFrame:
    """Every article with the mean of its day.

    The scores are written once and read twice: for the mean and for the join, to
    which the mean comes as one row per calendar day. A window would put a busy
    day's articles into one task.
    """
    scored = materialise(scored)
    return scored.join(per_day(daily_mean(scored, score, name)), "date")
