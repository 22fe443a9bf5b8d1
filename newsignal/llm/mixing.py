"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import same, unit_hash, unused
from newsignal.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
NONE = "(none)"
OTHER = "other"

# Words that stand for a topic, lower case.
TOPICS = {
    "licensing": ("license", "licensed", "licence", "copyright", "rights", "reserved", "lizenz", "licencia"),
    "contact": ("contact", "email", "mail", "phone", "call", "address", "kontakt", "contacto", "adresse"),
    "code": ("function", "return", "import", "class", "def", "var", "const", "print", "null"),
    "news": ("news", "report", "reported", "today", "yesterday", "government", "minister", "president"),
    "science": ("study", "research", "theory", "data", "experiment", "model", "analysis", "results"),
    "commerce": ("price", "buy", "sale", "market", "order", "shipping", "customer", "preis", "precio"),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def topic_hits(words: Column, topics: Mapping[str, Sequence[str]]) -> Column:
    """The topic words of a text, lower case and without what stands around their letters."""
    known = sorted({w for listed in topics.values() for w in listed})
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    return F.filter(plain, lambda w: w.isin(known))


def topic_of(hits: Column, topics: Mapping[str, Sequence[str]]) -> Column:
    """The topic with most words in the text, the first listed one of equals; `other` without any."""

    def count(listed: Sequence[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(list(listed))))

    counts = [
        F.struct(
            count(listed).alias("n"),
            F.lit(-i).alias("rank"),
            F.lit(topic).alias("topic"),
        )
        for i, (topic, listed) in enumerate(topics.items())
    ]
    best = F.greatest(*counts)["topic"] if len(counts) > 1 else counts[0]["topic"] if counts else F.lit(OTHER)
    return F.when(F.size(hits) == 0, F.lit(OTHER)).otherwise(best)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, target: shares of the tokens of a dimension, raised to `power` and scaled to 1."""
    tokens = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    return scaled(tokens.select("value", F.pow("n", F.lit(power)).alias("share")))


def given(cells: DataFrame, dimension: str, shares: Mapping[str, float]) -> DataFrame:
    """value, target from listed shares; values without tokens are left out and the rest scaled to 1."""
    rows = [(str(value), float(share)) for value, share in shares.items()]
    listed = cells.sparkSession.createDataFrame(rows, "value string, share double")
    seen = cells.where("tokens > 0").select(F.col(dimension).alias("value")).distinct()
    return scaled(listed.where("share > 0").join(seen, "value"))


def scaled(shares: DataFrame) -> DataFrame:
    total = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.select("value", (F.col("share") / total).alias("target"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """`cells` with `weight`, the share of tokens that the mix gives to a cell; weights sum to 1.

    One sweep scales the cells to the marginals of each dimension in turn. It
    stops when a sweep met no marginal off by more than `tolerance`, or after
    `sweeps`; cells whose value has no target get 0. The cells carry their
    targets and stay a distributed table; the driver sees one number a sweep.
    """
    weighted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        named = target.select(F.col("value").alias(dimension), F.col("target").alias(f"target_{dimension}"))
        weighted = weighted.join(named, dimension, "left")
    weighted = materialise(weighted.na.fill(0.0, [f"target_{d}" for d in targets]))
    for _ in range(sweeps):
        weighted = weighted.withColumn("off", F.lit(0.0))
        for dimension in targets:
            now, target = F.sum("weight"), F.max(f"target_{dimension}")
            marginal = weighted.groupBy(dimension).agg(
                F.when(now > 0, target / now).otherwise(0.0).alias("factor"), F.abs(now - target).alias("off_here")
            )
            weighted = (
                weighted.join(marginal, dimension)
                .withColumn("weight", F.col("weight") * F.col("factor"))
                .withColumn("off", F.greatest("off", "off_here"))
                .drop("factor", "off_here")
            )
        weighted = materialise(weighted)
        worst = weighted.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return weighted.drop("off", *[f"target_{d}" for d in targets])


def calibrated(weighted: DataFrame, share: float) -> DataFrame:
    """`weighted` with `probability`, at most 1, so that the expected tokens of a cell follow its weight.

    The mix holds `share` of all tokens, or less where a cell has too few: the
    scale is the largest at which no probability passes 1.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = weighted.withColumn("ratio", ratio)
    most, tokens, weights = rated.agg(F.max("ratio"), F.sum("tokens"), F.sum("weight")).first()
    scale = min(1 / most, share * tokens / weights) if most else 0.0
    return rated.withColumn("probability", F.least(F.col("ratio") * scale, F.lit(1.0)))


def document_facts(docs: DataFrame, names: Mapping[str, str], topics: Mapping[str, Sequence[str]]) -> DataFrame:
    """`docs` with the struct column `facts`: source, lang, topic, n_tokens."""

    def key(name: str) -> Column:
        return F.coalesce(F.col(names[name]).cast("string"), F.lit(NONE))

    def of_words(words: Column) -> Column:
        return same(
            topic_hits(words, topics),
            "f",
            lambda hits: F.struct(
                key("source").alias("source"),
                key("lang").alias("lang"),
                topic_of(hits, topics).alias("topic"),
                F.size(words).cast("long").alias("n_tokens"),
            ),
        )

    return docs.withColumn("facts", same(words_of(F.col(names["text"])), "f", of_words))


def mix_rates(facts: DataFrame, wanted: Mapping[str, Mapping[str, float] | float], share: float, sweeps: int, tolerance: float) -> DataFrame:
    """source, lang, topic, weight, probability of every cell; the last two to 7 places."""
    cells = materialise(facts.groupBy(*wanted).agg(F.sum("n_tokens").alias("tokens")))
    targets = {
        d: materialise(given(cells, d, t) if isinstance(t, Mapping) else tempered(cells, d, t)) for d, t in wanted.items()
    }
    rated = calibrated(raked(cells, targets, sweeps, tolerance), share)
    return materialise(
        rated.select(*wanted, F.round("weight", 7).alias("weight"), F.round("probability", 7).alias("probability"))
    )


def drawn(id_column: Column, n_tokens: Column, probability: Column, seed: str) -> Column:
    return (n_tokens > 0) & (unit_hash(id_column, seed) < probability)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    source_targets: Mapping[str, float] | float = 0.7,
    lang_targets: Mapping[str, float] | float = 0.8,
    topic_targets: Mapping[str, float] | float = 0.9,
    topics: Mapping[str, Sequence[str]] = TOPICS,
    share: float = 0.5,
    sweeps: int = 25,
    tolerance: float = 1e-12,
    seed: str = "mix",
    sampled_rows: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id_col, source, lang, topic, n_tokens, weight, probability, sampled.

    With `sampled_rows`, the sampled rows of `docs` with all their columns and
    mix_topic, mix_tokens, mix_weight, mix_probability, which replace own
    columns of these names.

    Tokens are blank-separated words. The cells of source, language and topic
    are raked to three marginals; a target is a mapping from value to share, or
    a number, the power that the observed shares are raised to. A document is
    sampled if a hash of its id falls below the probability of its cell.

    NULL sources and languages are the value `(none)`. Texts without words
    (also NULL) have no tokens and are never sampled. Rows with equal ids share
    the draw; NULL ids draw as the empty string.
    """
    names = {"text": text_col, "source": source_col, "lang": lang_col}
    wanted = {"source": source_targets, "lang": lang_targets, "topic": topic_targets}
    facts = document_facts(docs.select(id_col, *dict.fromkeys(names.values())), names, topics)
    facts = facts.select(F.col(id_col).alias("id"), "facts.*")
    if not sampled_rows:
        facts = materialise(facts)
    rates = mix_rates(facts, wanted, share, sweeps, tolerance)
    if not sampled_rows:
        return facts.join(rates, list(wanted)).select(
            F.col("id").alias(id_col),
            *wanted,
            "n_tokens",
            "weight",
            "probability",
            drawn(F.col("id"), F.col("n_tokens"), F.col("probability"), seed).alias("sampled"),
        )
    plain = docs.drop("mix_topic", "mix_tokens", "mix_weight", "mix_probability")
    whole, cell = unused(plain, "mix_row"), unused(plain, "mix_cell")
    nested = plain.select(F.struct("*").alias(whole), *[F.col(c) for c in dict.fromkeys(names.values())])
    nested = document_facts(nested, names, topics).select(whole, F.col("facts").alias(cell))
    rates = rates.select(F.struct(*wanted).alias("at"), "weight", "probability")
    at = F.struct(*[F.col(f"{cell}.{d}").alias(d) for d in wanted])
    row_id = F.col(f"{whole}.{id_col}")
    return (
        nested.join(rates, at == F.col("at"))
        .where(drawn(row_id, F.col(f"{cell}.n_tokens"), F.col("probability"), seed))
        .select(
            f"{whole}.*",
            F.col(f"{cell}.topic").alias("mix_topic"),
            F.col(f"{cell}.n_tokens").alias("mix_tokens"),
            F.col("weight").alias("mix_weight"),
            F.col("probability").alias("mix_probability"),
        )
    )
