"""Finance relevance: keyword flag and entity mentions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.functions.text import contains_any, words
from newsignal.session import materialise

# Words that mark finance news without naming a company.
GENERIC_TERMS = {
    "Wall Street": "Market General",
    "Finance": "Sector General",
    "Trade": "Economic Activity",
    "Gold": "Commodity: Gold",
    "Oil": "Commodity: Oil",
}


def term_table(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(term, entity, kind) dictionary; kind is ticker, company or generic."""
    term, entity, kind = zip(*rows)
    return spark.createDataFrame(
        pa.table({"term": list(term), "entity": list(entity), "kind": list(kind)})
    )


def generic_terms(spark: SparkSession) -> DataFrame:
    return term_table(spark, [(t, e, "generic") for t, e in GENERIC_TERMS.items()])


def finance_flag(df: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """`finance_flag` = 1 where any term occurs as a substring, case ignored.

    For lists of a few hundred terms; larger dictionaries and whole-word
    matching use `entity_mentions`.
    """
    return df.withColumn("finance_flag", contains_any(F.col(text), terms, True).cast("int"))


def anchored_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per term, filed under the word of it that is rarest in the texts.

    anchor, offset (the words before it), n, words, exact, entity. Of equally rare
    words the first is taken; a term with a word that no text has is left out.
    Words are compared in small letters here, so that both kinds can share an anchor.
    """
    cut = terms.select(
        words(F.col("term")).alias("words"), (F.col("kind") == "ticker").alias("exact"), "entity"
    ).where(F.size("words") > 0)
    cut = cut.distinct()
    each = cut.select("words", "exact", "entity", F.posexplode("words").alias("offset", "word"))
    each = each.withColumn("anchor", F.lower("word"))
    known = each.select("anchor").distinct()
    counts = (
        tokens.select(F.explode("_l").alias("anchor")).join(known, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "anchor"))
    filed = each.join(counts, "anchor", "left").groupBy("words", "exact", "entity").agg(rarest.alias("a"))
    return filed.where("a.n > 0").select(
        "a.anchor",
        "a.offset",
        F.size("words").alias("n"),
        F.when(F.col("exact"), F.col("words")).otherwise(F.transform("words", F.lower)).alias("words"),
        "exact",
        "entity",
    )


def entity_mentions(df: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity, mentions): whole-word mentions of dictionary terms.

    Words of text and terms are cut alike. Tickers match with their case, other
    kinds ignore it. Terms are filed under their rarest word, so a word that many
    terms begin with is not what texts and terms meet on. A token carries the
    words around it, as many as the longest terms need; where it meets a term,
    the term is compared in place. Counts are combined before the shuffle. NULL
    texts and terms without a word have no mentions; terms that name an entity
    twice count once.
    """
    tokens = df.select(F.col(key).alias("_key"), words(F.col(text)).alias("_t")).select(
        "_key", "_t", F.transform("_t", F.lower).alias("_l")
    )
    filed = materialise(anchored_terms(tokens, terms))
    before, after = filed.agg(F.max("offset"), F.max(F.col("n") - F.col("offset"))).first()
    before, after = before or 0, after or 1
    place = lambda i: F.least(i, F.lit(before))
    around = F.transform(
        "_t",
        lambda w, i: F.struct(
            F.lower(w).alias("anchor"), F.slice("_t", i - place(i) + 1, place(i) + after).alias("near"), place(i).alias("at")
        ),
    )
    rows = tokens.select("_key", F.explode(around).alias("z")).select("_key", "z.*")
    start = F.col("at") - F.col("offset") + 1
    found = F.slice("near", F.greatest(start, F.lit(1)), F.col("n"))
    same_words = F.when(F.col("exact"), found).otherwise(F.transform(found, F.lower)) == F.col("words")
    return (
        rows.join(filed, "anchor")
        .where((start >= 1) & same_words)
        .groupBy(F.col("_key").alias(key), "entity")
        .agg(F.count("*").alias("mentions"))
    )


def flag_by_mentions(df: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """`finance_flag` = 1 for articles with at least one mention."""
    found = mentions.select(key, F.lit(1).alias("_found")).distinct()
    return (
        df.join(found, key, "left")
        .withColumn("finance_flag", F.coalesce("_found", F.lit(0)))
        .drop("_found")
    )
