"""Article, price and page tables derived from the given tables.

The given tables hold no news and no prices. These derivations give every
operator inputs with the shape and the quirks of its real ones, and grow with
the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.operators.lexicon import Rules
from newsignal.sources.files import spread

FIRST_DAY = "2024-01-01"

# The corpus is invented prose, so some of its commonest words play the parts
# that negations, boosters and the contrast word play in a real language.
CORPUS_RULES = Rules(
    negations=("is", "not"), stronger=("the", "de"), weaker=("a", "of"), contrast="that"
)

# Entries of several words and a symbol, for words of the invented prose.
CORPUS_ENTRIES = {
    "of the": -1.3, "and of the": 2.4, "the and": 1.1, "in the": 0.7, "la de": -1.9, "der": 0.6, "on": -0.8,
    "worthless": -2.1, "|": -0.4, ":)": 2.0,
}

PHRASE_ROLES = Rules(
    negations=("is", "the is", "not"), stronger=("the", "de", "to the"), weaker=("a", "of the a"), contrast="that"
)

# Names that stand for companies in the invented prose.
CORPUS_TERMS = (
    ("OF", "Offshore Fund", "ticker"),
    ("THE", "Thea Group", "ticker"),
    ("La De", "La De Holdings", "company"),
    ("Of The", "Ofthe Industries", "company"),
    ("In the and", "Intheand Partners", "company"),
    ("Thanedble", "Thanedble Inc.", "company"),
    ("worthless", "Worthless & Co.", "company"),
)

CORPUS_PLACES = ("Thanedble", "Erthat", "Attion", "Deren", "Éaux")

KEYWORDS_UP = ("rely", "rest", "good", "great")
KEYWORDS_DOWN = ("worthless", "stupid", "idiot", "trash", "loser")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given(spark, sf_dir, "pages"), "page_id")


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated articles, with missing texts, error pages and padding."""
    text, n = F.col("text"), F.col("n_chars")
    dirty = (
        F.when(n < 10, "")
        .when(n < 60, "None")
        .when(text.contains("worthless"), F.concat(text, F.lit(" 403 forbidden")))
        .when(F.col("lang") == "fr", F.concat(F.lit("\u00a0\t"), text, F.lit("\u2003\n")))
        .otherwise(text)
    )
    return documents(spark, sf_dir).select(
        "doc_id", article_date().alias("date"), dirty.alias("text")
    )


def article_date():
    return F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.col("doc_id") % 30).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated articles, text unchanged."""
    return documents(spark, sf_dir).select(
        "doc_id", article_date().alias("date"), "text", "source"
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each event type per day: value over time, count as volume."""
    return (
        given(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count("*").alias("volume"),
        )
    )


def whole_mean(price: Column) -> Column:
    cents = F.sum((price * 100 + 0.5).cast("long"))
    return F.floor(cents / (F.count("*") * 100)).cast("double")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each brand per shipping day. The close is the mean price in whole
    units, taken from an exact sum of cents, so it does not depend on row order."""
    price = F.col("l_extendedprice")
    lines = given(spark, sf_dir, "lineitem").join(
        given(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.groupBy(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        whole_mean(price).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def text_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand bars as a price file delivers them: text, with halted days."""
    close = F.when(F.col("volume") >= 120, "halted").otherwise(
        F.col("close").cast("long").cast("string")
    )
    return brand_bars(spark, sf_dir).select(
        F.concat(F.col("date").cast("string"), F.lit(" 00:00:00+00:00")).alias("date"),
        F.lit(None).cast("string").alias("open"),
        F.floor("high").cast("string").alias("high"),
        F.floor("low").cast("string").alias("low"),
        close.alias("close"),
        F.col("volume").cast("string").alias("volume"),
        "ticker",
    )


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily index: mean order price in whole units."""
    return (
        given(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(whole_mean(F.col("o_totalprice")).alias("value"))
    )


def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of daily files, one per order."""
    return given(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".daily.csv.zip")).alias("text"),
    )
