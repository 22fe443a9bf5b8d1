"""Registered queries: every operator over whole given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.functions import html, labels
from newsignal.functions import text as tx
from newsignal.operators import (
    cleaning,
    indicators,
    joins,
    lexicon,
    mentions,
    metrics,
    model,
    ordered,
    reshape,
    scoring,
    tokens,
)
from newsignal.plans import articles as article_plan
from newsignal.plans import tables
from newsignal.plans.stocks import stock_features
from newsignal.schemas import INDEX_COLUMNS
from newsignal.session import materialise, shared_folder
from newsignal.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]

PLACES = (*cleaning.US_PLACES, *tables.CORPUS_PLACES)
FLAG_TERMS = (*mentions.GENERIC_TERMS, "THREE", "aulich")
LINK_DATES = {"start": "1996-02-26", "stop": "2000-11-10", "late": "1998-03-23"}
SPLIT_DATES = ("1999-06-30", "1999-07-15")


def rounded(df: DataFrame, places: int = 6, *only: str) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, places) for c in doubles if not only or c in only})


# Articles


def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, date, lexicon_polarity) of the derived articles."""
    source = tables.articles(spark, sf_dir)
    return article_plan.polarity_table(
        source, lexicon.lexicon_table(spark), "doc_id", tables.CORPUS_RULES
    )


def clean_articles(spark, sf_dir):
    out = cleaning.clean_articles(tables.raw_articles(spark, sf_dir), "doc_id")
    return out.select(
        "doc_id", "date", "exception_flag", F.md5("text").alias("text_md5"),
        F.md5("trimmed_text").alias("trimmed_md5"), F.length("trimmed_text").alias("trimmed_length"),
    )


def scored_articles(spark, sf_dir):
    scored = article_plan.scored_articles(
        tables.raw_articles(spark, sf_dir), lexicon.lexicon_table(spark), "doc_id", tables.CORPUS_RULES
    )
    return rounded(scored.withColumn("text_md5", F.md5("text")).drop("text", "trimmed_text"))


def clean_daily_sentiment(spark, sf_dir):
    clean = cleaning.clean_articles(tables.raw_articles(spark, sf_dir), "doc_id")
    scored = article_plan.polarity_table(
        clean, lexicon.lexicon_table(spark), "doc_id", tables.CORPUS_RULES
    )
    return rounded(lexicon.daily_mean(scored))


def dedupe_articles(spark, sf_dir):
    docs = tables.given(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return cleaning.dedupe(docs, "doc_id", wide=["text"]).select(
        "doc_id", "lang", F.md5("text").alias("text_md5")
    )


def null_profile(spark, sf_dir):
    raw = tables.raw_articles(spark, sf_dir)
    return cleaning.null_profile(
        raw.withColumn("text", tx.empty_to_null(F.col("text"), cleaning.MISSING_TEXTS))
    )


def describe_numeric(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = tables.given(spark, sf_dir, "lineitem").select(*columns)
    return rounded(metrics.describe(lines, columns), 4)


def date_flags(spark, sf_dir):
    return cleaning.date_flags(tables.file_links(spark, sf_dir), **LINK_DATES)


def any_of_filter(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return cleaning.keep_any_of(docs, "text", PLACES).select("doc_id", "source")


def finance_flag(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return mentions.finance_flag(docs, FLAG_TERMS).select("doc_id", "finance_flag")


def found_mentions(spark, sf_dir):
    terms = mentions.term_table(
        spark,
        [*tables.CORPUS_TERMS, *[(t, e, "generic") for t, e in mentions.GENERIC_TERMS.items()]],
    )
    return mentions.entity_mentions(tables.articles(spark, sf_dir), terms, "doc_id")


def lexicon_polarity(spark, sf_dir):
    return rounded(polarity(spark, sf_dir))


def phrase_polarity(spark, sf_dir):
    """Polarity by a lexicon of words, phrases and symbols; line ends bear an emoticon."""
    docs = tables.articles(spark, sf_dir)
    smiling = docs.withColumn("text", F.replace("text", F.lit(".\n"), F.lit(" :).\n")))
    rules = lexicon.rules_for(tables.CORPUS_ENTRIES, tables.PHRASE_ROLES)
    table = lexicon.lexicon_table(spark, tables.CORPUS_ENTRIES)
    return rounded(article_plan.polarity_table(smiling, table, "doc_id", rules))


def daily_sentiment(spark, sf_dir):
    return rounded(lexicon.daily_mean(polarity(spark, sf_dir)))


def daily_sentiment_attach(spark, sf_dir):
    return rounded(lexicon.attach_daily_mean(polarity(spark, sf_dir)))


def polarity_class5(spark, sf_dir):
    scored = polarity(spark, sf_dir)
    return scored.select("doc_id", labels.five_way(F.col("lexicon_polarity")).alias("polarity_class"))


def polarity_class3(spark, sf_dir):
    scored = polarity(spark, sf_dir)
    return scored.select("doc_id", labels.three_way(F.col("lexicon_polarity")).alias("polarity_class"))


def load_keyword_scorer():
    return scoring.KeywordScorer(tables.KEYWORDS_UP, tables.KEYWORDS_DOWN)


def keyword_scored(spark, sf_dir):
    docs = tables.articles(spark, sf_dir)
    return scoring.score_text(docs, "text", load_keyword_scorer, batch=32)


def score_text(spark, sf_dir):
    return rounded(keyword_scored(spark, sf_dir).select("doc_id", "label", "score"))


def signed_score(spark, sf_dir):
    scored = article_plan.signed_scores(keyword_scored(spark, sf_dir), "label", "score")
    return rounded(scored.select("doc_id", "label", "score"))


def classified(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    known = docs.join(tables.given(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    fitted = scoring.text_classifier(known, "text", "quality")
    return scoring.classify_text(docs, fitted)


def classify_text(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "label", "score")


def long_articles(spark, sf_dir):
    scored = lexicon.attach_daily_mean(polarity(spark, sf_dir))
    places = "decimal(12,4)"
    wide = scored.select(
        "doc_id",
        "date",
        labels.five_way(F.col("lexicon_polarity")).alias("polarity_class"),
        F.col("lexicon_polarity").cast(places).alias("lexicon_polarity"),
        F.col("mean_polarity").cast(places).alias("mean_polarity"),
    )
    return article_plan.long_table(wide, "doc_id")


def long_type_slice(spark, sf_dir):
    return reshape.slice_of(long_articles(spark, sf_dir), "lexicon_polarity")


def token_ids(spark, sf_dir):
    return tokens.vocabulary(tables.articles(spark, sf_dir), "doc_id")


def encode_tokens(spark, sf_dir):
    docs = tables.articles(spark, sf_dir)
    return tokens.encode(docs, tokens.vocabulary(docs, "doc_id"), "doc_id")


def latest_articles(spark, sf_dir):
    docs = tables.articles(spark, sf_dir).select("doc_id", "date", "source")
    return cleaning.latest(docs, 100, key="doc_id")


def batch_ids(spark, sf_dir):
    keys = tables.given(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ordered.batch_ids(keys, "o_orderkey", 5000)


def union_sources(spark, sf_dir):
    docs = tables.given(spark, sf_dir, "documents")
    talk = tables.given(spark, sf_dir, "conversations")
    marks = tables.given(spark, sf_dir, "benchmark")
    digest = F.md5("text").alias("text_md5")
    return cleaning.union_all(
        docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang", digest),
        talk.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "role", digest),
        marks.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), digest),
    )


# Pages


def html_links(spark, sf_dir):
    pages = tables.pages(spark, sf_dir)
    found = pages.select("page_id", F.posexplode(html.links(F.col("html"))).alias("pos", "link"))
    return found.select("page_id", "pos", "link.text", "link.url")


def html_paragraphs(spark, sf_dir):
    pages = tables.pages(spark, sf_dir)
    return pages.select("page_id", F.posexplode(html.paragraphs(F.col("html"))).alias("pos", "text"))


def html_text(spark, sf_dir):
    pages = tables.pages(spark, sf_dir)
    return pages.select("page_id", html.article_text(F.col("html")).alias("text"))


def url_parts(spark, sf_dir):
    url = F.col("url")
    return tables.given(spark, sf_dir, "pages").select(
        "page_id",
        tx.first_digits(url).alias("digits"),
        tx.domain(url).alias("domain"),
        tx.strip_protocol(url).alias("bare_url"),
        tx.strip_protocol(url, https=False).alias("bare_http"),
        tx.cut_last_dot(tx.strip_protocol(url)).alias("without_suffix"),
        tx.slug(url).alias("slug"),
    )


def domains_distinct(spark, sf_dir):
    pages = tables.given(spark, sf_dir, "pages")
    return pages.select(tx.domain(F.col("url")).alias("domain")).distinct()


# Files


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bar_files(spark, sf_dir):
    """Bars written as CSV files of two shapes into one folder, and read back as one table."""
    bars = tables.text_bars(spark, sf_dir)
    path, odd = folder(spark, "bars"), F.pmod(F.regexp_extract("ticker", "([0-9]+)$", 1).cast("int"), F.lit(2)) == 1
    sinks.write_csv(bars.where(~odd), path, by=None)
    turned = bars.where(odd).select("ticker", F.lit("0").alias("Adj Close"), "Volume", "Close", "Low", "High", "Date")
    sinks.write_csv(turned, path, by=None, mode="append")
    return files.read_bars(spark, path)


def article_files(spark, sf_dir):
    """Articles with line breaks and quotes through CSV files."""
    raw = tables.raw_articles(spark, sf_dir)
    noisy = F.concat(F.lit('He said "'), F.regexp_replace("text", " ", "\n"), F.lit('", \\ or ""so""'))
    path = folder(spark, "articles")
    sinks.write_csv(raw.select("date", noisy.alias("text")), path, by=None)
    return files.read_articles(spark, path).select("date", F.md5("text").alias("text_md5"))


def parquet_by_day(spark, sf_dir):
    """Articles written by day, one day written anew, and read with the file's suffix cut off."""
    path = folder(spark, "by-day")
    docs = tables.articles(spark, sf_dir).select("doc_id", "date", "source")
    sinks.write_parquet(docs, path)
    again = docs.where(F.col("date") == F.lit(tables.FIRST_DAY)).withColumn("source", F.lit("again"))
    sinks.write_parquet(again, path, days_only=True)
    back = files.read_parquet(spark, path, drop_names_like="gkgcounts")
    return back.select("doc_id", "date", "source", F.col("file_stem").endswith(".parquet").alias("has_suffix"))


def fetch_stub(url: str) -> tuple[int, str]:
    """Stands in for the web: the outcome depends on a digest of the address."""
    digit = hashlib.md5(url.encode()).hexdigest()[0]
    if digit == "0":
        raise TimeoutError("too slow")
    return (404, "") if digit in "123" else (200, f"<p> {url} </p><p>end</p>")


def fetch_outcomes(spark, sf_dir):
    pages = files.fetch_outcome(files.fetch_pages(tables.pages(spark, sf_dir).select("url"), fetch_stub))
    text = F.when(F.col("status") == 200, html.article_text(F.col("html")))
    return pages.groupBy("outcome").agg(F.count("*").alias("pages"), F.max(text).alias("last_text"))


def fetch_once(spark, sf_dir):
    """Page addresses without their query part, many named more than once, and one row in nine without any."""
    pages = tables.given(spark, sf_dir, "pages")
    named = pages.select("page_id", F.when(F.col("page_id") % 9 > 0, F.concat(tx.domain("url"), F.lit("/"), (F.col("page_id") % 50).cast("string"))).alias("url"))
    return files.fetch_once(named, fetch_stub).select("page_id", "url", "status", "html", "error")


def index_rows(spark, sf_dir):
    """Index lines with header lines, several addresses in a field, and none."""
    pages = tables.given(spark, sf_dir, "pages")
    both = F.concat("url", F.lit("<UDIV>http://second.org/"), "page_id")
    urls = F.when(F.col("page_id") % 3 == 0, both).when(F.col("page_id") % 5 > 0, F.col("url"))
    day = F.when(F.col("page_id") % 7 == 0, "DATE").when(F.col("page_id") % 11 > 0, F.concat(F.lit("201602"), (F.col("page_id") % 20 + 10).cast("string")))
    cells = {0: day, 4: F.concat(F.lit("Texas;"), F.col("page_id")), 10: urls}
    raw = pages.select(*[cells.get(i, F.lit("x")).alias(f"c{i}") for i in range(11)])
    return files.combine_index(files.without_header(files.select_positions(raw, INDEX_COLUMNS)))


def archive_names(spark, sf_dir):
    links = tables.file_links(spark, sf_dir)
    return links.select("o_orderkey", tx.swap_suffix(F.col("text")).alias("stored_as"))


def table_page(spark, sf_dir):
    """Rows 200 to 299 of the bars by ticker and date, without two columns."""
    return cleaning.page(tables.brand_bars(spark, sf_dir).drop("high", "low", "absent"), 200, 100, "ticker", "date")


def one_order(spark, sf_dir):
    orders = tables.given(spark, sf_dir, "orders")
    return orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


def recent_events(spark, sf_dir):
    """Events of the ten years before today."""
    events = tables.given(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return cleaning.since_days(events, 3650).groupBy("event_type").agg(F.count("*").alias("events"), F.min("date").alias("first_day"))


# Bars


def on_bars(operator: Callable[[DataFrame], DataFrame], columns: Sequence[str], places: int = 3) -> Query:
    """An indicator over the brand bars, with the columns it adds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(tables.brand_bars(spark, sf_dir))
        return rounded(out.select("ticker", "date", *columns), places)

    return query


def bars_clean(spark, sf_dir):
    skip = ("Brand#1", "Brand#24")
    return cleaning.clean_bars(tables.text_bars(spark, sf_dir), skip)


def vix_left_join(spark, sf_dir):
    bars, series = tables.brand_bars(spark, sf_dir), tables.order_series(spark, sf_dir)
    out = joins.left_join_series(bars, series, "vix_close")
    return rounded(out.select("ticker", "date", "close", "vix_close"))


def all_features(spark, sf_dir):
    bars, series = tables.brand_bars(spark, sf_dir), tables.order_series(spark, sf_dir)
    return rounded(stock_features(bars, series), 3)


# Sentiment and bars


def labelled_bars(spark, sf_dir):
    return indicators.movement_labels(tables.event_bars(spark, sf_dir), (1,)).select(
        "ticker", "date", "close", "movement"
    )


def sentiment_stock_join(spark, sf_dir):
    """Every article with every bar of its day."""
    sizes = tables.given(spark, sf_dir, "documents").select(tables.article_date().alias("date"))
    return rounded(
        joins.join_by_day(polarity(spark, sf_dir), labelled_bars(spark, sf_dir), "doc_id", joins.day_sizes(sizes))
    )


def sentiment_stock_statistics(spark, sf_dir):
    """Every bar with the statistics of all articles of its day; the pairs are not made."""
    return rounded(joins.join_statistics(polarity(spark, sf_dir), labelled_bars(spark, sf_dir), "lexicon_polarity"))


def join_moments(spark, sf_dir):
    bars = labelled_bars(spark, sf_dir)
    return rounded(joins.join_moments(polarity(spark, sf_dir), bars, ["lexicon_polarity"], ["close", "movement"]))


def sentiment_stock_join_daily(spark, sf_dir):
    daily = lexicon.daily_mean(polarity(spark, sf_dir))
    return rounded(joins.join_daily(daily, labelled_bars(spark, sf_dir)))


def hash_split(spark, sf_dir):
    return model.hash_split(tables.given(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def time_split(spark, sf_dir):
    bars = tables.brand_bars(spark, sf_dir).select("ticker", "date", "close")
    return model.time_split(bars, *SPLIT_DATES)


def standardize(spark, sf_dir):
    bars = tables.brand_bars(spark, sf_dir).select("ticker", "date", "close", F.col("volume").cast("double").alias("volume"))
    return rounded(model.standardize(model.hash_split(bars, "ticker", "date"), ["close", "volume"]))


def quality_scores(spark, sf_dir):
    known = tables.given(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = tables.given(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return known.join(docs, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") - 1500).cast("double").alias("score")
    )


def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(quality_scores(spark, sf_dir)))


HEADLINE_WORDS = 64

SCORERS = {
    "keywords": scoring.Model(load_keyword_scorer),
    "headlines": scoring.Model(load_keyword_scorer, HEADLINE_WORDS),
}


def scored_twice(spark, sf_dir):
    return scoring.score_texts(tables.articles(spark, sf_dir), "text", SCORERS, batch=32, batch_words=100_000)


def score_texts(spark, sf_dir):
    """A model of whole texts and one of their beginnings, in one pass."""
    fields = [F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in SCORERS for f in ("label", "score")]
    return rounded(scored_twice(spark, sf_dir).select("doc_id", *fields))


def finance_long(spark, sf_dir):
    """All seven values of the financial articles; numbers are rounded for the comparison only."""
    long = article_plan.finance_long(
        tables.raw_articles(spark, sf_dir), lexicon.lexicon_table(spark), "doc_id", SCORERS, FLAG_TERMS,
        tables.CORPUS_RULES, batch=32, batch_words=100_000,
    )
    labels_of = F.col("sentiment_type").endswith("_label") | F.col("sentiment_type").endswith("_class")
    number = F.when(~labels_of, F.round(F.col("value").cast("double"), 6))
    return long.withColumns({"number": number, "word": F.when(labels_of, F.col("value"))}).drop("value")


def model_features(spark, sf_dir):
    """Bars with the daily mean of three sentiment scores, split by bar."""
    both = scored_twice(spark, sf_dir).select(
        "date", *[labels.signed(F.col(f"{n}.label"), F.col(f"{n}.score")).alias(n) for n in SCORERS]
    )
    days = both.groupBy("date").agg(*[F.avg(n).alias(f"{n}_mean") for n in SCORERS])
    lexicon_days = lexicon.daily_mean(polarity(spark, sf_dir), name="lexicon_mean")
    bars = joins.join_daily(days, joins.join_daily(lexicon_days, labelled_bars(spark, sf_dir)))
    return materialise(model.hash_split(bars, "ticker", "date"))


FEATURE_SETS = {
    "No_Sentiment": ["close"],
    "Lexicon": ["close", "lexicon_mean"],
    "Keywords": ["close", "keywords_mean"],
    "Headlines": ["close", "headlines_mean"],
}


def svm_predictions(spark, sf_dir):
    daily = lexicon.daily_mean(polarity(spark, sf_dir))
    bars = joins.join_daily(daily, labelled_bars(spark, sf_dir))
    split = materialise(model.hash_split(bars, "ticker", "date"))
    out = model.train_and_predict(split, ["close", "mean_polarity"], "movement")
    return rounded(out.select("ticker", "date", "movement", "decision", "prediction", "converged"))


def model_report(spark, sf_dir):
    return rounded(model.model_report(model_features(spark, sf_dir), FEATURE_SETS, "movement"))


def registered() -> dict[str, Query]:
    forward = [indicators.forward_name(k) for k in indicators.HORIZONS]
    moves = [indicators.movement_name(k) for k in indicators.HORIZONS]
    bands = ["bollinger_band_middle", "sd", "bollinger_band_upper", "bollinger_band_lower"]
    return {
        "clean_articles": clean_articles,
        "scored_articles": scored_articles,
        "dedupe_articles": dedupe_articles,
        "null_profile": null_profile,
        "describe_numeric": describe_numeric,
        "date_flags": date_flags,
        "any_of_filter": any_of_filter,
        "finance_flag": finance_flag,
        "entity_mentions": found_mentions,
        "lexicon_polarity": lexicon_polarity,
        "phrase_polarity": phrase_polarity,
        "clean_daily_sentiment": clean_daily_sentiment,
        "daily_sentiment": daily_sentiment,
        "daily_sentiment_attach": daily_sentiment_attach,
        "polarity_class5": polarity_class5,
        "polarity_class3": polarity_class3,
        "signed_score": signed_score,
        "sentiment_long": long_articles,
        "finance_long": finance_long,
        "long_type_slice": long_type_slice,
        "token_ids": token_ids,
        "encode_tokens": encode_tokens,
        "latest_articles": latest_articles,
        "batch_ids": batch_ids,
        "union_sources": union_sources,
        "score_text": score_text,
        "score_texts": score_texts,
        "classify_text": classify_text,
        "html_links": html_links,
        "html_paragraphs": html_paragraphs,
        "html_text": html_text,
        "url_parts": url_parts,
        "domains_distinct": domains_distinct,
        "bar_files": bar_files,
        "article_files": article_files,
        "parquet_by_day": parquet_by_day,
        "fetch_outcomes": fetch_outcomes,
        "fetch_once": fetch_once,
        "index_rows": index_rows,
        "archive_names": archive_names,
        "table_page": table_page,
        "one_order": one_order,
        "recent_events": recent_events,
        "bars_clean": bars_clean,
        "daily_return": on_bars(indicators.daily_return, ["daily_return"], 6),
        "sma": on_bars(indicators.sma, [f"sma_{n}" for n in indicators.SMA_WINDOWS]),
        "ema": on_bars(indicators.with_ema, [f"ema_{n}" for n in indicators.EMA_SPANS]),
        "macd": on_bars(indicators.macd, ["macd"]),
        "rsi": on_bars(indicators.rsi, ["rsi"], 6),
        "bollinger": on_bars(indicators.bollinger, bands),
        "obv": on_bars(indicators.obv, ["obv"]),
        "forward_returns": on_bars(indicators.forward_returns, forward, 6),
        "movement_labels": on_bars(indicators.movement_labels, moves),
        "vix_left_join": vix_left_join,
        "stock_features": all_features,
        "sentiment_stock_join": sentiment_stock_join,
        "sentiment_stock_statistics": sentiment_stock_statistics,
        "sentiment_stock_join_daily": sentiment_stock_join_daily,
        "join_moments": join_moments,
        "hash_split": hash_split,
        "time_split": time_split,
        "standardize": standardize,
        "binary_metrics": binary_metrics,
        "svm_predictions": svm_predictions,
        "model_report": model_report,
    }
