"""Files to model report, as a user would run it."""

import csv
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsignal.operators import cleaning, joins, lexicon, mentions, model, reshape, scoring
from newsignal.plans import catalog
from newsignal.plans.articles import finance_long, long_table, scored_articles
from newsignal.plans.stocks import stock_features
from newsignal.sources import files, sinks


def test_files_to_report(spark, tmp_path):
    rng = random.Random(11)
    start = date(2020, 1, 1)
    (tmp_path / "articles").mkdir()
    (tmp_path / "prices").mkdir()
    for i in range(60):
        with open(tmp_path / "articles" / f"a{i}.csv", "w", newline="") as f:
            text = rng.choice(["A good day on Wall Street", "A bad day", "", "None", "403 forbidden"])
            csv.writer(f).writerows([["Date", "Text"], [start + timedelta(i % 30), f"{text} {i % 40}".strip() if text else ""]])
    for ticker in ("AA", "BB"):
        with open(tmp_path / "prices" / f"{ticker}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["Date", "Open", "High", "Low", "Close", "Volume", "Ticker"])
            for d in range(40):
                close = 50 + rng.randrange(10)
                out.writerow([start + timedelta(d), close, close + 1, close - 1, close, 100, ticker])

    articles = files.read_articles(spark, str(tmp_path / "articles")).withColumn("id", F.xxhash64("date", "text"))
    table = lexicon.lexicon_table(spark)

    def flag(df):
        return mentions.flag_by_mentions(df, mentions.entity_mentions(df, mentions.generic_terms(spark), "id"), "id")

    scored = scored_articles(articles, table, "id", scorers=[flag]).cache()
    assert scored.where("text like '%Wall%' and finance_flag = 0").count() == 0
    assert scored.where("text like '%bad%' and polarity_sign <> 'negative'").count() == 0
    assert scored.where("text like '%forbidden%'").count() == 0

    sinks.write_parquet(long_table(scored, "id"), str(tmp_path / "long"))
    long = spark.read.parquet(str(tmp_path / "long"))
    assert long.count() == 3 * scored.count()
    assert {"id", "date", "exception_flag", "finance_flag", "sentiment_type", "value"} == set(long.columns)
    polarity = reshape.slice_of(long, "lexicon_polarity")
    back = {r.id: r.value for r in polarity.collect()}
    assert back == {r.id: r.lexicon_polarity for r in scored.collect()}

    bars = stock_features(cleaning.clean_bars(files.read_bars(spark, str(tmp_path / "prices"))))
    many = joins.join_by_day(polarity.select("id", "date", "value"), bars, "id")
    assert many.count() == 2 * scored.count()

    daily = joins.join_daily(lexicon.daily_mean(scored), bars)
    split = model.hash_split(daily, "ticker", "date")
    report = model.model_report(split, {"none": ["close"], "lexicon": ["close", "mean_polarity"]}, "movement")
    assert {r.model for r in report.collect()} == {"none", "lexicon"}
    assert all(0 <= r.accuracy <= 1 and r.converged for r in report.collect())


def test_long_table_of_financial_articles(spark):
    texts = ["Stock is good", "stock was bad, bad", "nothing here but good", "stock of nothing", "None", "the stock 403 forbidden"]
    raw = spark.createDataFrame([(i, date(2024, 1, 1), t) for i, t in enumerate(texts)], "id int, date date, text string")
    table = lexicon.lexicon_table(spark, {"good": 1.9, "bad": -2.5})
    models = {
        "whole": scoring.Model(lambda: scoring.KeywordScorer(["good"], ["bad"])),
        "begun": scoring.Model(lambda: scoring.KeywordScorer(["good"], ["bad"]), 2),
    }
    long = finance_long(raw, table, "id", models, ["STOCK"])
    rows = {(r.id, r.sentiment_type): r.value for r in long.collect()}
    kinds = ["lexicon_polarity", "mean_polarity", "polarity_class", "whole_label", "whole_score", "begun_label", "begun_score"]
    assert len(rows) == long.count() == 21 and set(rows) == {(i, k) for i in (0, 1, 3) for k in kinds}
    assert [rows[i, "whole_label"] for i in (0, 1, 3)] == ["POSITIVE", "NEGATIVE", "UNKNOWN"]
    assert {rows[i, "begun_label"] for i in (0, 1, 3)} == {"UNKNOWN"}
    scored = lexicon.lexicon_polarity(raw, table, ["id"]).where("id < 4").collect()
    mean = sum(r.lexicon_polarity for r in scored) / 4
    assert [float(rows[i, "mean_polarity"]) for i in (0, 1, 3)] == pytest.approx([mean] * 3)
    assert float(rows[0, "lexicon_polarity"]) == next(r.lexicon_polarity for r in scored if r.id == 0)
    assert finance_long(raw.limit(0), table, "id", models, ["STOCK"]).count() == 0


def test_stock_join_has_every_article_with_every_bar_of_its_day(spark, tmp_path):
    texts = {0: "a good day", 30: "a good day", 60: "a bad day", 90: None, 1: "good", 2: "on a day without bars"}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    bars = [("x", 0, 1.5), ("x", 0, 2.5), ("y", 0, 3.5), ("x", 1, 4.5), ("y", 5, 5.5)]
    events = [(t, datetime(2024, 1, 1 + d, i), v) for i, (t, d, v) in enumerate(bars)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(events, "event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    polarity = {r.doc_id: r.lexicon_polarity for r in catalog.lexicon_polarity(spark, str(tmp_path)).collect()}
    got = [(r.doc_id, r.ticker, r.date.day, r.close, r.lexicon_polarity) for r in catalog.sentiment_stock_join(spark, str(tmp_path)).collect()]
    want = [(i, t, 1, c, polarity[i]) for i in (0, 30, 60, 90) for t, c in (("x", 2.5), ("y", 3.5))] + [(1, "x", 2, 4.5, polarity[1])]
    assert sorted(got) == sorted(want) and polarity[0] > 0 > polarity[60]
    assert {(r.ticker, r.date.day): r.articles for r in catalog.sentiment_stock_statistics(spark, str(tmp_path)).collect()} == {("x", 1): 4, ("y", 1): 4, ("x", 2): 1}
