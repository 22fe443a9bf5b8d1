"""The plans keep the shape they were designed for."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from newsignal.operators import indicators, joins, lexicon, tokens
from newsignal.plans import catalog, tables

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["lexicon_polarity", "entity_mentions", "dedupe_articles", "batch_ids", "sma", "ema", "obv",
     "rsi", "stock_features", "sentiment_stock_join", "html_text", "daily_sentiment_attach"],
)
def test_no_task_gets_everything(spark, name):
    assert "SinglePartition" not in plan(catalog.registered()[name](spark, SF))


def test_no_window_by_ticker_alone(spark):
    text = plan(catalog.all_features(spark, SF))
    keys = re.findall(r"Window \[.*?\], \[(.*?)\]", text)
    assert keys
    # Only the small tables of monthly counts and of block groups may be.
    alone = [k for k in keys if "," not in k]
    big = [w for w in re.findall(r"Window \[(.*?)\], \[ticker#\d+\], ", text) if "close" in w]
    assert len(alone) < len(keys) and not big


def test_lexicon_is_broadcast_by_size(spark):
    text = plan(catalog.polarity(spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_html_needs_no_shuffle(spark):
    pages = tables.given(spark, SF, "pages").repartition(8).cache()
    pages.count()
    found = pages.select(catalog.html.article_text(F.col("html")))
    assert plan(found).count("Exchange") == plan(pages).count("Exchange")


def test_date_filter_reaches_the_scan(spark):
    days = tables.given(spark, SF, "orders").where(F.col("o_orderdate") >= "1997-01-01")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan(days.select("o_orderkey"))


def test_only_needed_columns_are_read(spark):
    text = plan(tables.brand_bars(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("l_comment" in s or "l_tax" in s or "p_name" in s for s in schemas)


def test_only_dates_bound_a_broadcast(spark):
    by_date = spark.sql("select date'2024-01-01' as date, 1 as x")
    by_text = by_date.withColumn("date", F.col("date").cast("string"))
    assert "Broadcast" in plan(by_date.join(joins.per_day(by_date), "date"))
    assert joins.per_day(by_text) is by_text


def test_frequent_terms_are_not_shuffled(spark):
    docs = tables.articles(spark, SF)
    text = plan(tokens.encode(docs, tokens.vocabulary(docs, "doc_id"), "doc_id"))
    assert "BroadcastHashJoin" in text


def test_ema_blocks_fit_a_double():
    for spans in ((2,), (5, 50), (1, 3), (1.01,), (1,)):
        rows = indicators.ema_block_rows(spans)
        steepest = min([indicators.decay(s) for s in spans if s > 1] or [0.5])
        assert 1 <= rows <= 1024 and steepest**-rows < 1e251


def test_python_workers_need_no_package_on_their_path(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from newsignal.session import local_session\n"
        "from newsignal.plans import catalog\n"
        "spark = local_session(2, partitions=2)\n"
        f"print('rows', catalog.score_text(spark, {SF!r}).count())\n"
        f"print('label', catalog.score_text(spark, {SF!r}).first().label)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 200" in done.stdout and "label" in done.stdout, done.stderr[-2000:]


def test_rules_are_those_of_the_paper():
    rules = lexicon.Rules()
    assert (rules.boost, rules.negate, rules.capitals, rules.alpha) == (0.293, -0.74, 0.733, 15.0)
