import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.operators import joins, metrics, model

D = date(2024, 1, 1)


def test_join_by_day_equals_plain_join_with_a_hot_day(spark):
    articles = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.date_add(F.lit(D), F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 7).cast("int"))).alias("date"),
    )
    stocks = spark.createDataFrame([(D + timedelta(d), t) for d in range(5) for t in "xyz"], "date date, ticker string")
    want = sorted(tuple(r) for r in articles.join(stocks, "date").select("date", "doc_id", "ticker").collect())
    few = joins.day_sizes(articles.where("doc_id < 30"))
    for sizes, rows_per_salt in ((None, 10), (None, 10_000), (few, 5)):
        got = joins.join_by_day(articles, stocks, "doc_id", sizes, rows_per_salt)
        assert sorted(tuple(r) for r in got.select("date", "doc_id", "ticker").collect()) == want


def test_left_join_series(spark):
    bars = spark.createDataFrame([(D, "x"), (D + timedelta(1), "x")], "date date, ticker string")
    series = spark.createDataFrame([(D, 12.5)], "date date, value double")
    assert {r.date: r.vix_close for r in joins.left_join_series(bars, series, "vix_close").collect()} == {D: 12.5, D + timedelta(1): None}
    assert {r.vix_close for r in joins.left_join_series(bars, None, "vix_close").collect()} == {None}


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(2), round(rng.gauss(0, 1), 1)) for _ in range(400)]
    pairs += [(rng.randrange(2), 0.3) for _ in range(200)]
    df = spark.createDataFrame(pairs, "label int, score double")
    row = metrics.binary_metrics(df).first()
    assert row.auc == pytest.approx(brute_auc(pairs))
    assert row.accuracy == pytest.approx(sum((s > 0) == (y == 1) for y, s in pairs) / len(pairs))
    shifted = metrics.binary_metrics(df.withColumn("score", F.exp("score"))).first()
    assert shifted.auc == pytest.approx(row.auc)


def test_auc_agrees_with_spark(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(4)
    pairs = [(float(rng.randrange(2)), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(pairs, "label double, score double")
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert metrics.binary_metrics(df).first().auc == pytest.approx(theirs)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, -0.5)], "label int, score double")
    assert tuple(metrics.binary_metrics(df).first()) == (0.5, None)


def test_describe(spark):
    import pandas as pd

    rng = random.Random(9)
    values = [float(rng.randrange(50)) for _ in range(501)]
    df = spark.createDataFrame([(v, 1.0) for v in values] + [(None, 2.0)], "a double, b double")
    rows = {r["column"]: r for r in metrics.describe(df, ["a", "b"]).collect()}
    want = pd.Series(values).describe()
    got = rows["a"]
    assert [got["count"], got["mean"], got["std"], got["min"], got["p25"], got["p50"], got["p75"], got["max"]] == pytest.approx(want.tolist())
    assert rows["b"]["count"] == 502


def test_codes_keep_the_order_of_doubles():
    values = np.array([float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf")])
    codes = metrics.ordered_codes(values)
    assert list(np.argsort(codes, kind="stable")) == list(range(len(values)))
    assert [metrics.decoded(int(c)) for c in codes] == values.tolist()
    assert metrics.ordered_codes(np.array([-0.0]))[0] == metrics.ordered_codes(np.array([0.0]))[0]
    assert metrics.ordered_codes(np.array([float("nan")]))[0] > codes[-1]


def test_quantiles_are_exact_whatever_the_spread(spark):
    rng = random.Random(12)
    rows = [(rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200), rng.choice([7.0, 7.0, -1e-9]), None if i % 3 else 1.0 / (i + 1)) for i in range(901)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    shares = (0.0, 0.1, 0.333, 0.5, 0.95, 1.0)
    got = {r["column"]: r for r in metrics.describe(df, ["a", "b", "c"], shares).collect()}
    for i, name in enumerate("abc"):
        known = np.array([r[i] for r in rows if r[i] is not None])
        want = np.quantile(known, shares)
        assert [got[name][f"p{round(s * 100)}"] for s in shares] == pytest.approx(want.tolist(), rel=1e-12)
        assert got[name]["count"] == len(known)


def test_metrics_of_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(1, None, float("inf")), (0, None, 1.0), (0, None, float("-inf"))], "label int, a double, b double")
    rows = {r["column"]: r for r in metrics.describe(df, ["a", "b"]).collect()}
    assert (rows["a"]["count"], rows["a"]["p50"], rows["b"]["p50"]) == (0, None, 1.0)
    assert metrics.binary_metrics(df, score="b").first().auc == 1.0
    empty = metrics.binary_metrics(df.where("label > 1"), score="b").first()
    assert (empty.accuracy, empty.auc) == (None, None)


def test_splits(spark):
    df = spark.createDataFrame([(i, D + timedelta(i % 10)) for i in range(2000)], "id int, date date")
    split = model.hash_split(df, "id")
    assert split.where("is_test").count() / 2000 == pytest.approx(0.2, abs=0.03)
    by_day = {(r.date, r.is_test) for r in model.hash_split(df, "date").collect()}
    assert len(by_day) == 10
    timed = model.time_split(df, "2024-01-04", "2024-01-06")
    assert {(r.date.day, r.is_test) for r in timed.collect()} == {
        *((d, False) for d in (1, 2, 3, 4)), *((d, True) for d in (6, 7, 8, 9, 10)),
    }


def test_scaler_uses_training_rows(spark):
    rows = [(1.0, 5.0, False), (3.0, 5.0, False), (100.0, 6.0, True)]
    df = spark.createDataFrame(rows, "x double, c double, is_test boolean")
    out = model.standardize(df, ["x", "c"]).collect()
    assert [(r.x, r.c) for r in out] == [(-1.0, 0.0), (1.0, 0.0), (98.0, 1.0)]


def noisy(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, noise, int(x + 0.3 * noise + rng.gauss(0, 0.5) > 0)))
    return rows


def test_svm_and_report(spark):
    split = model.hash_split(spark.createDataFrame(noisy(), "id int, x double, z double, y int"), "id")
    out = model.train_and_predict(split, ["x", "z"], "y")
    assert out.where("(decision > 0) <> (prediction = 1) or not converged").count() == 0
    report = {r.model: r for r in model.model_report(split, {"noise": ["z"], "both": ["x", "z"]}, "y").collect()}
    assert report["both"].auc > 0.9 and report["both"].accuracy > 0.8 and report["both"].converged
    assert report["noise"].auc < 0.8


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_svm_is_at_the_optimum(spark, c):
    """The gradient of the objective, worked out in numpy, is zero, and no near point is lower."""
    rows = noisy(200)
    df = spark.createDataFrame(rows, "id int, x double, z double, y int").repartition(5)
    fit = model.fit_linear_svm(df, ["x", "z"], "y", c=c)
    data = np.array([[x, z, 1.0] for _, x, z, _ in rows])
    sign = np.array([2 * y - 1 for *_, y in rows])

    def objective(w):
        return w @ w / 2 + c * (np.maximum(0, 1 - sign * (data @ w)) ** 2).sum()

    w = np.array([fit.weights["x"], fit.weights["z"], fit.intercept])
    slack = np.maximum(0, 1 - sign * (data @ w))
    assert fit.converged and np.abs(w - 2 * c * (data.T @ (sign * slack))).max() < 1e-6 * (1 + c)
    rng = np.random.default_rng(0)
    assert all(objective(w + d) >= objective(w) for d in rng.normal(0, 1e-3, (50, 3)))


def test_svm_without_rest_says_so(spark):
    df = spark.createDataFrame(noisy(), "id int, x double, z double, y int")
    fit = model.fit_linear_svm(df, ["x", "z"], "y", max_iter=1)
    assert (fit.steps, fit.converged) == (1, False)


def test_svm_leaves_out_missing_values(spark):
    rows = [(i, x, z, y) for i, x, z, y in noisy(100)]
    odd = [(1, None, 1.0, 1), (2, float("nan"), 1.0, 0), (3, 1.0, 1.0, None)]
    schema = "id int, x double, z double, y int"
    plain = model.fit_linear_svm(spark.createDataFrame(rows, schema), ["x", "z"], "y")
    both = model.fit_linear_svm(spark.createDataFrame(rows + odd, schema), ["x", "z"], "y")
    assert both.weights == pytest.approx(plain.weights)
    out = model.predict(spark.createDataFrame(odd[:1], schema), plain).first()
    assert (out.decision, out.prediction) == (None, None)


def test_statistics_of_the_join_without_pairs(spark):
    rng = random.Random(8)
    articles = [(i, D + timedelta(rng.choice([0, 0, 0, 1, 2, 9])), rng.choice([None, rng.gauss(0, 1)])) for i in range(120)]
    stocks = [(D + timedelta(d), t, rng.choice([None, rng.gauss(50, 9)])) for d in range(5) for t in "xyz"]
    left = spark.createDataFrame(articles, "id int, date date, v double")
    right = spark.createDataFrame(stocks, "date date, ticker string, close double")
    pairs = left.join(right, "date")
    want = pairs.groupBy("date", "ticker").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    want = {(r.date, r.ticker): (r.n, r.m, r.s) for r in want.collect()}
    out = joins.join_statistics(left, right, "v")
    got = {(r.date, r.ticker): (r.articles, r["mean"], r.deviation) for r in out.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    both = pairs.na.drop(subset=["v", "close"]).agg(
        F.count("*"), F.avg("v"), F.avg("close"), F.stddev_pop("v"), F.stddev_pop("close"), F.covar_pop("v", "close")
    )
    moments = joins.join_moments(left, right, ["v"], ["close"])
    assert tuple(moments.first()) == pytest.approx(tuple(both.first()))
    assert "Join" not in moments._jdf.queryExecution().executedPlan().toString()
    empty = joins.join_moments(left.where("id < 0"), right, ["v"], ["close"]).first()
    assert tuple(empty) == (0, None, None, None, None, None)


def test_a_repeated_day_is_refused_and_bars_are_not_shuffled(spark):
    bars = spark.sql("select 'A' as ticker, date'2024-01-01' + cast(id as int) as date from range(3)")
    series = spark.sql("select date'2024-01-02' as date, 1.5d as value")
    out = joins.left_join_series(bars, series, "x")
    assert sorted(r.x or 0 for r in out.collect()) == [0, 0, 1.5]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="more than one row for 2024-01-02"):
        joins.left_join_series(bars, series.union(series), "x").collect()


def test_training_without_rows_is_refused(spark):
    empty = spark.createDataFrame([], "x double, y int")
    with pytest.raises(ValueError, match="no rows"):
        model.fit_linear_svm(empty, ["x"], "y")
