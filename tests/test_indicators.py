import random
from datetime import date, timedelta

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newsignal.operators import indicators as ind
from newsignal.plans.stocks import stock_features

START = date(2020, 1, 1)


def frame(spark, series, volumes=None):
    rows = []
    for ticker, closes in series.items():
        for i, c in enumerate(closes):
            v = volumes[i] if volumes else 10 * (i + 1)
            rows.append((ticker, START + timedelta(i), c + 1.0, c - 1.0, float(c), v))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, volume long")


def column(df, name, ticker="a"):
    rows = df.where(df.ticker == ticker).orderBy("date").collect()
    return [r[name] for r in rows]


def near(got, want, rel=1e-9):
    want = [None if pd.isna(w) else w for w in want]
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=rel, abs=1e-9)


def walk(n, seed):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x = max(1.0, x + rng.choice([-2, -1, 0, 0, 1, 2]))
        out.append(x)
    return out


@pytest.fixture(scope="module")
def series():
    return {"a": walk(90, 1), "b": walk(41, 2), "c": [5.0]}


def test_every_indicator_against_whole_series(spark, series):
    """Blocks of 7 rows: each value depends on rows of other blocks."""
    bars = frame(spark, series)
    out = stock_features(bars, rows=7).cache()
    for ticker, closes in series.items():
        s = pd.Series(closes)
        volume = pd.Series([10 * (i + 1) for i in range(len(s))])
        near(column(out, "daily_return", ticker), s.pct_change() * 100)
        for n in ind.SMA_WINDOWS:
            near(column(out, f"sma_{n}", ticker), s.rolling(n, 1).mean())
        for n in ind.EMA_SPANS:
            near(column(out, f"ema_{n}", ticker), s.ewm(span=n, adjust=False).mean(), 1e-12)
        macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
        near(column(out, "macd", ticker), macd)
        step = s.diff().fillna(0)
        up, down = step.clip(lower=0).rolling(14).mean(), (-step).clip(lower=0).rolling(14).mean()
        near(column(out, "rsi", ticker), 100 - 100 / (1 + up / down))
        near(column(out, "sd", ticker), s.rolling(20, 1).std())
        near(column(out, "bollinger_band_upper", ticker), s.rolling(20, 1).mean() + 2 * s.rolling(20, 1).std())
        sign = step.map(lambda d: (d > 0) - (d < 0))
        assert column(out, "obv", ticker) == (sign * volume).cumsum().tolist()
        for k in ind.HORIZONS:
            forward = (s.shift(-k) - s) / s * 100
            near(column(out, ind.forward_name(k), ticker), forward)
            assert column(out, ind.movement_name(k), ticker) == (forward > 0).astype(int).tolist()
        assert column(out, "day_range", ticker) == [2.0] * len(s)
    assert {r.vix_close for r in out.collect()} == {None}
    assert {(r.earnings_bool, r.split_indicator) for r in out.collect()} == {(0, 0)}


def test_single_operators_agree_with_the_feature_table(spark, series):
    bars = frame(spark, series)
    whole = stock_features(bars, rows=16).cache()
    for operator, names in (
        (ind.daily_return, ["daily_return"]),
        (ind.sma, ["sma_5", "sma_50"]),
        (ind.rsi, ["rsi"]),
        (ind.bollinger, ["bollinger_band_lower"]),
        (ind.obv, ["obv"]),
        (ind.forward_returns, ["next_5_day_pct_change"]),
        (ind.movement_labels, ["movement_30_day"]),
        (ind.with_ema, ["ema_26"]),
        (ind.macd, ["macd"]),
    ):
        out = operator(bars, rows=16)
        assert not [c for c in out.columns if c.startswith("_")]
        for name in names:
            near(column(out, name), column(whole, name))


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1024, 1025, 6000])
def test_ema_lengths(spark, n):
    closes = [50 + (i * 37 % 101) / 7 for i in range(n)]
    out = ind.with_ema(frame(spark, {"a": closes}), (1, 2, 5, 50, 400), rows=256)
    for span in (1, 2, 5, 50, 400):
        near(column(out, f"ema_{span}"), pd.Series(closes).ewm(span=span, adjust=False).mean(), 1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(0.01, 1e6), min_size=1, max_size=60),
    st.integers(1, 20),
    st.sampled_from([2, 5, 26, 200]),
)
def test_ema_is_the_recurrence(spark, closes, rows, span):
    out = ind.with_ema(frame(spark, {"a": closes}), (span,), rows=rows)
    near(column(out, f"ema_{span}"), pd.Series(closes).ewm(span=span, adjust=False).mean(), 1e-9)


def test_edge_series(spark):
    rising, flat = [float(i + 1) for i in range(16)], [3.0] * 16
    out = stock_features(frame(spark, {"up": rising, "flat": flat, "one": [9.0], "zero": [0.0, 4.0, 0.0]}))
    assert column(out, "rsi", "up") == [None] * 13 + [100.0] * 3
    assert column(out, "rsi", "flat") == [None] * 16 and column(out, "obv", "flat") == [0] * 16
    row = out.where("ticker = 'one'").first()
    assert (row.sma_50, row.ema_5, row.sd, row.rsi, row.obv, row.daily_return, row.movement) == (
        9.0, 9.0, None, None, 0, None, 0,
    )
    assert column(out, "daily_return", "zero") == [None, None, -100.0]
    assert column(out, "next_day_pct_change", "zero") == [None, -100.0, None]
    assert column(out, "movement", "zero") == [0, 0, 0]


def test_open_rows_can_be_dropped(spark):
    bars = frame(spark, {"a": walk(40, 4)})
    assert ind.movement_labels(bars).count() == 40
    assert ind.movement_labels(bars, keep_open_rows=False).count() == 10


def recurrence(closes, span):
    out, y, d = [], None, 1 - 2 / (span + 1)
    for x in closes:
        y = y if x is None else x if y is None else d * y + (1 - d) * x
        out.append(y)
    return out


@pytest.mark.parametrize("rows", [1, 3, 1024])
def test_missing_closes_leave_the_mean_as_it_is(spark, rows):
    rng = random.Random(3)
    holes = [None, None, *[rng.choice([None, None, float(rng.randrange(1, 90))]) for _ in range(700)]]
    series = {"a": [1.0, None, 3.0], "b": holes, "c": [None, None]}
    data = [(t, START + timedelta(i), x, 5) for t, xs in series.items() for i, x in enumerate(xs)]
    bars = spark.createDataFrame(data, "ticker string, date date, close double, volume long")
    spans = (1, 2, 5, 50)
    out = ind.with_ema(bars, spans, rows=rows).cache()
    for ticker, closes in series.items():
        for span in spans:
            near(column(out, f"ema_{span}", ticker), recurrence(closes, span), 1e-12)
    assert column(out, "ema_2") == [1.0, 1.0, pytest.approx(1 / 3 + 2)]
    macd = ind.macd(bars, rows=rows)
    near(column(macd, "macd", "b"), [None if x is None else x - y for x, y in zip(recurrence(holes, 12), recurrence(holes, 26))], 1e-9)


def test_feature_table_reads_the_source_once(spark):
    out = stock_features(frame(spark, {"a": walk(60, 1)}))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in text  # the bars themselves are read before, and written
    assert text.count("Exchange hashpartitioning") <= 6
