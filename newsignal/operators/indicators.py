"""Technical indicators of daily bars.

`bars` hold one row per (ticker, date) with open, high, low, close and volume.
Each function numbers the rows of a ticker, cuts them into blocks and evaluates
window columns per (ticker, block), so a ticker of any length is spread over
many tasks. Window columns are plain `Column`s and can be mixed freely;
`stock_features` in `plans.stocks` evaluates all of them in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newsignal.functions.labels import movement, percent_of
from newsignal.operators.ordered import BLOCK_ROWS, block_window, in_blocks, with_position
from newsignal.operators.scan import Scan, block_carries, block_maps, with_scans
from newsignal.session import materialise

KEY = "ticker"
KEYS = [KEY, "_block"]

# Window lengths of the feature table.
SMA_WINDOWS = (5, 12, 15, 20, 26, 30, 50)
EMA_SPANS = (5, 12, 26, 50)
HORIZONS = (1, 5, 30)


def positioned(bars: DataFrame) -> DataFrame:
    extra = [c for c in ("close", "open", "high", "low", "volume") if c in bars.columns]
    return with_position(bars, KEY, "date", ties=extra)


def core(blocked: DataFrame) -> DataFrame:
    return blocked.where("_core").drop("_core", "_block", "_pos")


def evaluate(
    bars: DataFrame, columns: dict[str, Column], before: int = 0, after: int = 0, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds window columns that look at most `before` rows back, `after` ahead."""
    return core(in_blocks(positioned(bars), rows, before, after).withColumns(columns))


# Window columns. `w` is ordered by row position inside one block.


def mean_of(value: str, n: int, w: WindowSpec) -> Column:
    return F.avg(value).over(w.rowsBetween(1 - n, 0))


def change(value: str, w: WindowSpec) -> Column:
    return F.col(value) - F.lag(value).over(w)


def daily_return_column(w: WindowSpec) -> Column:
    return (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) * 100


def sma_columns(windows: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"sma_{n}": mean_of("close", n, w) for n in windows}


def rsi_column(w: WindowSpec, n: int = 14) -> Column:
    """Simple-mean RSI, NULL before row n and where price never moved.

    `_up` and `_down` must hold the gain and the loss of each row, 0 on the
    first row of a series.
    """
    gain, loss = mean_of("_up", n, w), mean_of("_down", n, w)
    value = (
        F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, F.lit(100.0))
    )
    return F.when(F.col("_pos") >= n - 1, value)


def gain_loss_columns(w: WindowSpec) -> dict[str, Column]:
    step = F.coalesce(change("close", w), F.lit(0.0))
    return {"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))}


def bollinger_columns(w: WindowSpec, n: int = 20, width: float = 2) -> dict[str, Column]:
    middle = mean_of("close", n, w)
    spread = F.stddev_samp("close").over(w.rowsBetween(1 - n, 0))
    return {
        "bollinger_band_middle": middle,
        "sd": spread,
        "bollinger_band_upper": middle + width * spread,
        "bollinger_band_lower": middle - width * spread,
    }


def signed_volume(w: WindowSpec) -> Column:
    """Volume with the sign of the price change; exact integers."""
    sign = F.coalesce(F.signum(change("close", w)), F.lit(0.0))
    return sign.cast("long") * F.col("volume")


def forward_name(k: int) -> str:
    return "next_day_pct_change" if k == 1 else f"next_{k}_day_pct_change"


def movement_name(k: int) -> str:
    return "movement" if k == 1 else f"movement_{k}_day"


def forward_columns(horizons: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    close = F.col("close")
    return {forward_name(k): percent_of(F.lead("close", k).over(w) - close, close) for k in horizons}


def movement_columns(horizons: Sequence[int]) -> dict[str, Column]:
    return {movement_name(k): movement(F.col(forward_name(k))) for k in horizons}


# Exponential means. y[0] = x[0], y[t] = (1-a) y[t-1] + a x[t], a = 2/(span+1):
# a scan with the factor 1-a over the values a * x. Rows without a value leave
# the mean as it is. The volume balance is a scan with the factor 1.


def decay(span: float) -> float:
    return 1 - 2 / (span + 1)


def ema_block_rows(spans: Sequence[float], limit: int = BLOCK_ROWS) -> int:
    """Longest block whose scale factors stay inside the range of a double."""
    steepest = min(decay(s) for s in spans if s > 1) if any(s > 1 for s in spans) else 0.5
    return max(1, min(limit, int(250 / -math.log10(steepest))))


def ema_scans(spans: Sequence[float]) -> list[Scan]:
    return [Scan(f"ema_{s}", f"_share_{s}", max(decay(s), 0.0), from_first=True) for s in spans]


def ema_inputs(value: str, spans: Sequence[float]) -> dict[str, Column]:
    return {f"_share_{s}": F.col(value) * min(1 - decay(s), 1.0) for s in spans}


OBV = Scan("obv", "_signed")


def scanned(
    bars: DataFrame, scans: Sequence[Scan], inputs: dict[str, Column], rows: int, before: int = 0
) -> DataFrame:
    """`bars` with a column per scan; `inputs` are window columns over blocks with `before` rows of the last one.

    The numbered rows are written, because the block maps and the result both read them.
    """
    blocked = in_blocks(materialise(positioned(bars)), rows, before).withColumns(inputs)
    carries = block_carries(block_maps(blocked, KEY, scans), KEY, scans)
    return core(with_scans(blocked, carries, KEY, scans)).drop(*inputs)


def with_ema(bars: DataFrame, spans: Sequence[float] = EMA_SPANS, value: str = "close", rows: int | None = None) -> DataFrame:
    """Adds ema_<span>; NULL before the first value of a ticker, unchanged where the value is missing."""
    rows = min(rows or BLOCK_ROWS, ema_block_rows(spans))
    return scanned(bars, ema_scans(spans), ema_inputs(value, spans), rows)


# One indicator at a time.


def daily_return(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    return evaluate(bars, {"daily_return": daily_return_column(block_window(KEY))}, 1, rows=rows)


def sma(bars: DataFrame, windows: Sequence[int] = SMA_WINDOWS, rows: int = BLOCK_ROWS) -> DataFrame:
    return evaluate(bars, sma_columns(windows, block_window(KEY)), max(windows) - 1, rows=rows)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, rows: int | None = None) -> DataFrame:
    return with_ema(bars, (fast, slow), rows=rows).withColumn(
        "macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}")
    )


def rsi(bars: DataFrame, n: int = 14, rows: int = BLOCK_ROWS) -> DataFrame:
    w = block_window(KEY)
    blocked = in_blocks(positioned(bars), rows, before=n).withColumns(gain_loss_columns(w))
    return core(blocked.withColumn("rsi", rsi_column(w, n))).drop("_up", "_down")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2, rows: int = BLOCK_ROWS) -> DataFrame:
    return evaluate(bars, bollinger_columns(block_window(KEY), n, width), n - 1, rows=rows)


def obv(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    return scanned(bars, [OBV], {"_signed": signed_volume(block_window(KEY))}, rows, before=1)


def forward_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS, rows: int = BLOCK_ROWS) -> DataFrame:
    return evaluate(bars, forward_columns(horizons, block_window(KEY)), 0, max(horizons), rows)


def movement_labels(
    bars: DataFrame, horizons: Sequence[int] = HORIZONS, keep_open_rows: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Forward returns and their 0/1 labels.

    A row with no future row is labelled 0 unless `keep_open_rows` is false,
    which removes rows that lack any of the horizons.
    """
    labelled = forward_returns(bars, horizons, rows).withColumns(movement_columns(horizons))
    if keep_open_rows:
        return labelled
    return labelled.na.drop(subset=[forward_name(k) for k in horizons])
