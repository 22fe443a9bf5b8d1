"""Price bars to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.operators import indicators as ind
from newsignal.operators.joins import left_join_series
from newsignal.operators.ordered import BLOCK_ROWS, block_window, in_blocks
from newsignal.operators.scan import block_carries, block_maps, with_scans
from newsignal.session import materialise


def stock_features(
    bars: DataFrame, vix: DataFrame | None = None, rows: int = BLOCK_ROWS
) -> DataFrame:
    """All indicators, forward returns and labels of every bar.

    The numbered bars are written once. One sort per (ticker, block) serves every
    window; the running values, exponential means and volume balance, enter a
    block through one small table of carries.
    """
    rows = min(rows, ind.ema_block_rows(ind.EMA_SPANS))
    w = block_window(ind.KEY)
    source = materialise(ind.positioned(bars))
    back, ahead = max(ind.SMA_WINDOWS), max(ind.HORIZONS)
    scans = [*ind.ema_scans(ind.EMA_SPANS), ind.OBV]
    inputs = {**ind.ema_inputs("close", ind.EMA_SPANS), "_signed": ind.signed_volume(w)}
    narrow = in_blocks(source.select(ind.KEY, "close", "volume", "_pos"), rows, before=1).withColumns(inputs)
    carries = block_carries(block_maps(narrow, ind.KEY, scans), ind.KEY, scans)
    wide = in_blocks(source, rows, back, ahead).withColumns({**ind.gain_loss_columns(w), **inputs})
    blocked = with_scans(wide, carries, ind.KEY, scans).withColumns(
        {
            "daily_return": ind.daily_return_column(w),
            **ind.sma_columns(ind.SMA_WINDOWS, w),
            "rsi": ind.rsi_column(w),
            **ind.bollinger_columns(w),
            **ind.forward_columns(ind.HORIZONS, w),
        }
    )
    features = ind.core(blocked).withColumns(
        {
            "day_range": F.col("high") - F.col("low"),
            "macd": F.col("ema_12") - F.col("ema_26"),
            **ind.movement_columns(ind.HORIZONS),
            "earnings_bool": F.lit(0),
            "split_indicator": F.lit(0),
        }
    )
    return left_join_series(
        features.drop(*[c for c in features.columns if c.startswith("_")]), vix, "vix_close"
    )
