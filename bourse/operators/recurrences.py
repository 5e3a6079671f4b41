"""Recursive indicators: each value depends on the one before, so a symbol's bars are folded in order.

A group is one symbol's bars, one row per session of the calendar (about 250 a year), whatever the
number of prints behind them; Spark spreads the symbols over tasks and Arrow moves the columns.
"""

import itertools
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("ema_8", "ema_21", "ema_50", "macd", "macd_signal", "rsi_wilder", "rsi_ewm", "atr_wilder", "adx", "di_plus", "di_minus", "supertrend_up")


def ema(values: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(values).ewm(span=span, adjust=False).mean().to_numpy()


def wilder(values: np.ndarray, n: int, first: int) -> np.ndarray:
    """Smoothed mean: the plain mean of n values from `first`, then one n-th of each new value."""
    out = np.full(len(values), np.nan)
    at = first + n - 1
    if at < len(values):
        seeded = values[at:].astype(float).copy()
        seeded[0] = values[first:at + 1].mean()
        out[at:] = pd.Series(seeded).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, np.where(np.isnan(gain), np.nan, 100.0), 100 - 100 / (1 + gain / loss))


def ratchet(raw: np.ndarray, close: np.ndarray, first: int, opening: float, tighter) -> np.ndarray:
    """A band that only tightens, and is drawn anew after a close beyond it. It opens on the bar before `first`."""
    band = np.full(len(raw), opening)
    beyond = 1.0 if tighter is min else -1.0
    for i in range(first, len(raw)):
        crossed = beyond * (close[i - 1] - band[i - 1]) > 0
        band[i] = raw[i] if crossed else tighter(band[i - 1], raw[i])
    return band


def supertrend(high, low, close, atr, n: int, mult: float) -> np.ndarray:
    """The SuperTrend side: up from a close above the upper band until one below the lower band.

    Both bands lie `mult` average ranges from the middle of the bar and are ratchets on their own: the upper one from
    the first full average, the lower one, which an uptrend needs, from the bar after it.
    """
    middle, reach = (high + low) / 2, mult * atr
    above = close > ratchet(middle + reach, close, n, np.inf, min)
    holds = close >= ratchet(middle - reach, close, n + 1, 0.0, max)
    side = itertools.accumulate(range(n, len(close)), lambda up, i: bool(holds[i] if up else above[i]), initial=False)
    return np.r_[np.zeros(n, bool), np.fromiter(itertools.islice(side, 1, None), bool, len(close) - n)]


def fold_symbol(bars: pd.DataFrame, n: int = 14, trend_n: int = 10, trend_mult: float = 2.5) -> pd.DataFrame:
    bars = bars.sort_values("date").reset_index(drop=True)
    high, low, close = (bars[c].to_numpy(float) for c in ("high", "low", "close"))
    size = len(close)
    before = np.r_[np.nan, close[:-1]]
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    move = np.r_[0.0, np.diff(close)]
    gain, loss = np.clip(move, 0, None), np.clip(-move, 0, None)
    out = bars.copy()
    for span in (8, 21, 50):
        out[f"ema_{span}"] = ema(close, span)
    out["macd"] = ema(close, 12) - ema(close, 26)
    out["macd_signal"] = ema(out["macd"].to_numpy(), 9)
    out["rsi_wilder"] = strength(wilder(gain, n, 1), wilder(loss, n, 1))
    smooth = lambda x: pd.Series(np.r_[np.nan, x[1:]]).ewm(alpha=1 / n, min_periods=n).mean().to_numpy()
    g, l = smooth(gain), smooth(loss)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi_ewm"] = 100 - 100 / (1 + g / np.where(l == 0, np.nan, l))
    out["atr_wilder"] = wilder(tr, n, 1)
    up, down = np.r_[0.0, np.diff(high)], np.r_[0.0, -np.diff(low)]
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["di_plus"], out["di_minus"] = 100 * wilder(plus, n, 1) / out["atr_wilder"], 100 * wilder(minus, n, 1) / out["atr_wilder"]
        total = out["di_plus"] + out["di_minus"]
        dx = np.where(total > 0, 100 * (out["di_plus"] - out["di_minus"]).abs() / total, 0.0)
    out["adx"] = wilder(np.where(np.arange(size) < n, 0.0, dx), n, n)
    trend_atr = np.nan_to_num(wilder(tr, trend_n, 1))
    out["supertrend_up"] = supertrend(high, low, close, trend_atr, trend_n, trend_mult) if size >= trend_n + 2 else False
    return out


def recurrences(bars: DataFrame) -> DataFrame:
    """Exponential means, both RSIs, Wilder ATR, ADX with its directions, and the SuperTrend side."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    extra = ", ".join(f"{c} {'boolean' if c == 'supertrend_up' else 'double'}" for c in COLUMNS)
    ordered = bars.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold_symbol(pdf)[[*ordered, *COLUMNS]]

    return bars.groupBy("symbol").applyInPandas(fold, f"{kinds}, {extra}")
