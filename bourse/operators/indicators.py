"""Indicators over bars keyed (symbol, date), as window expressions.

Every function takes a frame with one row per symbol and session, so a window partition holds at
most one row per session of the calendar, whatever the volume of prints behind the bars. All
functions of this module use the same partitioning and order, so chained calls share one exchange.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, col, guarded, ratio, roll, series, trailing
from bourse.operators.order_statistics import with_percentiles

YEAR = 252
W_START = Window.unboundedPreceding


def per_symbol() -> WindowSpec:
    return series("symbol")


def prev(c, n: int = 1) -> Column:
    return F.lag(col(c), n).over(per_symbol())


def change(c="close", n: int = 1) -> Column:
    return ratio(c, prev(c, n)) - 1


def log_change(c="close") -> Column:
    return F.log(ratio(c, prev(c)))


def returns(bars: DataFrame, horizons=(1, 5, 21)) -> DataFrame:
    """Simple and log returns plus momentum that skips the last month."""
    return bars.withColumns(
        {f"ret_{n}": change("close", n) for n in horizons}
        | {
            "log_ret": log_change(),
            "mom_12_1": ratio(prev("close", 21), prev("close", 252)) - 1,
            "mom_6_1": ratio(prev("close", 21), prev("close", 126)) - 1,
        }
    )


def moving_averages(bars: DataFrame, windows=(20, 50, 200)) -> DataFrame:
    out = {}
    for n in windows:
        sma = roll(F.avg, "close", per_symbol(), n)
        out |= {f"sma_{n}": sma, f"dist_sma_{n}": ratio("close", sma) - 1, f"above_sma_{n}": F.col("close") > sma}
    return bars.withColumns(out)


def true_range() -> Column:
    last = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean average true range; the first bar has the plain range."""
    return bars.withColumn("tr", true_range()).withColumn("atr", roll(F.avg, "tr", per_symbol(), n)).withColumn(
        "atr_pct", ratio("atr", "close")
    )


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, population: bool = False) -> DataFrame:
    std = F.stddev_pop if population else F.stddev_samp
    mid, sd = roll(F.avg, "close", per_symbol(), n), roll(std, "close", per_symbol(), n)
    return bars.withColumns({
        "bb_mid": mid,
        "bb_width": ratio(2 * k * sd, mid),
        "bb_pct": ratio(F.col("close") - (mid - k * sd), 2 * k * sd),
    })


def oscillators(bars: DataFrame, n: int = 14, smooth: int = 3, cci_n: int = 20) -> DataFrame:
    """Stochastic %K and %D, Williams %R and the commodity channel index."""
    hi, lo = roll(F.max, "high", per_symbol(), n), roll(F.min, "low", per_symbol(), n)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumns({
        "stoch_k": 100 * ratio(F.col("close") - lo, hi - lo),
        "williams_r": -100 * ratio(hi - F.col("close"), hi - lo),
        "_tp": typical,
    })
    frame = trailing(per_symbol(), cci_n)
    out = out.withColumns({
        "stoch_d": roll(F.avg, "stoch_k", per_symbol(), smooth),
        "_mean": roll(F.avg, "_tp", per_symbol(), cci_n),
        "_all": F.collect_list("_tp").over(frame),
    })
    deviation = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / cci_n
    return out.withColumn("cci", ratio(F.col("_tp") - F.col("_mean"), 0.015 * deviation)).drop("_tp", "_mean", "_all")


def on_balance_volume(bars: DataFrame, n: int = 10) -> DataFrame:
    """Signed cumulative volume and the slope of its last n values."""
    signed = F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)) * F.col("volume")
    out = bars.withColumns({"_signed": signed, "_no": F.row_number().over(per_symbol())})
    out = out.withColumn("obv", F.sum("_signed").over(per_symbol().rowsBetween(W_START, 0)))
    slope = guarded(F.regr_slope("obv", "_no"), F.col("obv"), trailing(per_symbol(), n), n)
    return out.withColumn("obv_slope", slope).drop("_signed", "_no")




def trend_sign(bars: DataFrame, windows=(5, 25, 63), band: float = 0.001) -> DataFrame:
    """Sign of the fitted slope relative to the window's first close; `alignment` is their mean."""
    out = bars.withColumn("_no", F.row_number().over(per_symbol()))
    for n in windows:
        frame = trailing(per_symbol(), n)
        slope = ratio(F.regr_slope("close", "_no").over(frame), F.first("close").over(frame))
        sign = F.when(slope > band, 1).when(slope < -band, -1).otherwise(0)
        out = out.withColumn(f"trend_{n}", F.when(F.count("close").over(frame) >= n, sign))
    total = sum((F.col(f"trend_{n}") for n in windows), F.lit(0))
    return out.withColumn("alignment", total / float(len(windows))).drop("_no")


def historical_vol(bars: DataFrame, windows=(10, 20, 30, 60)) -> DataFrame:
    out = bars.withColumn("log_ret", log_change())
    return out.withColumns({f"hv_{n}": roll(F.stddev_samp, "log_ret", per_symbol(), n) * YEAR**0.5 for n in windows})


def vol_regime_expanding(bars: DataFrame, vol: str, min_obs: int = 252) -> DataFrame:
    """LOW / MED / HIGH / SPIKE against the symbol's own history up to the row; MED while it is short."""
    out = with_percentiles(bars, "symbol", "date", vol, (0.33, 0.67, 0.90), "_cut", "_n")
    v = F.col(vol)
    label = (
        F.when((F.col("_n") < min_obs) | v.isNull(), "MED")
        .when(v <= F.col("_cut")[0], "LOW")
        .when(v <= F.col("_cut")[1], "MED")
        .when(v <= F.col("_cut")[2], "HIGH")
        .otherwise("SPIKE")
    )
    return out.withColumn("vol_regime", label).drop("_cut", "_n")


def lottery_liquidity(bars: DataFrame) -> DataFrame:
    """Downside volatility, maximum return, mean gap, close location, illiquidity, turnover ratio."""
    out = bars.withColumns({"_r": change(), "_lr": log_change(), "_turn": F.col("close") * F.col("volume")})
    out = out.withColumns({
        "_down": F.when(F.col("_lr") < 0, F.col("_lr")),
        "_gap": ratio("open", prev("close")) - 1,
        "_loc": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "_illiq": ratio(F.abs("_r"), "_turn") * 1e7,
    })
    return out.withColumns({
        "downside_vol_63": roll(F.stddev_samp, "_down", per_symbol(), 63, 18),
        "max_ret_21": roll(F.max, "_r", per_symbol(), 21, 15),
        "gap_mean_21": roll(F.avg, "_gap", per_symbol(), 21, 15),
        "close_loc_21": roll(F.avg, "_loc", per_symbol(), 21, 15),
        "amihud_21": roll(F.avg, "_illiq", per_symbol(), 21, 15),
        "turnover_ratio_5_60": ratio(roll(F.avg, "_turn", per_symbol(), 5, 3), roll(F.avg, "_turn", per_symbol(), 60, 45)),
    }).drop("_r", "_lr", "_turn", "_down", "_gap", "_loc", "_illiq")


def year_range(bars: DataFrame, n: int = 252, min_obs: int = 120) -> DataFrame:
    hi, lo = roll(F.max, "close", per_symbol(), n, min_obs), roll(F.min, "close", per_symbol(), n, min_obs)
    return bars.withColumns({
        "dist_52w_high": ratio("close", hi) - 1,
        "dist_52w_low": ratio("close", lo) - 1,
        "pct_of_52w_high": ratio("close", hi),
        "new_high": F.col("close") >= hi,
    })


def rolling_beta(panel: DataFrame, index: DataFrame, n: int = 252, min_obs: int = 120) -> DataFrame:
    """Beta and idiosyncratic volatility against an index, on the dates both have a return."""
    market = index.select("date", F.col("close").alias("_ix"))
    out = panel.join(market, "date", "left")
    out = out.withColumns({"_r": change(), "_m": change("_ix")})
    both = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    out = out.withColumns({"_r": F.when(both, F.col("_r")), "_m": F.when(both, F.col("_m"))})
    frame = trailing(per_symbol(), n)
    cov, var_m, var_r = (f.over(frame) for f in (F.covar_samp("_r", "_m"), F.var_samp("_m"), F.var_samp("_r")))
    beta = F.when(F.count("_r").over(frame) >= min_obs, ratio(cov, var_m))
    out = out.withColumns({"beta": beta, "_v": var_r, "_vm": var_m})
    idio = F.sqrt(F.greatest(F.col("_v") - F.col("beta") * F.col("beta") * F.col("_vm"), F.lit(0.0)))
    return out.withColumn("idio_vol", F.when(F.col("beta").isNotNull(), idio)).drop("_ix", "_r", "_m", "_v", "_vm")


def risk_metrics(panel: DataFrame, index: DataFrame, n: int = 252, risk_free: float = 0.0, min_obs: int = 30) -> DataFrame:
    """Per symbol over its last n returns: beta, Sortino (shortfall over the whole window), 95% value
    at risk as a percent loss, Sharpe, and the worst drawdown from the running high."""
    market = index.select("date", F.col("close").alias("_ix"))
    rows = panel.join(market, "date").withColumns({"_r": change(), "_m": change("_ix"), "_x": change() - risk_free})
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    rows = rows.withColumn("_rn", newest).where((F.col("_rn") <= n) & F.col("_r").isNotNull())
    rows = rows.withColumn("_dd", ratio("close", F.max("close").over(per_symbol().rowsBetween(W_START, 0))) - 1)
    short = F.least(F.col("_x"), F.lit(0.0))
    stats = rows.groupBy("symbol").agg(
        F.count("_r").alias("n"),
        F.covar_samp("_r", "_m").alias("_cov"), F.var_samp("_m").alias("_var"),
        F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd"), F.avg(short * short).alias("_short"),
        F.count_if(F.col("_x") < 0).alias("_losses"),
        F.percentile("_r", F.lit(0.05)).alias("_p5"),
        F.min("_dd").alias("max_drawdown"),
    )
    root = float(YEAR) ** 0.5
    return stats.where(F.col("n") >= min_obs).select(
        "symbol", "n",
        F.when(F.col("_var") > 0, ratio("_cov", "_var")).alias("beta"),
        F.when(F.col("_losses") >= 5, ratio("_mean", F.sqrt("_short")) * root).alias("sortino"),
        (-100 * F.col("_p5")).alias("var_95"),
        (ratio("_mean", "_sd") * root).alias("sharpe"),
        "max_drawdown",
    )


def rolling_corr(panel: DataFrame, asset: DataFrame, n: int = 90, min_obs: int = 40) -> DataFrame:
    """Correlation of each symbol's returns with another series, on their common dates."""
    other = asset.select("date", F.col("close").alias("_asset"))
    out = panel.join(other, "date").withColumns({"_r": change(), "_a": change("_asset")})
    frame = trailing(per_symbol(), n)
    corr = F.when(F.count("_r").over(frame) >= min_obs, F.corr("_r", "_a").over(frame))
    return out.withColumn("corr", corr).drop("_asset", "_r", "_a")


def avwap_deviation(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close against the volume-weighted typical price of the last n bars (at least two)."""
    frame = trailing(per_symbol(), n)
    value = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    vwap = ratio(F.sum(value).over(frame), F.sum("volume").over(frame))
    out = bars.withColumn("avwap", F.when(F.count("close").over(frame) >= 2, vwap))
    return out.withColumn("avwap_dev_pct", 100 * ratio(F.col("close") - F.col("avwap"), "avwap"))


def session_vwap(bars: DataFrame, session: Column, order: str, bands=(1.0, 2.0)) -> DataFrame:
    """Running VWAP of each session with volume-weighted deviation bands."""
    w = Window.partitionBy("symbol", "_session").orderBy(order).rowsBetween(W_START, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumns({"_session": session, "_tp": tp, "_v": F.sum("volume").over(
        Window.partitionBy("symbol", session).orderBy(order).rowsBetween(W_START, 0))})
    out = out.withColumn("vwap", ratio(F.sum(F.col("_tp") * F.col("volume")).over(w), "_v"))
    second = ratio(F.sum(F.col("_tp") * F.col("_tp") * F.col("volume")).over(w), "_v")
    out = out.withColumn("vwap_sd", F.sqrt(F.greatest(second - F.col("vwap") * F.col("vwap"), F.lit(0.0))))
    edges = {}
    for k in bands:
        edges[f"vwap_up_{k:g}"] = F.col("vwap") + k * F.col("vwap_sd")
        edges[f"vwap_down_{k:g}"] = F.col("vwap") - k * F.col("vwap_sd")
    return out.withColumns(edges).withColumn("vwap_dev", ratio("close", "vwap") - 1).drop("_session", "_tp", "_v")


def order_flow(bars: DataFrame, n: int = 20, vpin_n: int = 50) -> DataFrame:
    """Order-flow proxies from bars: signed volume share, its z-score, two toxicity proxies,
    price impact and relative volume. Unknown direction counts as no flow."""
    diff = F.col("close") - prev("close")
    spread = F.col("high") - F.col("low")
    out = bars.withColumns({"_d": F.abs(diff), "_sv": F.signum(diff) * F.col("volume")})
    where = F.coalesce(F.abs(ratio(2 * F.col("close") - F.col("high") - F.col("low"), spread)), F.lit(0.0))
    one_sided = F.when(F.col("volume") != 0, F.when(F.col("_sv") == 0, 0.0).when(F.col("_d").isNotNull(), 1.0).otherwise(0.0))
    frame = trailing(per_symbol(), n)
    flow = F.sum("_sv").over(frame)
    out = out.withColumns({
        "ofi_sum": flow,
        "ofi": F.coalesce(ratio(flow, F.sum("volume").over(frame)), F.lit(0.0)),
        "vpin_range": F.avg(where).over(trailing(per_symbol(), vpin_n)),
        "vpin_tick": F.avg(one_sided).over(trailing(per_symbol(), vpin_n)),
        "relative_volume": ratio("volume", roll(F.avg, "volume", per_symbol(), n, n, skip=1)),
    })
    cov, var = (g.over(frame) for g in (F.covar_samp("_d", F.abs("_sv")), F.var_samp(F.abs("_sv"))))
    z_mean, z_sd = roll(F.avg, "ofi_sum", per_symbol(), 5 * n, n), roll(F.stddev_samp, "ofi_sum", per_symbol(), 5 * n, n)
    full = F.count("_sv").over(frame) >= n
    return out.withColumns({
        "kyle_lambda": F.coalesce(F.when(full, ratio(cov, var)), F.lit(0.0)),
        "ofi_z": F.coalesce(ratio(F.col("ofi_sum") - z_mean, z_sd), F.lit(0.0)),
    }).drop("_d", "_sv", "ofi_sum")


def delivery_features(df: DataFrame, pct: str = "deliv_pct") -> DataFrame:
    """Delivery share against the symbol's own past, and the size of an average ticket."""
    mean20, sd20 = roll(F.avg, pct, per_symbol(), 20, 10), roll(F.stddev_samp, pct, per_symbol(), 20, 10)
    out = df.withColumn("_ticket", ratio("turnover", "num_trades"))
    return out.withColumns({
        "deliv_z_20": ratio(F.col(pct) - mean20, sd20),
        "deliv_chg_5": F.col(pct) - prev(pct, 5),
        "deliv_spike": F.col(pct) - roll(F.avg, pct, per_symbol(), 60, 30),
        "deliv_trend": roll(F.avg, pct, per_symbol(), 21, 10) - roll(F.avg, pct, per_symbol(), 63, 30),
        "deliv_qty_5": F.sum("deliv_qty").over(trailing(per_symbol(), 5)),
        "ticket_ratio": ratio("_ticket", roll(F.avg, "_ticket", per_symbol(), 60, 30)),
    }).drop("_ticket")


def iv_rank(df: DataFrame, iv: str, n: int = 252, min_obs: int = 20) -> DataFrame:
    """Position in the trailing range; a flat or thin history is neutral 0.5."""
    frame = trailing(per_symbol(), n)
    lo, hi, seen = F.min(iv).over(frame), F.max(iv).over(frame), F.count(iv).over(frame)
    rank = clamp((F.col(iv) - lo) / (hi - lo), 0.0, 1.0)
    return df.withColumn("iv_rank", F.when(F.col(iv).isNull(), None).when((seen < min_obs) | (hi <= lo), 0.5).otherwise(rank))


def ffill_with_age(df: DataFrame, cols, limit: int, keys=("symbol",), order: str = "date") -> DataFrame:
    """Forward-fill each column over at most `limit` rows, with the age in rows of the last value."""
    w = series(*keys, order=order)
    out = df.withColumn("_no", F.row_number().over(w))
    # One running last value per column tells both: what it was and when.
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("_no").alias("no"), F.col(c).alias("value")))
    out = out.withColumns({f"_last_{c}": F.last(known(c), ignorenulls=True).over(w.rowsBetween(W_START, 0)) for c in cols})
    age = {f"{c}_age": F.col("_no") - F.col(f"_last_{c}.no") for c in cols}
    fill = {f"{c}_ffill": F.when(age[f"{c}_age"] <= limit, F.col(f"_last_{c}.value")) for c in cols}
    return out.withColumns(fill | age).drop("_no", *[f"_last_{c}" for c in cols])


def run_length(df: DataFrame, flag: str) -> DataFrame:
    """Consecutive rows on which the flag holds, and the edge where it stops holding."""
    on = F.coalesce(F.col(flag), F.lit(False))
    out = df.withColumn("_block", F.sum(F.when(~on, 1).otherwise(0)).over(per_symbol().rowsBetween(W_START, 0)))
    island = series("symbol", "_block")
    length = F.sum(F.when(on, 1).otherwise(0)).over(island.rowsBetween(W_START, 0))
    out = out.withColumn("run", length)
    return out.withColumn("exit_edge", ~on & (F.coalesce(prev("run"), F.lit(0)) > 0)).drop("_block")


def compare_previous(df: DataFrame, value: str) -> DataFrame:
    """Percent change against the previous available row, whatever the gap."""
    return df.withColumns({"prev_value": prev(value), "pct_delta": 100 * ratio(F.col(value) - prev(value), F.abs(prev(value)))})


def price_move_classes(bars: DataFrame, gap: float = 2.0, shock: float = 5.0, lookback: int = 20, equal: float = 0.15,
                       least_range: float = 1.0, close_at: float = 0.75) -> DataFrame:
    """Gap, open=extreme, volume shock and breakout flags of each session; the tolerances are percent."""
    last = prev("close")
    spread = F.col("high") - F.col("low")
    median = roll(lambda c: F.percentile(c, F.lit(0.5)), "volume", per_symbol(), 20, 10, skip=1)
    high = roll(F.max, "high", per_symbol(), lookback, 10, skip=1)
    wide = spread >= least_range / 100 * last
    touches = lambda c: F.abs(F.col(c) - F.col("open")) <= equal / 100 * last
    flags = {
        "gap_up": 100 * ratio(F.col("open") - last, last) >= gap,
        "gap_down": 100 * ratio(F.col("open") - last, last) <= -gap,
        "open_low": touches("low") & wide & (F.col("close") > F.col("open")),
        "open_high": touches("high") & wide & (F.col("close") < F.col("open")),
        "volume_shock": ratio("volume", median) >= shock,
        "breakout": (F.col("high") > high) & (ratio(F.col("close") - F.col("low"), spread) >= close_at),
    }
    return bars.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def flyers_and_divers(bars: DataFrame, threshold: float = 0.04, volume_ratio: float = 1.5, min_bars: int = 60,
                      min_price: float = 20.0) -> DataFrame:
    """Big moves on heavy volume and fresh one-year extremes in the direction of the day, one row per event."""
    out = bars.withColumns({
        "ret": change(),
        "vol_ratio": ratio("volume", F.avg("volume").over(trailing(per_symbol(), 20, 1))),
        "_hi": F.max("close").over(trailing(per_symbol(), 252, 1)),
        "_lo": F.min("close").over(trailing(per_symbol(), 252, 1)),
        "_n": F.count("close").over(per_symbol().rowsBetween(W_START, 0)),
    })
    out = out.withColumns({
        "new_high": F.coalesce((F.col("close") > F.col("_hi")) & (F.col("ret") > 0), F.lit(False)),
        "new_low": F.coalesce((F.col("close") < F.col("_lo")) & (F.col("ret") < 0), F.lit(False)),
    })
    heavy = F.col("vol_ratio") >= volume_ratio
    kind = (
        F.when(((F.col("ret") >= threshold) & heavy) | F.col("new_high"), "FLYER")
        .when(((F.col("ret") <= -threshold) & heavy) | F.col("new_low"), "DIVER")
    )
    seasoned = (F.col("_n") >= min_bars) & (F.col("close") >= min_price)
    return out.withColumn("kind", F.when(seasoned, kind)).where(F.col("kind").isNotNull()).drop("_hi", "_lo", "_n")


def price_distances(bars: DataFrame, windows=((30, 20), (50, 35), (150, 100), (200, 150))) -> DataFrame:
    """Percent distances to trailing means and one-year extremes; `windows` are (length, minimum history)."""
    year = trailing(per_symbol(), YEAR)
    out = bars.withColumns({"_no": F.row_number().over(per_symbol()), "_hi": F.max("close").over(year), "_lo": F.min("close").over(year)})
    last_high = F.max_by("_no", F.struct("close", "_no")).over(year)
    pct = lambda a, b: 100 * ratio(F.col(a) - b, b)
    return out.withColumns(
        {f"ma_{n}_dist_pct": pct("close", roll(F.avg, "close", per_symbol(), n, least)) for n, least in windows}
        | {
            "ret_3_pct": 100 * change("close", 3),
            "high_dist_pct": pct("close", F.col("_hi")),
            "low_dist_pct": pct("close", F.col("_lo")),
            "bars_from_high": (F.col("_no") - last_high).cast("bigint"),
            "vol_ratio": ratio("volume", roll(F.avg, "volume", per_symbol(), 20, 10, skip=1)),
        }
    ).drop("_no", "_hi", "_lo")


def session_state(bars: DataFrame) -> DataFrame:
    """What one session looked like: gap, intraday return, where it opened and closed, its range."""
    spread = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))
    turnover = F.col("close") * F.col("volume")
    return bars.withColumns({
        "gap": ratio("open", prev("close")) - 1,
        "ret_1": change(),
        "intraday": ratio("close", "open") - 1,
        "open_loc": ratio(F.col("open") - F.col("low"), spread),
        "close_loc": ratio(F.col("close") - F.col("low"), spread),
        "range_pct": ratio(spread, "open"),
        "turnover_ratio": ratio(turnover, roll(F.avg, turnover, per_symbol(), 20, 15)),
        "dist_52w_low": ratio("close", roll(F.min, "close", per_symbol(), 252, 120)) - 1,
        "log_adt": F.log(roll(F.avg, turnover, per_symbol(), 20, 15)),
    })


