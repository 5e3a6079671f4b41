"""Statements, estimates, ownership, results and intraday session features, as known at each date."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, ratio, roll
from bourse.functions.scalar import bounded_revision, cagr
from bourse.operators.asof import asof_join
from bourse.operators.indicators import W_START, per_symbol, prev
from bourse.operators.order_statistics import with_percentiles


def by_period(*keys):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("period_end")


def surprise_series(fin: DataFrame, least: int = 4) -> DataFrame:
    """Change of each period over the same period a year before (350 to 380 days), and that change over the
    deviation of the symbol's own earlier changes."""
    asked = fin.withColumn("_t", F.date_sub("period_end", 365))
    past = fin.select("symbol", F.col("period_end").alias("_p"), F.col("value").alias("year_ago"))
    rows = asof_join(asked, past, "symbol", "_t", "_p", ["year_ago"], tolerance_days=15, direction="nearest", slice_unit="year").drop("_t", "matched")
    rows = rows.where("year_ago IS NOT NULL").withColumns({"change": F.col("value") - F.col("year_ago"), "growth": F.when(F.col("year_ago") > 0, F.col("value") / F.col("year_ago") - 1)})
    w = by_period().rowsBetween(W_START, -1)
    sd = F.when(F.count("change").over(w) >= least, F.stddev_samp("change").over(w))
    return rows.withColumn("sue", clamp(ratio("change", sd), -10.0, 10.0))


def earnings_reaction(events: DataFrame, bars: DataFrame, hold: int = 63, before=(25, 6)) -> DataFrame:
    """Two-session return over the cross-section's median around each event and its volume shock, carried
    for `hold` sessions from the second one; a later event takes over from its own second session."""
    w = Window.partitionBy("symbol").orderBy("idx")
    rows = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    rows = rows.withColumn("_a", F.col("_r") - F.percentile("_r", F.lit(0.5)).over(Window.partitionBy("date")))
    at = lambda c, n: F.first(c).over(w.rangeBetween(n, n))
    base = F.avg("volume").over(w.rangeBetween(-before[0], -before[1] - 1))
    rows = rows.withColumns({"_ear": F.col("_a") + at("_a", 1), "_shock": F.log(F.avg("volume").over(w.rangeBetween(0, 1)) / base)})
    hits = events.select("symbol", "idx").distinct().join(rows.where(F.col("idx") > before[0]), ["symbol", "idx"]).where("_ear IS NOT NULL")
    hits = hits.select("symbol", (F.col("idx") + 1).alias("idx"), F.col("_ear"), F.col("_shock"), F.col("idx").alias("_from"))
    carried = rows.select("symbol", "date", "idx").join(hits, ["symbol", "idx"], "left")
    last = F.last(F.when(F.col("_from").isNotNull(), F.struct("_ear", "_shock", "_from")), ignorenulls=True).over(w.rangeBetween(-(hold - 1), 0))
    e = carried.withColumn("_e", last)
    return e.select("symbol", "date", F.col("_e._ear").alias("ear"), F.col("_e._shock").alias("volume_shock"), (F.col("idx") - F.col("_e._from") - 1).alias("age"))


def estimate_revisions(panel: DataFrame, estimates: DataFrame, sessions_back: int = 63) -> DataFrame:
    """Level known now against the level known some sessions earlier; unbounded or sign-changing moves are NULL."""
    rows = asof_join(panel, estimates, "symbol", "date", "known", ["value"]).drop("matched")
    w = Window.partitionBy("symbol").orderBy("idx").rangeBetween(-sessions_back, -sessions_back)
    rows = rows.withColumn("_then", F.first("value").over(w))
    return rows.withColumn("revision", bounded_revision("value", "_then")).drop("_then")


def same_year_revisions(panel: DataFrame, estimates: DataFrame, sessions_back: int) -> DataFrame:
    """Revision of the nearest fiscal year still ahead, against that same year's earlier estimate."""
    years = estimates.groupBy("symbol", "fiscal_end").agg(F.min("known").alias("_first"))
    rows = panel.join(years, "symbol").where((F.col("fiscal_end") > F.col("date")) & (F.col("_first") <= F.col("date")))
    cols = panel.columns
    near = rows.groupBy(*cols).agg(F.min("fiscal_end").alias("fiscal_end"))
    back = panel.select("symbol", F.col("idx").alias("_i"), F.col("date").alias("_then"))
    near = near.withColumn("_i", F.col("idx") - sessions_back).join(back, ["symbol", "_i"], "left").drop("_i")
    keys = ["symbol", "fiscal_end"]
    now = asof_join(near, estimates.select(*keys, F.col("known").alias("_k"), F.col("value").alias("estimate")), keys, "date", "_k", ["estimate"]).drop("matched")
    both = asof_join(now, estimates.select(*keys, F.col("known").alias("_k"), F.col("value").alias("_was")), keys, "_then", "_k", ["_was"]).drop("matched")
    return both.withColumn("revision", bounded_revision("estimate", "_was")).drop("_was", "_then")


def ownership_qoq(rows: DataFrame, least: int = 80, most: int = 100) -> DataFrame:
    """Change of each holding only where the row before is the preceding quarter."""
    w = Window.partitionBy("symbol", "field").orderBy("period_end")
    gap = F.datediff("period_end", F.lag("period_end").over(w))
    return rows.withColumn("change", F.when(gap.between(least, most), F.col("value") - F.lag("value").over(w)))


def beat_features(rows: DataFrame, as_of: Column, lags: dict, default_lag: int = 60) -> DataFrame:
    """Newest beat score, beat and miss streaks over the newest four, latest annual surprise and dispersion,
    over rows published by a date: period end plus the lag of its kind."""
    lag = F.coalesce(*[F.when(F.col("period_type") == k, n) for k, n in lags.items()], F.lit(default_lag))
    known = rows.where(F.date_add("period_end", lag) <= as_of)
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end"), F.asc("period_type")))
    ranked = known.withColumn("_k", newest)
    first_not = lambda cond: F.coalesce(F.min(F.when(~cond, F.col("_k"))), F.count("*") + 1) - 1
    four = ranked.where("_k <= 4").groupBy("symbol").agg(
        F.max(F.when(F.col("_k") == 1, F.col("beat_score"))).alias("beat_last"), first_not(F.col("beat_score") > 0).alias("beat_streak"), first_not(F.col("beat_score") < 0).alias("miss_streak"))
    annual = known.where("period_type = 'annual'").groupBy("symbol").agg(F.max_by(F.struct("surprise_pct", "est_high", "est_low", "est_avg"), "period_end").alias("_a"))
    out = four.join(annual, "symbol", "left")
    return out.select("symbol", "beat_last", "beat_streak", "miss_streak", F.col("_a.surprise_pct").alias("surprise_pct"), ratio(F.col("_a.est_high") - F.col("_a.est_low"), F.abs("_a.est_avg")).alias("dispersion"))


def statement_ratios(rows: DataFrame, years: int = 3) -> DataFrame:
    """Cash conversion, trailing sums of four periods, growth over years and slope of the last eight periods."""
    w = by_period()
    four, eight = w.rowsBetween(-3, 0), w.rowsBetween(-7, 0)
    ttm = lambda c: F.when(F.count(c).over(four) >= 4, F.sum(c).over(four))
    out = rows.withColumns({"ttm_profit": ttm("profit"), "ttm_cash": ttm("cash"), "_no": F.row_number().over(w)})
    return out.withColumns({
        "cash_conversion": ratio("ttm_cash", "ttm_profit"), "profit_cagr": cagr("ttm_profit", F.lag("ttm_profit", 4 * years).over(w), years),
        "profit_slope": F.when(F.count("profit").over(eight) >= 8, F.regr_slope("profit", "_no").over(eight)),
    }).drop("_no")


def pe_bands(rows: DataFrame, value: str = "pe", days: int = 1095, least: int = 12) -> DataFrame:
    """Percentiles of a valuation over the symbol's trailing days, and where the newest one stands."""
    out = with_percentiles(rows.where(F.col(value) > 0), "symbol", "date", value, (0.25, 0.5, 0.75), "_c", "_n", days)
    known = F.col("_n") >= least
    label = F.when(F.col(value) <= F.col("_c")[0], "CHEAP").when(F.col(value) >= F.col("_c")[2], "DEAR").otherwise("FAIR")
    return out.select("symbol", "date", value, *[F.when(known, F.col("_c")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], F.when(known, label).alias("band"))


def event_clock(panel: DataFrame, events: DataFrame, cap: int) -> DataFrame:
    """Sessions since the last event and until the next, each at most `cap`."""
    back = asof_join(panel, events.select("symbol", F.col("event_date").alias("_e"), F.col("event_idx").alias("_b")), "symbol", "date", "_e", ["_b"]).drop("matched")
    both = asof_join(back, events.select("symbol", F.col("event_date").alias("_e"), F.col("event_idx").alias("_f")), "symbol", "date", "_e", ["_f"], direction="forward").drop("matched")
    within = lambda e: F.when(e <= cap, e)
    return both.withColumns({"since_event": within(F.col("idx") - F.col("_b")), "until_event": within(F.col("_f") - F.col("idx"))}).drop("_b", "_f")


def opening_range(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """Break of the first half hour's range, first-hour volume share and VWAP deviation per session.
    Bars carry ts, session and OHLCV; a session is folded in one aggregation after its start is attached."""
    start = F.min("ts").over(Window.partitionBy("symbol", "session"))
    rows = bars.withColumn("_m", (F.unix_timestamp("ts") - F.unix_timestamp(start)) / 60)
    first, hour = F.col("_m") < minutes, F.col("_m") < 60
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = rows.groupBy("symbol", "session").agg(
        F.max(F.when(first, F.col("high"))).alias("or_high"), F.min(F.when(first, F.col("low"))).alias("or_low"), F.max_by("close", "ts").alias("close"),
        ratio(F.coalesce(F.sum(F.when(hour, F.col("volume"))), F.lit(0.0)), F.sum("volume")).alias("first_hour_share"), ratio(F.sum(tp * F.col("volume")), F.sum("volume")).alias("_vwap"))
    return out.select("symbol", "session", "or_high", "or_low", (F.col("close") > F.col("or_high")).alias("broke_up"), (F.col("close") < F.col("or_low")).alias("broke_down"), "first_hour_share", (ratio("close", "_vwap") - 1).alias("vwap_dev"))


def early_movers(preopen: DataFrame, delivery: DataFrame, filings: DataFrame) -> DataFrame:
    """Pre-open gap and imbalance, delivery spike of T-1 against T-2..T-6, announcements since the last close,
    and their weighted score, capped at 100."""
    w = per_symbol()
    spike = delivery.select("symbol", "date", (ratio("deliv_pct", F.avg("deliv_pct").over(w.rowsBetween(-5, -1)))).alias("spike"))
    news = filings.groupBy("symbol", F.col("known").alias("date")).agg(F.count("*").alias("announcements"))
    rows = preopen.join(spike.withColumnRenamed("date", "prior_date"), ["symbol", "prior_date"], "left").join(news, ["symbol", "date"], "left")
    gap = F.least(F.abs(F.col("gap_pct")) * 8, F.lit(40.0))
    score = gap + F.when(F.col("imbalance") > 0.3, 15.0).otherwise(0.0) + F.when(F.col("spike") >= 1.5, 25.0).when(F.col("spike") >= 1.2, 12.0).otherwise(0.0) + F.when(F.coalesce("announcements", F.lit(0)) > 0, 20.0).otherwise(0.0)
    return rows.withColumns({"announcements": F.coalesce("announcements", F.lit(0)), "score": F.least(score, F.lit(100.0))})


def session_cumulative(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Running session VWAP, high and low read as of each run time: deviation and place in the range."""
    w = Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(W_START, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.select("symbol", "ts", F.col("close").alias("_c"), ratio(F.sum(tp * F.col("volume")).over(w), F.sum("volume").over(w)).alias("_v"), F.max("high").over(w).alias("_h"), F.min("low").over(w).alias("_l"))
    out = asof_join(runs, rows, "symbol", "run_ts", "ts", ["_c", "_v", "_h", "_l"], slice_unit="day")
    return out.select(*runs.columns, (100 * (ratio("_c", "_v") - 1)).alias("vwap_dev_pct"), ratio(F.col("_c") - F.col("_l"), F.col("_h") - F.col("_l")).alias("range_position"))
