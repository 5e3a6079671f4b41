"""Option chains and futures."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, ratio, roll
from bourse.functions.normal import cdf_array
from bourse.functions.scalar import last_weekday_of_month
from bourse.operators.calendar import roll_forward
from bourse.operators.indicators import per_symbol, prev

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAIN = ("symbol", "expiry")


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike with the least total writer payout, lowest on ties.

    The payout at a strike follows from running sums of OI and OI x strike on either side, so strikes
    are never paired with each other.
    """
    w = Window.partitionBy(*CHAIN).orderBy("strike")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")
    calls = k * F.coalesce(F.sum("ce_oi").over(below), F.lit(0.0)) - F.coalesce(F.sum(F.col("ce_oi") * k).over(below), F.lit(0.0))
    puts = F.coalesce(F.sum(F.col("pe_oi") * k).over(above), F.lit(0.0)) - k * F.coalesce(F.sum("pe_oi").over(above), F.lit(0.0))
    rows = chain.withColumn("pain", F.round(calls + puts, 4))
    return rows.groupBy(*CHAIN).agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("least_payout"))


def put_call_ratios(chain: DataFrame, by=CHAIN) -> DataFrame:
    return chain.groupBy(*by).agg(ratio(F.sum("pe_oi"), F.sum("ce_oi")).alias("pcr_oi"), ratio(F.sum("pe_vol"), F.sum("ce_vol")).alias("pcr_vol"))


def option_walls(chain: DataFrame, spot: DataFrame, as_of: Column, near_days: int = 7) -> DataFrame:
    """Distance from spot to the largest call and put interest (lowest strike on ties); NULL without interest."""
    top = lambda oi: F.min_by("strike", F.struct(-F.col(oi), F.col("strike")))
    walls = chain.groupBy(*CHAIN).agg(F.when(F.max("ce_oi") > 0, top("ce_oi")).alias("_c"), F.when(F.max("pe_oi") > 0, top("pe_oi")).alias("_p")).join(spot, list(CHAIN))
    return walls.select(*CHAIN, (100 * (ratio("_c", "spot") - 1)).alias("call_wall_pct"), (100 * (1 - ratio("_p", "spot"))).alias("put_wall_pct"),
                        (F.datediff("expiry", as_of) <= near_days).alias("near_expiry"))


def atm_iv_skew(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """Mean volatility at the strike nearest spot, and out-of-the-money put minus call near five percent away."""
    rows = chain.join(spot, list(CHAIN)).where(F.col("ce_iv").isNotNull() | F.col("pe_iv").isNotNull())
    at = lambda target, value: F.min_by(value, F.struct(F.round(F.abs(F.col("strike") - target), 9), "strike"))
    out = rows.groupBy(*CHAIN).agg(
        at(F.col("spot"), F.struct("ce_iv", "pe_iv")).alias("_a"), at(F.col("spot") * 0.95, F.struct("pe_iv")).alias("_p"), at(F.col("spot") * 1.05, F.struct("ce_iv")).alias("_c"))
    a = F.col("_a")
    atm = F.when(a["ce_iv"].isNotNull() & a["pe_iv"].isNotNull(), (a["ce_iv"] + a["pe_iv"]) / 2).otherwise(F.coalesce(a["ce_iv"], a["pe_iv"]))
    return out.select(*CHAIN, atm.alias("atm_iv"), (F.col("_p")["pe_iv"] - F.col("_c")["ce_iv"]).alias("iv_skew"))


def expected_move_gex(chain: DataFrame, spot: DataFrame, band: float = 0.05) -> DataFrame:
    """Straddle at the nearest strike as a percent of spot, and (put - call)/(put + call) interest near it."""
    rows = chain.join(spot, list(CHAIN))
    near = F.abs(F.col("strike") / F.col("spot") - 1) <= band
    pick = lambda c: F.sum(F.when(near, F.col(c)).otherwise(0.0))
    straddle = F.min_by(F.col("ce_price") + F.col("pe_price"), F.struct(F.round(F.abs(F.col("strike") - F.col("spot")), 9), "strike"))
    return rows.groupBy(*CHAIN).agg((100 * straddle / F.first("spot")).alias("expected_move_pct"), ratio(pick("pe_oi") - pick("ce_oi"), pick("pe_oi") + pick("ce_oi")).alias("gex"))


def rollover_carry(futures: DataFrame) -> DataFrame:
    """Next expiry's share of near and next interest, and the near contract's annualised carry."""
    rank = F.dense_rank().over(Window.partitionBy("symbol", "date").orderBy("expiry"))
    rows = futures.withColumn("_k", rank).where("_k <= 2").groupBy("symbol", "date").agg(
        F.sum(F.when(F.col("_k") == 1, F.col("oi"))).alias("near_oi"), F.sum(F.when(F.col("_k") == 2, F.col("oi"))).alias("next_oi"),
        F.min(F.when(F.col("_k") == 1, F.struct("expiry", "close", "underlying"))).alias("_n"))
    n = F.col("_n")
    days = F.datediff(n["expiry"], "date")
    carry = F.when((n["underlying"] > 0) & (days > 0), (n["close"] / n["underlying"] - 1) * 100 / days * 365)
    return rows.where("next_oi IS NOT NULL").select("symbol", "date", "near_oi", "next_oi", (100 * ratio("next_oi", F.col("near_oi") + F.col("next_oi"))).alias("rollover_pct"), carry.alias("carry_pct"))


def futures_features(futures: DataFrame, bars: DataFrame) -> DataFrame:
    """Annualised basis, five-session change of interest in shares, and interest in days of average volume."""
    near = F.min(F.struct("expiry", "close", "underlying")).alias("_n")
    daily = futures.groupBy("symbol", "date").agg(near, F.sum(F.col("oi") * F.col("lot")).alias("shares"))
    adt = bars.select("symbol", "date", roll(F.avg, "volume", per_symbol(), 20, 15).alias("_adt"))
    rows = daily.join(adt, ["symbol", "date"], "left")
    n = F.col("_n")
    days = F.greatest(F.datediff(n["expiry"], "date"), F.lit(1))
    return rows.select("symbol", "date", ((ratio(n["close"], n["underlying"]) - 1) * 365 / days).alias("basis_ann"), (ratio("shares", prev("shares", 5)) - 1).alias("oi_chg_5"),
                       F.log1p(F.when(F.col("_adt") > 0, F.col("shares") / F.col("_adt"))).alias("oi_days"))


def option_term_features(days: DataFrame, vol: DataFrame, front_days: int = 7) -> DataFrame:
    """Front and next implied volatility (front at least a week out), over realised, slope, change and log ratios."""
    live = F.datediff("expiry", "date") >= front_days
    no = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc(live), "expiry"))
    rows = days.withColumns({"_live": live, "_no": no}).groupBy("symbol", "date").agg(
        F.max(F.when(F.col("_live") & (F.col("_no") == 1), F.col("atm_iv"))).alias("iv_front"), F.max(F.when(F.col("_live") & (F.col("_no") == 2), F.col("atm_iv"))).alias("iv_next"),
        F.sum("call_oi").alias("_co"), F.sum("put_oi").alias("_po"))
    rows = rows.join(vol, ["symbol", "date"], "left")
    pcr = F.log(F.when((F.col("_co") > 0) & (F.col("_po") > 0), F.col("_po") / F.col("_co")))
    return rows.select("symbol", "date", "iv_front", (F.col("iv_front") - F.col("realised")).alias("iv_rv"), (F.col("iv_next") - F.col("iv_front")).alias("iv_term"), (F.col("iv_front") - prev("iv_front", 5)).alias("iv_chg_5"), pcr.alias("log_pcr"))


def black76(forward, strike, years, sigma, call, rate):
    """Discounted option price on a forward, vectorised."""
    root = sigma * np.sqrt(years)
    d1 = (np.log(forward / strike) + 0.5 * sigma * sigma * years) / root
    sign = np.where(call, 1.0, -1.0)
    return np.exp(-rate * years) * sign * (forward * cdf_array(sign * d1) - strike * cdf_array(sign * (d1 - root)))


def implied_vol(rows: DataFrame, rate: float = 0.065, lo: float = 0.001, hi: float = 5.0) -> DataFrame:
    """Volatility that reproduces each price: bisection over whole Arrow batches; NULL outside the bounds.
    Rows carry price, forward, strike, years, is_call."""

    @F.pandas_udf("double")
    def solve(price: pd.Series, forward: pd.Series, strike: pd.Series, years: pd.Series, call: pd.Series) -> pd.Series:
        p, f, k, t = (x.to_numpy(float) for x in (price, forward, strike, years))
        c = call.to_numpy(bool)
        ok = (p > 0) & (f > 0) & (k > 0) & (t > 0)
        f, k, t = (np.where(ok, x, 1.0) for x in (f, k, t))
        a, b = np.full(len(p), lo), np.full(len(p), hi)
        ok &= (black76(f, k, t, a, c, rate) < p) & (p < black76(f, k, t, b, c, rate))
        for _ in range(50):
            mid = (a + b) / 2
            low = black76(f, k, t, mid, c, rate) < p
            a, b = np.where(low, mid, a), np.where(low, b, mid)
        return pd.Series(np.where(ok, (a + b) / 2, np.nan)).replace({np.nan: None}).astype("Float64")

    return rows.withColumn("iv", solve("price", "forward", "strike", "years", "is_call"))


def chain_day_features(chain: DataFrame, rate: float = 0.065, tol: float = 0.10) -> DataFrame:
    """Parity forward, volatility of out-of-the-money options, at-the-money interpolation and skew per chain.
    Chain rows carry ce_price, pe_price, strike, spot and years."""
    nearest = F.struct(F.round(F.abs(F.col("strike") - F.col("spot")), 9), "strike")
    both = F.col("ce_price").isNotNull() & F.col("pe_price").isNotNull()
    fwd = chain.where(both).groupBy(*CHAIN).agg(F.min_by(F.col("strike") + F.exp(rate * F.col("years")) * (F.col("ce_price") - F.col("pe_price")), nearest).alias("forward"))
    rows = chain.join(fwd.where("forward > 0"), list(CHAIN))
    call = F.col("strike") >= F.col("forward")
    rows = rows.select(*CHAIN, "strike", "forward", "years", call.alias("is_call"), F.when(call, F.col("ce_price")).otherwise(F.col("pe_price")).alias("price")).where("price IS NOT NULL")
    solved = implied_vol(rows, rate).where("iv IS NOT NULL")
    pair = F.struct("strike", "iv")
    out = solved.groupBy(*CHAIN).agg(
        F.first("forward").alias("forward"), F.max(F.when(~F.col("is_call"), pair)).alias("_b"), F.min(F.when(F.col("is_call"), pair)).alias("_a"),
        F.min_by("iv", F.struct(F.abs(F.col("strike") - 0.95 * F.col("forward")), "strike")).alias("_p"), F.min_by("iv", F.struct(F.abs(F.col("strike") - 1.05 * F.col("forward")), "strike")).alias("_c"))
    a, b, f = F.col("_a"), F.col("_b"), F.col("forward")
    one = F.coalesce(b, a)
    atm = F.when(a.isNotNull() & b.isNotNull(), F.when(a["strike"] == b["strike"], (a["iv"] + b["iv"]) / 2).otherwise(b["iv"] + (f - b["strike"]) / (a["strike"] - b["strike"]) * (a["iv"] - b["iv"]))).when(
        F.abs(one["strike"] / f - 1) <= tol, one["iv"])
    return out.select(*CHAIN, "forward", atm.alias("atm_iv"), (F.col("_p") - F.col("_c")).alias("skew"))


def participant_positioning(rows: DataFrame, sessions: DataFrame, classes) -> DataFrame:
    """(long - short)/(long + short) per class on every session, carried at most three sessions, with the
    five-session change of the first class."""
    wide = rows.groupBy("date").pivot("participant", list(classes)).agg(F.max(ratio(F.col("long_oi") - F.col("short_oi"), F.col("long_oi") + F.col("short_oi"))))
    # One row per session: a single ordered series.
    w = Window.orderBy("idx")
    out = sessions.join(wide, "date", "left").withColumns({f"{c}_net": F.last(c, ignorenulls=True).over(w.rowsBetween(-3, 0)) for c in classes})
    first = f"{classes[0]}_net"
    return out.select("date", "idx", *[f"{c}_net" for c in classes], (F.col(first) - F.lag(first, 5).over(w)).alias(f"{first}_chg_5"))


def expiry_clock(dates: DataFrame, sessions: DataFrame, switch: str = "2025-09-01") -> DataFrame:
    """Days to the monthly expiry: last Thursday of the month, last Tuesday from the switch date on."""
    def expiry(day):
        return F.when(day >= F.to_date(F.lit(switch)), last_weekday_of_month(day, "Tue")).otherwise(last_weekday_of_month(day, "Thu"))
    d = F.col("date")
    this, following = expiry(d), expiry(F.add_months(F.trunc(d, "month"), 1))
    return dates.withColumn("expiry", F.when(this >= d, this).otherwise(following)).withColumn("days_to_expiry", F.datediff("expiry", "date"))


def oi_buildup(df: DataFrame) -> DataFrame:
    """Positioning from the signs of price and interest changes."""
    p, o = F.col("close") - prev("close"), F.col("oi") - prev("oi")
    label = (F.when((p > 0) & (o > 0), "LONG_BUILDUP").when((p < 0) & (o > 0), "SHORT_BUILDUP").when((p < 0) & (o < 0), "LONG_UNWINDING").when((p > 0) & (o < 0), "SHORT_COVERING"))
    return df.withColumn("buildup", label)
