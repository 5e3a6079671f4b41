"""Chart signals: rules over indicator columns, collected per row as an array of (type, strength)."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, ratio, roll
from bourse.operators.indicators import per_symbol, prev, trailing
from bourse.operators.rank import lookup
from bourse.operators.recurrences import recurrences


def recent_days(test, n: int = 5) -> Column:
    """How many of the last n bars pass, each measured against the current bar's average."""
    return reduce(lambda a, b: a + b, [F.coalesce(test(i).cast("int"), F.lit(0)) for i in range(n)])


def signal_panel(bars: DataFrame) -> DataFrame:
    """The indicator columns the rules read. Optional column: pcr."""
    w = per_symbol()
    rows = recurrences(bars).withColumns({
        "_no": F.row_number().over(w), "sma50": roll(F.avg, "close", w, 50), "sma200": roll(F.avg, "close", w, 200),
        "_mid": roll(F.avg, "close", w, 20), "_sd": roll(F.stddev_pop, "close", w, 20), "_v20": roll(F.avg, "volume", w, 20),
        "_hi20": roll(F.max, "high", w, 20, skip=1), "_hi252": roll(F.max, "high", w, 252, skip=1), "_range": F.col("high") - F.col("low"),
        "_up": F.coalesce(F.col("close") > prev("close"), F.lit(False)),
    })
    rows = rows.withColumns({
        "bb_width": ratio(4 * F.col("_sd"), "_mid"), "vol_ratio": F.coalesce(ratio("volume", "_v20"), F.lit(1.0)),
        "above": F.coalesce(F.col("close") > F.col("sma200"), F.lit(False)), "strong": F.coalesce(F.col("adx") >= 20, F.lit(False)),
        "_last_down": F.max(F.when(~F.col("_up"), F.col("_no"))).over(w.rowsBetween(-5, 0)),
        "_heavy": recent_days(lambda i: prev("volume", i) > 2 * F.col("_v20")),
        "_sold": recent_days(lambda i: (prev("close", i) < prev("open", i)) & (prev("volume", i) > 1.5 * F.col("_v20"))),
    })
    rows = rows.withColumn("streak", F.least(F.lit(6), F.col("_no") - 1, F.when(F.col("_last_down").isNotNull(), F.col("_no") - F.col("_last_down")).otherwise(6)))
    return rows if "pcr" in bars.columns else rows.withColumn("pcr", F.lit(None).cast("double"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Signal type to (condition, strength)."""
    c, rsi = F.col("close"), F.col("rsi_wilder")
    back = lambda x, n: prev(x, n)
    above, strong, v = F.col("above"), F.col("strong"), F.col("vol_ratio")
    graded = lambda high, medium: F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("WATCH")
    w = per_symbol()
    bb_low = F.min("bb_width").over(trailing(w, 60, 1))
    calm_lo, calm_avg = F.min("atr_wilder").over(trailing(w, 60, 1)), F.avg("atr_wilder").over(trailing(w, 60, 1))
    tight = (1 - ratio("atr_wilder", calm_avg)) * 100
    narrow = F.min("_range").over(trailing(w, 6, 1))
    squeeze = (1 - ratio("_range", F.avg("_range").over(trailing(w, 6, 1)))) * 100
    spread = 100 * ratio(F.col("ema_8") - F.col("ema_21"), "ema_21")
    fresh = (back("ema_8", 3) < back("ema_21", 3)) & (F.col("ema_8") > F.col("ema_21"))
    near = 100 * ratio(F.col("_hi252") - c, "_hi252")
    body = 100 * ratio(c - F.col("open"), "open")
    flat = F.abs(100 * (ratio(c, back("close", 5)) - 1))
    pcr = F.col("pcr")
    full = F.col("_no")
    lit = F.lit
    return {
        "RSI_DIVERGENCE": (above & (c < back("close", 5)) & (rsi > back("rsi_wilder", 5)) & rsi.between(35, 60), F.when(rsi - back("rsi_wilder", 5) > 3, "HIGH").otherwise("MEDIUM")),
        "HIDDEN_DIVERGENCE": (above & (c > back("close", 10)) & (rsi < back("rsi_wilder", 10)) & rsi.between(40, 65), lit("HIGH")),
        "RESISTANCE_BREAKOUT": ((c > F.col("_hi20")) & (v > 1.5), F.when((v > 2) & strong, "HIGH").when(strong, "MEDIUM").otherwise("WATCH")),
        "MACD_CROSSOVER": (above & (F.col("macd") > F.col("macd_signal")) & (back("macd", 1) < back("macd_signal", 1)), lit("MEDIUM")),
        "BB_COMPRESSION": (above & (full >= 62) & (F.col("bb_width") < bb_low * 1.15), lit("WATCH")),
        "GOLDEN_CROSS": ((full >= 202) & (F.col("sma50") > F.col("sma200")) & (back("sma50", 1) < back("sma200", 1)), lit("HIGH")),
        "OVERSOLD_RECOVERY": (above & (back("rsi_wilder", 4) < 35) & (rsi > 40) & (c > back("close", 4)), lit("MEDIUM")),
        "EMA_BULL_STACK": (above & (full >= 55) & (F.col("ema_8") > F.col("ema_21")) & (F.col("ema_21") > F.col("ema_50")) & (F.col("ema_50") > F.col("sma200")) & (c > F.col("ema_8")) & rsi.between(45, 70), graded(fresh, spread > 0.5)),
        "WEEK_52_BREAKOUT": ((full >= 254) & (c > F.col("_hi252")), graded((v > 2) & strong, v > 1.3)),
        "BULLISH_ENGULFING": (above & (back("close", 1) < back("open", 1)) & (F.col("open") <= back("close", 1)) & (c >= back("open", 1)) & (c > F.col("open")) & (v > 1.2), F.when((v > 2) & (body > 1.5), "HIGH").otherwise("MEDIUM")),
        "SUPERTREND_CROSS": ((full >= 10) & F.col("supertrend_up") & ~back("supertrend_up", 1), F.when(above, "HIGH").otherwise("MEDIUM")),
        "NR7_COMPRESSION": (above & (F.col("_range") < narrow) & (F.col("_range") > 0) & (full >= 8), F.when(squeeze > 50, "MEDIUM").otherwise("WATCH")),
        "VOLUME_ACCUMULATION": ((full >= 22) & (F.col("_heavy") >= 3) & (flat < 5), F.when((F.col("_heavy") >= 4) & (flat < 3), "HIGH").otherwise("MEDIUM")),
        "NEAR_52W_HIGH": ((full >= 254) & (near > 0) & (near <= 3) & (c > F.col("sma50")), graded(near <= 1, near <= 2)),
        "CONSECUTIVE_STRENGTH": (above & (F.col("streak") >= 4), graded((F.col("streak") >= 5) & strong, F.col("streak") >= 5)),
        "ATR_CONTRACTION": (above & (full >= 76) & (F.col("atr_wilder") > 0) & (F.col("atr_wilder") <= calm_lo * 1.05), graded(tight > 50, tight > 30)),
        "PCR_EXTREME": ((pcr > 1.3) | (pcr < 0.7), graded((pcr > 1.8) | (pcr < 0.4), (pcr > 1.5) | (pcr < 0.55))),
        "DEATH_CROSS": ((full >= 202) & (F.col("sma50") < F.col("sma200")) & (back("sma50", 1) >= back("sma200", 1)), lit("HIGH")),
        "RSI_BEARISH_DIVERGENCE": ((full >= 7) & (c > back("close", 5)) & (rsi < back("rsi_wilder", 5)) & rsi.between(55, 75), graded(back("rsi_wilder", 5) - rsi > 4, back("rsi_wilder", 5) - rsi > 2)),
        "DISTRIBUTION_DAY": ((full >= 22) & (F.col("_sold") >= 3), F.when(F.col("_sold") >= 4, "HIGH").otherwise("MEDIUM")),
    }


def technical_signals(bars: DataFrame, blocked=()) -> DataFrame:
    """Every rule that fires on each bar, without the blocked types."""
    rows = signal_panel(bars)
    fired = {t: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(t).alias("type"), strength.alias("strength"))) for t, (cond, strength) in rules().items() if t not in blocked}
    rows = rows.withColumns({f"_s_{t}": e for t, e in fired.items()})
    return rows.select("symbol", "date", F.filter(F.array(*[F.col(f"_s_{t}") for t in fired]), lambda s: s.isNotNull()).alias("signals"))


# Points by strength; squeezes say nothing about direction and count half.
POINTS = {"HIGH": 30, "MEDIUM": 20, "WATCH": 10}
SETUPS = ("BB_COMPRESSION", "ATR_CONTRACTION")


def signal_score(rows: DataFrame, rates: DataFrame, weights: DataFrame, regime: str = "regime", flow: str = "flow_3d") -> DataFrame:
    """Base points x win-rate band x setup discount x learned weight, summed, then regime and flow discounts.

    `rates` and `weights` are small tables keyed by signal type; each signal joins them, and the sum
    is taken per (symbol, date).
    """
    each = rows.select("symbol", "date", regime, flow, F.explode("signals").alias("_s")).select("symbol", "date", regime, flow, "_s.*")
    each = each.join(rates, "type", "left").join(weights, "type", "left")
    wr = F.col("win_rate")
    band = F.when(wr >= 0.65, 1.25).when(wr >= 0.55, 1.0).when(wr >= 0.45, 0.85).when(wr.isNotNull(), 0.70).otherwise(1.0)
    points = lookup("strength", POINTS, 0) * band * F.when(F.col("type").isin(*SETUPS), 0.5).otherwise(1.0) * clamp(F.coalesce("weight", F.lit(1.0)), 0.3, 2.0)
    discount = F.when(F.col(regime) == "BEAR", 0.60).when(F.col(regime) == "SIDEWAYS", 0.80).otherwise(1.0) * F.when(F.col(flow) < -3000, 0.85).otherwise(1.0)
    return each.groupBy("symbol", "date").agg(F.sum(points * discount).alias("signal_score"), F.count("*").alias("n_signals"))
