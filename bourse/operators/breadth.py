"""Market and sector breadth."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio, roll
from bourse.operators.indicators import per_symbol, prev


def market_breadth(bars: DataFrame, sma: int = 200, high: int = 20, year: int = 252, min_universe: int = 50) -> DataFrame:
    """Share above the long mean, advances over moves, share at a short high, net yearly highs; NULL if thin."""
    w = per_symbol()
    rows = bars.select("symbol", "date", "close").withColumns({
        "_sma": roll(F.avg, "close", w, sma), "_chg": F.col("close") - prev("close"), "_h": roll(F.max, "close", w, high),
        "_hi": roll(F.max, "close", w, year), "_lo": roll(F.min, "close", w, year),
    })
    at = lambda cond: F.count_if(cond)
    daily = rows.groupBy("date").agg(
        F.count("close").alias("_n"),
        ratio(at(F.col("close") > F.col("_sma")), F.count("_sma")).alias("pct_above_sma"),
        ratio(at(F.col("_chg") > 0), at(F.col("_chg") != 0)).alias("adv_decline_ratio"),
        ratio(at(F.col("close") >= F.col("_h")), F.count("_h")).alias("pct_at_high"),
        ratio(at(F.col("close") >= F.col("_hi")) - at(F.col("close") <= F.col("_lo")), F.count("_hi")).alias("net_highs_lows"),
    )
    names = ("pct_above_sma", "adv_decline_ratio", "pct_at_high", "net_highs_lows")
    return daily.select("date", *[F.when(F.col("_n") >= min_universe, F.col(c)).alias(c) for c in names])


def intraday_breadth(quotes: DataFrame, by, flat: float = 0.1, min_universe: int = 50) -> DataFrame:
    """Advancing share and mean move squashed into one 0-1 score with a risk tilt."""
    rows = quotes.where(F.col("change_pct").isNotNull()).groupBy(*by).agg(
        F.count_if(F.col("change_pct") > flat).alias("adv"), F.count_if(F.col("change_pct") < -flat).alias("dec"),
        F.count("*").alias("total"), F.avg("change_pct").alias("avg_change"))
    rows = rows.where(F.col("total") >= min_universe).withColumns({
        "adv_decline_ratio": F.coalesce(ratio("adv", F.col("adv") + F.col("dec")), F.lit(0.5)), "pct_positive": ratio("adv", "total")})
    rows = rows.withColumn("breadth_score", 0.6 * F.col("adv_decline_ratio") + 0.4 / (1 + F.exp(-F.col("avg_change") / 0.75)))
    s = F.col("breadth_score")
    return rows.withColumn("risk_tilt", F.when(s >= 0.62, "RISK_ON").when(s <= 0.38, "RISK_OFF").otherwise("NEUTRAL"))


def sector_rotation(members: DataFrame) -> DataFrame:
    """Per sector and session: bull and bear counts, net score, breadth, tier-one names, change of net."""
    daily = members.groupBy("date", "sector").agg(
        F.sum("bull").alias("bull_count"), F.sum("bear").alias("bear_count"), (F.sum("bull") - F.sum("bear")).alias("net_score"),
        F.sum("tier1").cast("bigint").alias("tier1_count"), F.avg((F.col("bull") > F.col("bear")).cast("double")).alias("breadth"), F.sum("volume").alias("momentum"))
    return daily.withColumn("net_change", F.col("net_score") - F.lag("net_score").over(Window.partitionBy("sector").orderBy("date")))
