"""Signed flows: insider trades, block deals, broker calls, fund holdings.

Events are folded to one row per symbol and day before any window, so a busy day or symbol costs no
more than a quiet one.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio
from bourse.operators.indicators import per_symbol


def _days(c):
    return F.datediff(c, F.lit("1970-01-01"))


def signed_flow(trades: DataFrame, panel: DataFrame, trade_key, lag_days: int = 2, window_days: int = 90) -> DataFrame:
    """Buy share over the trailing window, a trade counting from its disclosure; 0.5 where nobody traded."""
    known = trades.where(F.col("side").isin("BUY", "SELL")).select(*trade_key).distinct()
    daily = known.groupBy("symbol", F.date_add("date", lag_days).alias("date")).agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(0.0)).alias("_b"), F.sum("qty").alias("_t"))
    both = panel.withColumn("_ask", F.lit(True)).join(daily, ["symbol", "date"], "full")
    w = Window.partitionBy("symbol").orderBy(_days("date")).rangeBetween(-(window_days - 1), 0)
    out = both.withColumn("buy_pct", F.coalesce(ratio(F.sum("_b").over(w), F.sum("_t").over(w)), F.lit(0.5)))
    return out.where("_ask").drop("_ask", "_b", "_t")


def block_deal_flow(deals: DataFrame, n: int = 5) -> DataFrame:
    """Net signed quantity and value per symbol and day, and over the last n days with deals."""
    sign = F.when(F.col("side") == "BUY", 1).when(F.col("side") == "SELL", -1).otherwise(0)
    daily = deals.groupBy("symbol", "date").agg(F.sum(sign * F.col("qty")).alias("net_qty"), F.sum(sign * F.col("value")).alias("net_value"), F.count("*").alias("deals"))
    w = per_symbol().rowsBetween(-(n - 1), 0)
    return daily.withColumns({f"net_qty_{n}": F.sum("net_qty").over(w), f"net_value_{n}": F.sum("net_value").over(w)})


def broker_consensus(panel: DataFrame, recos: DataFrame, days: int) -> DataFrame:
    """Calls of the trailing days before each date: count, buy share, mean target and upside."""
    daily = recos.groupBy("symbol", F.col("reco_date").alias("date")).agg(F.count("*").alias("_n"), F.count_if("is_buy").alias("_b"), F.sum("target").alias("_t"))
    both = panel.withColumn("_ask", F.lit(True)).join(daily, ["symbol", "date"], "full")
    w = Window.partitionBy("symbol").orderBy(_days("date")).rangeBetween(-days, -1)
    out = both.withColumns({"recos": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_bs": F.sum("_b").over(w), "_ts": F.sum("_t").over(w)}).where("_ask")
    out = out.withColumns({"buy_share": ratio("_bs", "recos"), "mean_target": ratio("_ts", "recos")})
    return out.select("symbol", "date", "recos", "buy_share", "mean_target", (ratio("mean_target", "close") - 1).alias("upside"))


def sector_flow(holdings: DataFrame) -> DataFrame:
    """Share of all assets held per sector and month, and its change against the month before."""
    monthly = holdings.groupBy("sector", "month").agg(F.sum("value").alias("_v"))
    share = monthly.withColumn("aum_pct", 100 * F.col("_v") / F.sum("_v").over(Window.partitionBy("month"))).drop("_v")
    return share.withColumn("flow_pct", F.col("aum_pct") - F.lag("aum_pct").over(Window.partitionBy("sector").orderBy("month")))
