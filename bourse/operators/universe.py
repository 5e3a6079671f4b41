"""Universe predicates: what may be traded, priced, screened or trained on."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import finite, roll
from bourse.operators.indicators import W_START, per_symbol


def universe_mask(bars: DataFrame, min_price: float, min_adt: float, min_hist: int, series=None) -> DataFrame:
    """Traded, allowed series, price floor, 20-session mean turnover (15 seen) and enough sessions behind it."""
    adt = roll(F.avg, F.col("close") * F.col("volume"), per_symbol(), 20, 15)
    seen = F.count("close").over(per_symbol().rowsBetween(W_START, 0))
    allowed = F.col("series").isin(*series) if series else F.lit(True)
    mask = F.col("close").isNotNull() & allowed & (F.col("close") >= min_price) & F.coalesce(adt >= min_adt, F.lit(False)) & (seen >= min_hist)
    return bars.withColumn("eligible", mask)


def restrict_tradeable(candidates: DataFrame, master: DataFrame, prices: DataFrame) -> DataFrame:
    return candidates.join(master.select("symbol"), "symbol", "left_semi").join(prices.select("symbol"), "symbol", "left_semi")


def liquid_symbols(bars: DataFrame, min_turnover: float, n: int = 20) -> DataFrame:
    """Symbols whose mean traded value over their last n sessions reaches the floor."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    last = bars.withColumn("_rn", newest).where(F.col("_rn") <= n)
    return last.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adt")).where(F.col("adt") >= min_turnover)


def post_exit(bars: DataFrame, official: DataFrame, grace_days: int) -> DataFrame:
    """Symbols whose bars go on past the exchange's last trade plus a grace."""
    mine, theirs = bars.groupBy("symbol").agg(F.max("date").alias("last_bar")), official.groupBy("symbol").agg(F.max("date").alias("last_trade"))
    return mine.join(theirs, "symbol").where(F.col("last_bar") > F.date_add("last_trade", grace_days))


def valid_observation(bars: DataFrame, listed: DataFrame, exits: DataFrame, holidays: DataFrame, share: float = 0.95, min_bars: int = 50) -> DataFrame:
    """Why a row cannot be a real observation: unlisted, after exit, holiday, or a fabricated flat session."""
    flat = (F.coalesce("volume", F.lit(0.0)) == 0) & (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    fake = bars.groupBy("date").agg(F.count("*").alias("_n"), F.avg(F.coalesce(flat, F.lit(False)).cast("double")).alias("_f")).where(
        (F.col("_n") > min_bars) & (F.col("_f") >= share)).select("date", F.lit(True).alias("_fake"))
    rows = bars.join(listed.select("symbol", F.lit(True).alias("_listed")), "symbol", "left").join(exits.select("symbol", "last_trade"), "symbol", "left")
    rows = rows.join(holidays.select("date", F.lit(True).alias("_shut")), "date", "left").join(fake, "date", "left")
    reason = (F.when(F.col("_listed").isNull(), "UNLISTED").when(F.col("date") > F.col("last_trade"), "POST_EXIT")
              .when(F.col("_shut"), "HOLIDAY").when(F.col("_fake"), "CLOSED_SESSION"))
    return rows.withColumn("reject_reason", reason).drop("_listed", "last_trade", "_shut", "_fake")


def finite_only(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def session_filter(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Whether the row's date is a weekday outside the holiday table."""
    shut = holidays.select(F.col("date").alias(date), F.lit(True).alias("_shut"))
    return df.join(shut, date, "left").withColumn("is_session", (F.weekday(date) < 5) & F.col("_shut").isNull()).drop("_shut")


def on_grid(df: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Bars stamped on the interval; a trailing last-price row is not one."""
    return df.where((F.minute(ts) % minutes == 0) & (F.second(ts) == 0))


def screen(df: DataFrame, criteria: dict) -> DataFrame:
    """Optional (min, max) per column; NULL fails only a criterion that is set."""
    def limits(c, lo, hi) -> list[Column]:
        return ([F.col(c) >= lo] if lo is not None else []) + ([F.col(c) <= hi] if hi is not None else [])
    tests = [t for c, (lo, hi) in criteria.items() for t in limits(c, lo, hi)]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def coverage(df: DataFrame, cols, min_coverage: float) -> DataFrame:
    """Share of non-NULL values per column in one pass, and whether it reaches the bar."""
    n = F.count("*")
    each = [F.struct(F.lit(c).alias("column"), (F.count(c) / n).alias("coverage"), F.count(c).alias("filled")) for c in cols]
    out = df.agg(F.array(*each).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    return out.withColumn("passes", F.col("coverage") >= min_coverage)


def untrainable(df: DataFrame, cols, recent: Column, min_share: float, min_distinct: int, min_std: float) -> DataFrame:
    """Columns to drop: sparse, nearly constant, without spread, or no longer written on recent rows."""
    n = F.count("*")
    each = [F.struct(F.lit(c).alias("column"), (F.count(c) / n).alias("share"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.count_if(recent & F.col(c).isNotNull()).alias("recent"),
                     (F.min(c) == F.max(c)).alias("constant")) for c in cols]
    out = df.agg(F.array(*each).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    # Exact distinct counts in two steps: equal values fold before they are counted per column.
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_v")).select("_v.*").where("value IS NOT NULL").distinct()
    out = out.join(values.groupBy("column").agg(F.count("*").alias("_distinct")), "column", "left")
    reason = (F.when(F.col("share") < min_share, "SPARSE").when(F.coalesce("constant", F.lit(True)) | (F.coalesce("_distinct", F.lit(0)) < min_distinct), "FEW_VALUES")
              .when(F.col("std") < min_std, "NO_SPREAD").when(F.col("recent") == 0, "NOT_WRITTEN"))
    return out.select("column", "share", "std", "recent", reason.alias("drop_reason"))


def restricted_exclude(df: DataFrame, flags: DataFrame, worst_stage: int) -> DataFrame:
    """Without names under a surveillance stage in force on the row's date."""
    barred = flags.where(F.col("stage") >= worst_stage)
    inside = (df["symbol"] == barred["symbol"]) & (df["date"] >= barred["from_date"]) & (barred["to_date"].isNull() | (df["date"] <= barred["to_date"]))
    return df.join(barred, inside, "left_anti")


def ensure_grid(bars: DataFrame, liquid: DataFrame, date: Column) -> DataFrame:
    """One row for every liquid symbol on a date, filled where a bar is known."""
    on = bars.where(F.col("date") == date).select("symbol", "close", "volume")
    return liquid.select("symbol").join(on, "symbol", "left").select("symbol", date.alias("date"), "close", "volume", F.col("close").isNotNull().alias("observed"))
