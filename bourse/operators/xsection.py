"""Cross-sections: ranks, z-scores and clipping within a session.

The panel has one row per symbol and session, so a session's partition is bounded by the number of
listed symbols. For groups without that bound use `prefix.average_ranks`.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions import normal
from bourse.functions.frames import col, ratio


def peers(*by: str):
    return Window.partitionBy(*(by or ("date",)))


def average_rank(x, *by: str, ascending: bool = True) -> Column:
    """Average-tie rank of the non-NULL values."""
    x = col(x)
    w = peers(*by).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    ties = F.count(x).over(w.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def percentile_rank(x, *by: str, min_n: int = 1, ascending: bool = True) -> Column:
    n = F.count(col(x)).over(peers(*by))
    return F.when(n >= min_n, average_rank(x, *by, ascending=ascending) / n)


def midrank_percentile(x, *by: str) -> Column:
    """(fewer + half of equal) / n on a 0-100 scale; a lone value is 50."""
    n = F.count(col(x)).over(peers(*by))
    return F.when(n == 1, F.when(col(x).isNotNull(), 50.0)).otherwise(100 * (average_rank(x, *by) - 0.5) / n)


def linear_percentile(x, *by: str, tie: str = "symbol", higher_is_better: bool = True, missing: float = 50.0,
                      known_bad: Column | None = None) -> Column:
    """place/(n-1) on a 0-100 scale; missing is neutral, known-bad is zero."""
    x = col(x)
    order = x.asc_nulls_last() if higher_is_better else x.desc_nulls_last()
    place = F.row_number().over(peers(*by).orderBy(order, F.asc(tie))) - 1
    n = F.count(x).over(peers(*by))
    score = F.when(x.isNull() | (n <= 1), F.lit(missing)).otherwise(100 * place / (n - 1))
    return F.when(known_bad, 0.0).otherwise(score) if known_bad is not None else score


def neutral_percentile(x, *by: str, ascending: bool = True) -> Column:
    """Average-tie percentile on a 0-100 scale with missing values at the neutral 50."""
    return F.coalesce(100 * percentile_rank(x, *by, ascending=ascending), F.lit(50.0))


def rank_gauss(df: DataFrame, x: str, mask: Column | None = None, out: str = "gauss", by=("date",)) -> DataFrame:
    """Ranks inside the eligible universe mapped to a standard normal; missing stays missing."""
    kept = F.when(mask, F.col(x)) if mask is not None else F.col(x)
    placed = df.withColumn("_x", kept)
    placed = placed.withColumn("_u", (average_rank("_x", *by) - 0.5) / F.count("_x").over(peers(*by)))
    return normal.with_inverse(placed, "_u", out).drop("_x", "_u")


def zscore(x, *by: str) -> Column:
    """Z-score within the session; without dispersion every value is 0."""
    x = col(x)
    mean, sd = F.avg(x).over(peers(*by)), F.stddev_samp(x).over(peers(*by))
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((x - mean) / sd)


def sector_zscore(x, *by: str, min_n: int = 5) -> Column:
    """Z-score within (session, sector); thin or flat groups are NULL, not 0."""
    x, w = col(x), peers(*(by or ("date", "sector")))
    sd = F.stddev_samp(x).over(w)
    return F.when(F.count(x).over(w) >= min_n, ratio(x - F.avg(x).over(w), sd))


def winsorize(df: DataFrame, x: str, pct: float, out: str | None = None, by=("date",), min_n: int = 5) -> DataFrame:
    """Clip at observed values moved inward: rank ceil(p(n-1)) below, floor((1-p)(n-1)) above."""
    w = peers(*by)
    n = F.count(x).over(w)
    rows = df.withColumns({"_rn": F.row_number().over(w.orderBy(F.asc_nulls_last(x))) - 1, "_n": n})
    lo = F.max(F.when(F.col("_rn") == F.ceil(pct * (F.col("_n") - 1)), F.col(x))).over(w)
    hi = F.max(F.when(F.col("_rn") == F.floor((1 - pct) * (F.col("_n") - 1)), F.col(x))).over(w)
    rows = rows.withColumns({"_lo": lo, "_hi": hi})
    clipped = F.when(F.col(x).isNull() | (F.col("_n") < min_n), F.col(x)).otherwise(
        F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi"))
    )
    return rows.withColumn(out or f"{x}_w", clipped).drop("_rn", "_n", "_lo", "_hi")


def relative_strength(bars: DataFrame, sectors: DataFrame, min_universe: int = 20, min_sector: int = 5) -> DataFrame:
    """Cross-sectional rank of 21- and skip-month 63-session returns, and the return over the sector's mean."""
    w = Window.partitionBy("symbol").orderBy("date")
    out = bars.select("symbol", "date", "close").join(sectors, "symbol", "left").withColumns({
        "ret_21": F.col("close") / F.lag("close", 21).over(w) - 1,
        "ret_63": F.lag("close", 21).over(w) / F.lag("close", 63).over(w) - 1,
    })
    for c in ("ret_21", "ret_63"):
        out = out.withColumn(c.replace("ret", "rs_rank"), percentile_rank(c, min_n=min_universe))
    group = peers("date", "sector")
    for c in ("ret_21", "ret_63"):
        mean = F.when(F.count(c).over(group) >= min_sector, F.avg(c).over(group))
        out = out.withColumn(c.replace("ret", "rs_vs_sector"), F.when(F.col("sector").isNotNull(), F.col(c) - mean))
    return out.drop("close", "ret_21", "ret_63")


def sector_momentum(bars: DataFrame, sectors: DataFrame, horizons=(5, 21)) -> DataFrame:
    """Mean member return, in percent, per sector and session."""
    w = Window.partitionBy("symbol").orderBy("date")
    out = bars.select(
        "symbol", "date", *[(100 * (F.col("close") / F.lag("close", n).over(w) - 1)).alias(f"_{n}") for n in horizons]
    ).join(sectors, "symbol")
    return out.groupBy("date", "sector").agg(*[F.avg(f"_{n}").alias(f"sector_ret_{n}") for n in horizons])


def excess(df: DataFrame, fwd: str, centre: str = "mean", out: str = "excess", by=("date",)) -> DataFrame:
    """Forward return minus the session's equal-weight mean or median."""
    mid = F.avg(fwd) if centre == "mean" else F.percentile(fwd, F.lit(0.5))
    return df.withColumn(out, F.col(fwd) - mid.over(peers(*by)))


def sector_mean_excess(df: DataFrame, x: str, min_n: int = 5, out: str = "sector_excess") -> DataFrame:
    """Value over its (session, sector) mean where the sector is wide enough, else over the universe mean."""
    group = peers("date", "sector")
    centre = F.when(F.count(x).over(group) >= min_n, F.avg(x).over(group)).otherwise(F.avg(x).over(peers("date")))
    return df.withColumn(out, F.col(x) - centre)
