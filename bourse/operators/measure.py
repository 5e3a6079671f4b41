"""Measurement: per-session rank correlation, its summary, top-k books and tail separation.

Everything is computed per session and then averaged over sessions, never pooled over rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import finite, ratio
from bourse.operators.xsection import average_rank, peers


def per_date_ic(panel: DataFrame, score: str, fwd: str, min_names: int = 10, min_scores: int = 0, keys=()) -> DataFrame:
    """Spearman correlation of score and forward return per session, with average-tie ranks."""
    by = (*keys, "date")
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    # Scores are counted by their last dense rank: the rows are sorted for the ranks anyway.
    place = [F.dense_rank().over(peers(*by).orderBy(F.asc_nulls_last(score))).alias("_d")] if min_scores else []
    ranked = rows.select(*by, average_rank(score, *by).alias("_s"), average_rank(fwd, *by).alias("_f"), *place)
    out = ranked.groupBy(*by).agg(
        finite(F.corr("_s", "_f")).alias("ic"), F.count("*").alias("names"),
        *([F.max("_d").alias("_distinct")] if min_scores else []),
    )
    keep = (F.col("names") >= min_names) & F.col("ic").isNotNull()
    if min_scores:
        keep = keep & (F.col("_distinct") > min_scores)
    return out.where(keep).drop("_distinct")


def newey_west(series: DataFrame, value: str, lags: int, keys=(), date: str = "date") -> DataFrame:
    """Mean and HAC t of a series with one row per session: Bartlett weights on `lags` autocovariances."""
    group = Window.partitionBy(*keys)
    w = group.orderBy(date)
    rows = series.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(group))
    rows = rows.select(*keys, value, "_e", *[F.lag("_e", i).over(w).alias(f"_l{i}") for i in range(1, lags + 1)])
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.avg((F.col(value) > 0).cast("double")).alias("pct_positive"),
        F.sum(F.col("_e") * F.col("_e")).alias("_c0"),
        *[F.coalesce(F.sum(F.col("_e") * F.col(f"_l{i}")), F.lit(0.0)).alias(f"_c{i}") for i in range(1, lags + 1)],
    )
    weighted = F.col("_c0")
    for i in range(1, lags + 1):
        weighted = weighted + 2 * (1 - i / (lags + 1)) * F.col(f"_c{i}")
    variance = weighted / F.col("n")
    t = F.when((F.col("n") >= 3) & (variance > 0), F.col("mean") / F.sqrt(variance / F.col("n")))
    return stats.select(*keys, "n", "mean", "std", "pct_positive", t.alias("t_nw"))


def ic_summary(ic: DataFrame, horizon: int, keys=(), min_effective: float = 20.0) -> DataFrame:
    """Mean, deviation, HAC t and share positive of an IC series; overlapping windows shrink the date count."""
    stats = newey_west(ic, "ic", max(horizon - 1, 0), keys)
    effective = F.col("n") / max(horizon, 1)
    return stats.select(
        *keys, F.lit(horizon).alias("horizon"), F.col("n").alias("n_dates"), F.round(effective, 2).alias("eff_dates"),
        F.col("mean").alias("mean_ic"), F.col("std").alias("ic_std"), "t_nw", "pct_positive",
        (effective >= min_effective).alias("reliable"),
    )


def topk_excess(panel: DataFrame, score: str, fwd: str, k: int, keys=(), tie: str = "symbol", min_names: int | None = None) -> DataFrame:
    """Per session: mean return of the k best scores minus the universe's mean and median."""
    by = (*keys, "date")
    least = max(2 * k, 10) if min_names is None else min_names
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    rows = rows.withColumn("_rn", F.row_number().over(peers(*by).orderBy(F.desc(score), F.asc(tie))))
    out = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_rn") <= k, F.col(fwd))).alias("top"), F.avg(fwd).alias("mean"),
        F.percentile(fwd, F.lit(0.5)).alias("median"), F.count("*").alias("names"),
    )
    return out.where(F.col("names") >= least).withColumns(
        {"exc_mean": F.col("top") - F.col("mean"), "exc_median": F.col("top") - F.col("median")}
    )


def median_beater(ic: DataFrame, topk: DataFrame) -> DataFrame:
    """Flags a score that orders names well and yet loses to the equal-weight mean."""
    a, b = ic.agg(F.avg("ic").alias("mean_ic")), topk.agg(F.avg("exc_mean").alias("topk_exc_mean"), F.avg("exc_median").alias("topk_exc_median"))
    return b.withColumn("mean_ic", a.scalar()).withColumn("median_beater", (F.col("mean_ic") > 0) & (F.col("topk_exc_mean") < 0))


def auc(rank: Column, positive: Column) -> Column:
    """Mann-Whitney area from average ranks, as an aggregate; NULL when one class is absent."""
    n1 = F.sum(F.when(positive, 1.0).otherwise(0.0))
    n0 = F.sum(F.when(positive, 0.0).otherwise(1.0))
    return ratio(F.sum(F.when(positive, rank).otherwise(0.0)) - n1 * (n1 + 1) / 2, n1 * n0)


def tail_aucs(panel: DataFrame, score: str, fwd: str, q: float = 0.2, min_names: int = 20, keys=()) -> DataFrame:
    """Mean per-session area under the curve for winners, losers, and winners against losers."""
    by = (*keys, "date")
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull()).withColumns({
        "_hi": F.percentile(fwd, F.lit(1 - q)).over(peers(*by)), "_lo": F.percentile(fwd, F.lit(q)).over(peers(*by)),
        "_n": F.count("*").over(peers(*by)),
    })
    rows = rows.where(F.col("_n") >= min_names)
    top, bottom = F.col(fwd) >= F.col("_hi"), F.col(fwd) <= F.col("_lo")
    rows = rows.withColumns({"_top": top, "_bot": bottom, "_tail": F.when(top | bottom, F.col(score))})
    rows = rows.withColumns({
        "_r": average_rank(score, *by), "_d": average_rank(score, *by, ascending=False), "_t": average_rank("_tail", *by),
    })
    daily = rows.groupBy(*by).agg(
        auc(F.col("_r"), F.col("_top")).alias("w"), auc(F.col("_d"), F.col("_bot")).alias("l"),
        ratio(
            F.sum(F.when(F.col("_top"), F.col("_t")).otherwise(0.0)) - F.count_if("_top") * (F.count_if("_top") + 1) / 2,
            F.count_if("_top") * F.count_if("_bot"),
        ).alias("s"),
    )
    return daily.groupBy(*keys).agg(
        F.avg("w").alias("auc_winners"), F.avg("l").alias("auc_losers"), F.avg("s").alias("auc_win_vs_lose"),
        F.count("*").alias("dates"),
    )


def quantile_returns(panel: DataFrame, score: str, fwd: str, bins: int = 10, tie: str = "symbol", keys=()) -> DataFrame:
    """Mean return over the universe per score bucket, averaged over sessions with three names a bucket."""
    by = (*keys, "date")
    w = peers(*by)
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull()).withColumns({
        "_i": F.row_number().over(w.orderBy(F.asc(score), F.asc(tie))) - 1, "_n": F.count("*").over(w), "_u": F.avg(fwd).over(w),
    })
    bucket = F.greatest(F.floor((F.col("_i") * bins + F.col("_n") - 2) / (F.col("_n") - 1)) - 1, F.lit(0))
    daily = rows.where(F.col("_n") >= 3 * bins).withColumn("bucket", bucket.cast("bigint")).groupBy(*by, "bucket").agg(
        (F.avg(fwd) - F.first("_u")).alias("_x"))
    return daily.groupBy(*keys, "bucket").agg(F.avg("_x").alias("mean_excess"), F.count("*").alias("dates"))


def effective_t(daily: DataFrame, value: str, horizon: int, keys=()) -> DataFrame:
    """Mean and t with the number of sessions divided by the horizon."""
    eff = F.greatest(F.count(value) / F.lit(float(max(horizon, 1))), F.lit(1.0))
    return daily.groupBy(*keys).agg(
        F.count(value).alias("dates"), F.avg(value).alias("mean"),
        F.when(F.stddev_samp(value) > 0, F.avg(value) / (F.stddev_samp(value) / F.sqrt(eff))).alias("t_eff"),
    )
