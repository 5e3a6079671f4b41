"""Sorts, top-k, pages and set operations."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio


def topk_per_group(df: DataFrame, keys, order, k: int) -> DataFrame:
    """Best k rows of each group. Spark cuts each group to k before the shuffle (window group limit), so
    a hot group sends k rows per task, not all of its rows."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def keyset_page(df: DataFrame, newest: str, key: str, after_time: Column, after_key, n: int) -> DataFrame:
    """The next n rows, newest first, after a (time, key) position."""
    later = (F.col(newest) < after_time) | ((F.col(newest) == after_time) & (F.col(key) > after_key))
    return df.where(later).orderBy(F.desc(newest), F.asc(key)).limit(n)


def percent_cut(df: DataFrame, score: str, share: float, by=("date",), tie: str = "symbol") -> DataFrame:
    """Top share of each session, at least one."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc(score), F.asc(tie))), "_n": F.count("*").over(w)})
    return rows.where(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(share * F.col("_n")))).drop("_rn", "_n")


def first_appearance(df: DataFrame, keys, since: Column, date: str = "date") -> DataFrame:
    """Members whose first ever appearance falls on or after a date."""
    return df.groupBy(*keys).agg(F.min(date).alias(date)).where(F.col(date) >= since)


def union_sources(frames: dict) -> DataFrame:
    """Several tables in one shape, tagged by source; columns a source lacks are NULL."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def half_life(df: DataFrame, key: str, today: Column, bucket_days: int, min_n: int = 5, min_buckets: int = 3) -> DataFrame:
    """Days until the win rate halves, from the slope of its logarithm over age buckets."""
    age = F.floor(F.datediff(today, "date") / bucket_days)
    rates = df.groupBy(key, age.alias("_b")).agg(F.avg((F.col("outcome") == "WIN").cast("double")).alias("_wr"), F.count("*").alias("_n"))
    fit = rates.where((F.col("_n") >= min_n) & (F.col("_wr") > 0)).groupBy(key).agg(F.regr_slope(F.log("_wr"), "_b").alias("_k"), F.count("*").alias("_c"))
    return fit.where(F.col("_c") >= min_buckets).select(key, F.when(F.col("_k") < 0, ratio(F.log(F.lit(2.0)), -F.col("_k")) * bucket_days).alias("half_life_days"))
