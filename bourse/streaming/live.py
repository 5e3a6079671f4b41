"""Streaming transformations: each works on a streaming frame with an event-time column `ts`."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio


def bars_stream(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """OHLCV and VWAP bars from quotes in tumbling windows; a bar comes out when its window has closed."""
    at = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("_pv"), F.count("*").alias("n"))
    return out.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", ratio("_pv", "volume").alias("vwap"), "n")


def rolling_activity(events: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Counts and means per symbol over overlapping windows."""
    out = events.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.avg("price").alias("mean"))
    return out.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessionize(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Episodes of a key separated by a gap."""
    out = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def dedupe_stream(events: DataFrame, keys, delay: str) -> DataFrame:
    """First row of each key within the lateness bound."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_enrich(rows: DataFrame, dims: DataFrame, on) -> DataFrame:
    """Live rows with a static dimension; unmatched rows stay."""
    return rows.join(dims, on, "left")


def publish_new_picks(recs: DataFrame, delay: str) -> DataFrame:
    """Each (symbol, day, call) once."""
    return dedupe_stream(recs.withColumn("day", F.col("ts").cast("date")), ["symbol", "day", "call"], delay).select("symbol", "day", "call")


def capture_filter_hits(rows: DataFrame, filters: dict, cycle: str) -> DataFrame:
    """Each polling cycle's matches as (cycle, symbol, filter) rows, one per filter a row passes."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in filters.items()]), lambda h: h.isNotNull())
    return rows.select(F.window("ts", cycle)["start"].alias("cycle"), "event_id", "symbol", F.explode(hits).alias("filter"))


def regime_nowcast(readings: DataFrame, by, weights: dict, max_age_seconds: int) -> DataFrame:
    """Weighted mean of each source's newest reading, over the sources present and fresh at `now`."""
    newest = readings.groupBy(*by, "source").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"), F.max("now").alias("now"))
    fresh = newest.where(F.unix_timestamp("now") - F.unix_timestamp("ts") <= max_age_seconds)
    w = F.coalesce(*[F.when(F.col("source") == s, float(x)) for s, x in weights.items()], F.lit(0.0))
    out = fresh.groupBy(*by).agg(ratio(F.sum(w * F.col("value")), F.sum(w)).alias("score"), F.count("*").alias("sources"))
    return out.withColumn("regime", F.when(F.col("score") >= 0.6, "RISK_ON").when(F.col("score") <= 0.4, "RISK_OFF").otherwise("NEUTRAL"))


def closed_readings(readings: DataFrame, width: str, delay: str) -> DataFrame:
    """(cycle, source, value, ts, now): each source's newest reading of a cycle (ties: largest event_id), once the watermark has passed its end."""
    out = readings.withWatermark("ts", delay).groupBy(F.window("ts", width), "source").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("_newest"))
    return out.select("window", F.window_time("window").alias("closed"), "source", "value", "_newest")


def regime_stream(readings: DataFrame, weights: DataFrame, width: str, delay: str, max_age_seconds: int) -> DataFrame:
    """(cycle, score, sources, regime) of each closed cycle, in one query of two keyed steps.

    The first step keeps each source's newest reading of the open cycles, so a cycle comes to the second as a row per
    source. Weights (source, weight, since, until) are a versioned table: a cycle takes the version valid at its end;
    sources without one weigh nothing. Readings too old at the end of the cycle are left out, as in `regime_nowcast`.
    """
    newest = closed_readings(readings, width, delay)
    end = F.col("window.end")
    fresh = newest.where(F.unix_timestamp(end) - F.unix_timestamp("_newest") <= max_age_seconds)
    versions = weights.select(F.col("source").alias("_of"), "weight", "since", "until")
    valid = (F.col("source") == F.col("_of")) & (F.col("since") <= F.col("closed")) & (F.col("until").isNull() | (F.col("closed") < F.col("until")))
    weighed = fresh.join(versions, valid, "left").withColumn("_w", F.coalesce("weight", F.lit(0.0)))
    out = weighed.groupBy(F.window("closed", width).alias("cycle")).agg(F.sum(F.col("_w") * F.col("value")).alias("_v"), F.sum("_w").alias("_w"), F.count("*").alias("sources"))
    out = out.select(F.col("cycle.start").alias("cycle"), F.round(ratio("_v", "_w"), 9).alias("score"), "sources")
    return out.withColumn("regime", F.when(F.col("score") >= 0.6, "RISK_ON").when(F.col("score") <= 0.4, "RISK_OFF").otherwise("NEUTRAL"))


def daily_bars_stream(ticks: DataFrame, delay: str) -> DataFrame:
    """Open, high, low and close per symbol and day; all bars of a day come out in the batch that closes it."""
    bars = bars_stream(ticks, "1 day", delay)
    return bars.select("symbol", F.col("start").cast("date").alias("date"), "open", "high", "low", "close")


def closed_cycles(quotes: DataFrame, width: str, delay: str) -> DataFrame:
    """Mean price and count per cycle and symbol, each once, when the watermark has passed the cycle's end."""
    out = quotes.withWatermark("ts", delay).groupBy(F.window("ts", width), "symbol").agg(F.avg("price").alias("score"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("cycle"), "symbol", "score", "n")


def live_rank(batch: DataFrame, score: Column, gate: Column, k: int) -> DataFrame:
    """Top k of each cycle by score, only while the gate on recent realised edge holds."""
    rows = batch.withColumn("score", score).where(gate)
    place = F.row_number().over(Window.partitionBy("cycle").orderBy(F.desc("score"), F.asc("symbol")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def capitulation_scan(day: DataFrame, gap: float = -0.02, share: float = 0.05) -> DataFrame:
    """Gapped down, opened at the low, and in the bottom share of the session's returns. Needs prev_close."""
    w = Window.partitionBy("date")
    ret = ratio("close", "prev_close") - 1
    rows = day.withColumn("ret", ret).where("ret IS NOT NULL").withColumn("_p", F.percent_rank().over(w.orderBy("ret")))
    return rows.where((ratio("open", "prev_close") - 1 <= gap) & (F.col("open") <= F.col("low")) & (F.col("_p") <= share)).drop("_p")
