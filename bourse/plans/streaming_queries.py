"""Streaming queries: a file source over the events, run to completion, read back as tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourse.operators import indicators as ind
from bourse.operators import prefix
from bourse.plans.registry import query
from bourse.plans.sqltext import prev
from bourse.session import written
from bourse.streaming import live, sinks, state


def tick_stream(t, files_per_batch: int = 1):
    """The events as quotes. The glob makes a one-file source of the table."""
    rows = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{t.folder}/event[s].parquet")
    return rows.select("event_id", F.col("event_type").alias("symbol"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"))


def run(t, name: str, stream, each=None):
    folder = sinks.work_folder(t.spark, name)
    sinks.run_available(stream, folder, each=each)
    rows = sinks.read_rows(t.spark, folder, stream.schema)
    stamps = [f.name for f in stream.schema.fields if f.dataType.typeName() == "timestamp"]
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("S1_bars_stream", doubles="open high low close volume vwap", sql=f"""
, b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, sum({K}) AS volume, sum(value * {K}) AS pv, count(*) AS n FROM events GROUP BY 1, 2)
SELECT symbol, start, open, high, low, close, volume, pv / nullif(volume, 0) AS vwap, n FROM b WHERE start + INTERVAL 15 MINUTE <= {CLOSED}""")
def _(t):
    return run(t, "bars", live.bars_stream(tick_stream(t), "15 minutes", "10 minutes"))


@query("S2_rolling_activity", doubles="mean", sql=f"""
, w AS (SELECT event_type AS symbol, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT symbol, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n, avg(value) AS mean FROM w WHERE start + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1, 2""")
def _(t):
    return run(t, "activity", live.rolling_activity(tick_stream(t), "1 hour", "30 minutes", "10 minutes"))


@query("S3_sessionize", doubles="total", sql=f"""
, g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 4 HOUR <= {CLOSED}""")
def _(t):
    return run(t, "sessions", live.sessionize(tick_stream(t), "user_id", "4 hours", "10 minutes"))


@query("S4_dedupe_stream", sql="SELECT DISTINCT user_id, event_type AS symbol FROM events")
def _(t):
    return run(t, "dedupe", live.dedupe_stream(tick_stream(t), ["user_id", "symbol"], "60 days").select("user_id", "symbol"))


@query("S5_late_data_policy", sql="SELECT 'main' AS side, count(*) AS rows FROM events")
def _(t):
    stream = tick_stream(t)
    folder = sinks.work_folder(t.spark, "late")
    sinks.run_available(stream, folder, each=sinks.split_late("ts", 600))
    on_time = sinks.read_rows(t.spark, folder, stream.schema).withColumn("side", F.lit("main"))
    return on_time.unionByName(sinks.read_rows(t.spark, folder, stream.schema, "late").withColumn("side", F.lit("late"))).groupBy("side").agg(F.count("*").alias("rows"))


LATE_SLICES = 4  # by time; every twentieth row comes one slice late
SLICED = f"""
, o AS (SELECT *, ntile({LATE_SLICES}) OVER (ORDER BY ts, event_id) - 1 AS q FROM events),
sl AS (SELECT *, CASE WHEN event_id % 20 = 0 THEN least(q + 1, {LATE_SLICES - 1}) ELSE q END AS slice FROM o)"""


def sliced_stream(t, name: str):
    """The events as a source of four batches by time, in which every twentieth row comes with the batch after its own."""
    quarter = prefix.ntiles(t.events, [], "ts", "event_id", LATE_SLICES, "q")
    number = F.when(F.col("event_id") % 20 == 0, F.least(F.col("q"), F.lit(LATE_SLICES - 1))).otherwise(F.col("q") - 1)
    folder = sinks.work_folder(t.spark, name)
    rows = written(quarter.select(*t.events.columns, number.alias("_slice")), "slices")
    places = sinks.slices_of(rows, F.col("_slice"), LATE_SLICES, f"{folder}/source")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(places)
    return folder, stream.select("event_id", F.col("event_type").alias("symbol"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"))


@query("S5_late_rows", sql=SLICED + """
, m AS (SELECT *, (SELECT max(ts) FROM sl b WHERE b.slice < a.slice) AS newest FROM sl a)
SELECT CASE WHEN ts < newest - INTERVAL 10 MINUTE THEN 'late' ELSE 'main' END AS side, slice, count(*) AS rows FROM m GROUP BY 1, 2""")
def _(t):
    """Four batches; rows that come after a later batch's watermark go to the side table, batch by batch."""
    folder, stream = sliced_stream(t, "late-rows")
    sinks.run_available(stream, folder, each=sinks.split_late("ts", 600))
    shape = f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch_id bigint"
    sides = [t.spark.read.schema(shape).parquet(f"{folder}/{part}").withColumn("side", F.lit(side)) for part, side in (("rows", "main"), ("late", "late"))]
    return sides[0].union(sides[1]).groupBy("side", F.col("batch_id").alias("slice")).agg(F.count("*").alias("rows"))


@query("S6_stream_enrich", uses="ticks", doubles="price typical", sql="SELECT event_id, t.symbol, price, typical FROM ticks t LEFT JOIN (SELECT event_type AS symbol, avg(value) AS typical FROM events WHERE event_type <> 'error' GROUP BY 1) d ON d.symbol = t.symbol")
def _(t):
    dims = t.events.where("event_type <> 'error'").groupBy(F.col("event_type").alias("symbol")).agg(F.avg("value").alias("typical"))
    return run(t, "enrich", live.stream_enrich(tick_stream(t).select("event_id", "symbol", "price"), dims, "symbol"))


@query("S7_price_move_alert", doubles="price move", sql="""
, q AS (SELECT event_type AS symbol, event_id, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
w AS (WITH RECURSIVE r AS (SELECT symbol, n, event_id, price, price AS last, CAST(NULL AS DOUBLE) AS move FROM q WHERE n = 1 UNION ALL
  SELECT q.symbol, q.n, q.event_id, q.price, CASE WHEN r.last <> 0 AND abs(q.price / r.last - 1) >= 0.5 THEN q.price ELSE r.last END, CASE WHEN r.last <> 0 AND abs(q.price / r.last - 1) >= 0.5 THEN q.price / r.last - 1 END FROM r JOIN q ON q.symbol = r.symbol AND q.n = r.n + 1) SELECT * FROM r)
SELECT symbol, event_id, price, move FROM w WHERE move IS NOT NULL""")
def _(t):
    return run(t, "moves", state.price_move_alerts(tick_stream(t), 0.5))


@query("S8_plan_guard", sql="""
, p AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1),
q AS (SELECT 'plan-' || e.event_type AS plan_id, CAST(ts AS DATE) AS day, ts, event_id, value AS price, m * 0.8 AS el, m * 1.2 AS eh, m * 0.1 AS st, m * 4 AS tg FROM events e JOIN p USING (event_type)),
r AS (SELECT *, first(price) OVER w AS f, min(price) OVER w AS l, max(price) OVER w AS h FROM q WINDOW w AS (PARTITION BY plan_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN f <= st THEN 'GAPPED_BELOW_STOP' WHEN l <= st AND h >= tg THEN 'STOP_AND_TARGET_TOUCHED' WHEN l <= st THEN 'STOP_HIT' WHEN h >= tg THEN 'TARGET_HIT' WHEN f > eh AND l > eh THEN 'GAPPED_ABOVE_ENTRY' WHEN price > eh THEN 'ABOVE_ENTRY' WHEN price < el THEN 'BELOW_ENTRY' ELSE 'IN_ENTRY_ZONE' END AS status FROM r)
SELECT plan_id, day, event_id, status FROM s QUALIFY row_number() OVER (PARTITION BY plan_id, day, status ORDER BY ts, event_id) = 1""")
def _(t):
    plans = t.events.groupBy(F.col("event_type").alias("symbol")).agg(F.avg("value").alias("m")).select("symbol", F.concat(F.lit("plan-"), "symbol").alias("plan_id"), (F.col("m") * 0.8).alias("entry_low"), (F.col("m") * 1.2).alias("entry_high"), (F.col("m") * 0.1).alias("stop"), (F.col("m") * 4).alias("target"))
    quotes = live.stream_enrich(tick_stream(t), plans, "symbol").withColumn("day", F.col("ts").cast("date"))
    return run(t, "plans", state.plan_guard(quotes))


@query("S9_trailing_stop", doubles="best stop", sql="""
, q AS (SELECT event_type AS symbol, event_id, value AS price, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT symbol, event_id, price AS best, price * (1 - 0.1) AS stop FROM q WHERE before IS NULL OR price > before""")
def _(t):
    return run(t, "stops", state.trailing_stops(tick_stream(t), 0.1))


@query("S10_signal_expiry")
def _(t):
    quotes = tick_stream(t).withColumns({"signal_id": F.concat_ws(":", "symbol", F.col("ts").cast("date").cast("string")), "up": F.lit(3.0), "down": F.lit(0.95)})
    return run(t, "expiry", state.signal_expiry(quotes, "10 minutes", 6 * 3600))


@query("S11_daily_alert_cap", sql="SELECT CAST(ts AS DATE) AS day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE value > 40) WHERE rn <= 20")
def _(t):
    alerts = tick_stream(t).where("price > 40").withColumn("day", F.col("ts").cast("date"))
    return run(t, "cap", state.daily_alert_cap(alerts, 20))


@query("S12_regime_nowcast", uses="ticks", doubles="score", sql="""
, d AS (SELECT *, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS now FROM ticks), n AS (SELECT day, symbol, arg_max(k, ts) / 100.0 AS v, max(ts) AS ts, max(now) AS now FROM d GROUP BY 1, 2),
f AS (SELECT day, v, CASE symbol WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.2 ELSE 0 END AS w FROM n WHERE epoch(now) - epoch(date_trunc('second', ts)) <= 3600), g AS (SELECT day, sum(w * v) / nullif(sum(w), 0) AS score, count(*) AS sources FROM f GROUP BY 1)
SELECT *, CASE WHEN score >= 0.6 THEN 'RISK_ON' WHEN score <= 0.4 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM g""")
def _(t):
    day = F.col("ts").cast("date")
    readings = t.ticks.select(day.alias("day"), F.col("symbol").alias("source"), (F.col("k") / 100.0).alias("value"), "ts", (F.date_add(day, 1)).cast("timestamp").alias("now"))
    return live.regime_nowcast(readings, ["day"], {"click": 0.5, "view": 0.3, "error": 0.2}, 3600)


@query("S12_regime_stream", doubles="score", sql=f"""
, d AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, time_bucket(INTERVAL 1 DAY, ts) AS cycle FROM events),
n AS (SELECT cycle, event_type AS source, arg_max(k / 100.0, row(ts, event_id)) AS v, max(ts) AS newest FROM d WHERE cycle + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, 2),
f AS (SELECT cycle, v, CASE source WHEN 'click' THEN CASE WHEN cycle < TIMESTAMP '2024-01-15' THEN 0.5 ELSE 0.1 END WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.2 ELSE 0 END AS w FROM n WHERE epoch(cycle + INTERVAL 1 DAY) - epoch(date_trunc('second', newest)) <= 7200),
g AS (SELECT cycle, round(sum(w * v) / nullif(sum(w), 0), 9) AS score, count(*) AS sources FROM f GROUP BY 1)
SELECT *, CASE WHEN score >= 0.6 THEN 'RISK_ON' WHEN score <= 0.4 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM g""")
def _(t):
    """Two keyed steps in one query, with weights that change on a day."""
    change = "TIMESTAMP '2024-01-15 00:00:00'"
    weights = t.spark.sql(f"""SELECT * FROM VALUES ('click', 0.5D, TIMESTAMP '1970-01-01 00:00:00', {change}), ('click', 0.1D, {change}, NULL),
        ('view', 0.3D, TIMESTAMP '1970-01-01 00:00:00', NULL), ('error', 0.2D, TIMESTAMP '1970-01-01 00:00:00', NULL) AS w(source, weight, since, until)""")
    readings = tick_stream(t).select("event_id", F.col("symbol").alias("source"), (F.col("size") / 100.0).alias("value"), "ts")
    return run(t, "regime", live.regime_stream(readings, weights, "1 day", "10 minutes", 7200))


def scan_closed_days(stream, folder, share: float, gap: float = -0.02):
    """Scan each day once it has closed, against the closes that earlier batches and days left."""
    def each(batch, folder, batch_id):
        spark = batch.sparkSession
        sinks.idempotent(batch, folder, batch_id, "bars")
        bars = spark.read.schema(batch.schema).parquet(f"{folder}/bars/batch_id={batch_id}")
        before = sinks.with_previous("bars", ["symbol"], "close", "date", spark)(bars, folder, batch_id)
        prior = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))  # several days may close in one batch
        days = before.withColumn("prev_close", F.coalesce(prior, "previous_close"))
        sinks.idempotent(live.capitulation_scan(days, gap, share).select("symbol", "date", "ret"), folder, batch_id)
    sinks.run_available(live.daily_bars_stream(stream, "10 minutes"), folder, each=each)


@query("S14_capitulation_stream", doubles="ret", sql=f"""
, b AS (SELECT event_type || ':' || (user_id % 20) AS symbol, CAST(ts AS DATE) AS date, arg_min(value, row(ts, event_id)) AS open, min(value) AS low, arg_max(value, row(ts, event_id)) AS close FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, 2),
p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM b), r AS (SELECT *, close / pc - 1 AS ret FROM p WHERE pc IS NOT NULL AND pc <> 0),
k AS (SELECT *, percent_rank() OVER (PARTITION BY date ORDER BY ret) AS pr FROM r)
SELECT symbol, date, ret FROM k WHERE open / pc - 1 <= -0.02 AND open <= low AND pr <= 0.3""")
def _(t):
    folder = sinks.work_folder(t.spark, "capitulation")
    ticks = tick_stream(t).withColumn("symbol", F.concat_ws(":", "symbol", (F.col("user_id") % 20).cast("string")))
    scan_closed_days(ticks, folder, share=0.3)
    return t.spark.read.schema("symbol string, date date, ret double").parquet(f"{folder}/rows").select("symbol", "date", "ret")


def rank_closed(stream, folder):
    """Rank the hours that have closed; all rows of an hour come out of the aggregation in the same batch."""
    def each(batch, folder, batch_id):
        sinks.idempotent(live.live_rank(batch, F.col("score"), F.col("n") >= 2, 2), folder, batch_id)
    sinks.run_available(live.closed_cycles(stream, "1 hour", "10 minutes"), folder, each=each)


@query("S13_live_rank", doubles="score", sql=f"""
, b AS (SELECT date_trunc('hour', ts) AS cycle, event_type AS symbol, avg(value) AS score, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, symbol) AS rank FROM b WHERE n >= 2 AND cycle + INTERVAL 1 HOUR <= {CLOSED}) WHERE rank <= 2""")
def _(t):
    folder = sinks.work_folder(t.spark, "rank")
    rank_closed(tick_stream(t), folder)
    return t.spark.read.parquet(f"{folder}/rows").select(F.col("cycle").cast("timestamp_ntz").alias("cycle"), "symbol", "score", "n", "rank")


@query("S14_capitulation_scan", uses="bars_s", doubles="ret", sql=f"""
, a AS (SELECT *, {prev('close')} AS pc FROM bars_s), b AS (SELECT *, close / pc - 1 AS ret FROM a WHERE pc IS NOT NULL), c AS (SELECT *, percent_rank() OVER (PARTITION BY date ORDER BY ret) AS p FROM b)
SELECT symbol, date, ret FROM c WHERE open / pc - 1 <= -0.02 AND open <= low AND p <= 0.3""")
def _(t):
    return live.capitulation_scan(t.bars_s.withColumn("prev_close", ind.prev("close")), share=0.3).select("symbol", "date", "ret")


@query("S15_idempotent_sink", doubles="price", sql="SELECT event_type AS symbol, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS price FROM events GROUP BY 1")
def _(t):
    stream = tick_stream(t).select("symbol", "event_id", "price")
    folder = sinks.work_folder(t.spark, "upsert")
    sinks.run_available(stream, folder, each=sinks.upsert_latest(["symbol"], "event_id"))
    return sinks.read_latest(t.spark, folder, stream.schema, ["symbol"], "event_id")


@query("S16_publish_new_picks", sql="SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day, CASE WHEN value > 20 THEN 'BUY' ELSE 'HOLD' END AS call FROM events")
def _(t):
    recs = tick_stream(t).withColumn("call", F.when(F.col("price") > 20, "BUY").otherwise("HOLD"))
    return run(t, "picks", live.publish_new_picks(recs, "60 days"))


@query("S17_capture_filter_hits", uses="ticks", sql="""
, f AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS cycle, event_id, symbol, unnest(list_filter([CASE WHEN price > 30 THEN 'dear' END, CASE WHEN k > 50 THEN 'busy' END], lambda x: x IS NOT NULL)) AS filter FROM ticks) SELECT * FROM f""")
def _(t):
    return run(t, "hits", live.capture_filter_hits(tick_stream(t), {"dear": F.col("price") > 30, "busy": F.col("size") > 50}, "15 minutes"))
