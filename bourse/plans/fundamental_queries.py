"""Queries for statements, estimates, results and intraday session features."""

from pyspark.sql import functions as F

from bourse.operators import calendar, fundamentals as fd
from bourse.operators import indicators as ind
from bourse.plans.registry import query
from bourse.plans.sqltext import P, prev

HOURLY = """, hb AS (SELECT symbol, CAST(ts AS DATE) AS session, date_trunc('hour', ts) AS ts, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(k) AS DOUBLE) AS volume FROM ticks GROUP BY symbol, CAST(ts AS DATE), date_trunc('hour', ts))"""


def hourly(t):
    return t.ticks.groupBy("symbol", F.col("ts").cast("date").alias("session"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.sum("k").cast("double").alias("volume"))


@query("E30_opening_range", uses="ticks", doubles="or_high or_low first_hour_share vwap_dev", sql=HOURLY + """
, m AS (SELECT *, date_diff('minute', min(ts) OVER (PARTITION BY symbol, session), ts) AS m FROM hb),
g AS (SELECT symbol, session, max(high) FILTER (WHERE m < 120) AS h, min(low) FILTER (WHERE m < 120) AS l, arg_max(close, ts) AS c, coalesce(sum(volume) FILTER (WHERE m < 60), 0) / nullif(sum(volume), 0) AS s, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS v FROM m GROUP BY 1, 2)
SELECT symbol, session, h AS or_high, l AS or_low, c > h AS broke_up, c < l AS broke_down, s AS first_hour_share, c / v - 1 AS vwap_dev FROM g""")
def _(t):
    return fd.opening_range(hourly(t), 120)


@query("E35_event_clock", uses="bars_s sessions_m", sql="""
, b AS (SELECT symbol, b.date, idx FROM bars_s b JOIN sessions_m s ON b.date = s.date), e AS (SELECT symbol, b.date AS event_date, idx AS event_idx FROM bars_s b JOIN sessions_m s ON b.date = s.date WHERE n >= 12),
x AS (SELECT b.symbol, b.date, b.idx, max(event_idx) FILTER (WHERE event_idx <= idx) AS p, min(event_idx) FILTER (WHERE event_idx >= idx) AS f FROM b LEFT JOIN e ON e.symbol = b.symbol GROUP BY 1, 2, 3)
SELECT symbol, date, idx, CASE WHEN idx - p <= 21 THEN idx - p END AS since_event, CASE WHEN f - idx <= 21 THEN f - idx END AS until_event FROM x""")
def _(t):
    bars = calendar.session_index(t.bars_s.select("symbol", "date", "n"), t.sessions_m)
    events = bars.where("n >= 12").select("symbol", F.col("date").alias("event_date"), F.col("idx").alias("event_idx"))
    return fd.event_clock(bars.select("symbol", "date", "idx"), events, 21)


QTR = """, qt AS (SELECT 'S' || l_suppkey AS symbol, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS period_end, sum(l_extendedprice) / 1000 AS value, sum(l_quantity) AS cash FROM lineitem GROUP BY 1, 2)"""


def quarters(t):
    end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    return t.lineitem.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), end.alias("period_end")).agg((F.sum("l_extendedprice") / 1000).alias("value"), F.sum("l_quantity").alias("cash"))


@query("E41_surprise_series", doubles="value year_ago change growth sue", sql=QTR + """
, j AS (SELECT a.symbol, a.period_end, a.value, b.value AS year_ago, a.value - b.value AS change, a.value / b.value - 1 AS growth FROM qt a JOIN qt b ON b.symbol = a.symbol AND date_diff('day', b.period_end, a.period_end) BETWEEN 350 AND 380)
SELECT *, least(greatest(change / nullif(CASE WHEN count(change) OVER w >= 4 THEN stddev_samp(change) OVER w END, 0), -10), 10) + 0 * change / CASE WHEN count(change) OVER w >= 4 THEN 1 END AS sue FROM j WINDOW w AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    return fd.surprise_series(quarters(t).drop("cash"))


@query("E42_earnings_reaction", uses="bars_w sessions_w", doubles="ear volume_shock", sql=f"""
, b AS (SELECT b.*, idx, close / {prev('close').replace('date)', 'b.date)')} - 1 AS r FROM bars_w b JOIN sessions_w s ON b.date = s.date), a AS (SELECT *, r - quantile_cont(r, 0.5) OVER (PARTITION BY date) AS a FROM b),
h AS (SELECT x.symbol, x.idx AS f, x.a + y.a AS ear, ln((SELECT avg(volume) FROM a z WHERE z.symbol = x.symbol AND z.idx BETWEEN x.idx AND x.idx + 1) / (SELECT avg(volume) FROM a z WHERE z.symbol = x.symbol AND z.idx BETWEEN x.idx - 25 AND x.idx - 7)) AS sh
  FROM a x JOIN a y ON y.symbol = x.symbol AND y.idx = x.idx + 1 WHERE x.n >= 12 AND x.idx > 25 AND x.a IS NOT NULL AND y.a IS NOT NULL),
c AS (SELECT a.symbol, a.date, a.idx, max(f) AS f FROM a LEFT JOIN h ON h.symbol = a.symbol AND h.f + 1 BETWEEN a.idx - 12 AND a.idx GROUP BY 1, 2, 3)
SELECT c.symbol, c.date, ear, sh AS volume_shock, c.idx - c.f - 1 AS age FROM c LEFT JOIN h ON h.symbol = c.symbol AND h.f = c.f""")
def _(t):
    bars = calendar.session_index(t.bars_w, t.sessions_w)
    return fd.earnings_reaction(bars.where("n >= 12").select("symbol", "idx"), bars, hold=13)


EST = """, es AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS known, avg(l_extendedprice) AS value FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2), pn AS (SELECT symbol, b.date, idx FROM bars_s b JOIN sessions_m s ON b.date = s.date)"""


def estimates(t):
    return t.lineitem.where("l_quantity >= 45").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("known")).agg(F.avg("l_extendedprice").alias("value"))


@query("E43_estimate_revisions", uses="bars_s sessions_m", doubles="value revision", sql=EST + """
, k AS (SELECT pn.*, es.value FROM pn ASOF LEFT JOIN es ON pn.symbol = es.symbol AND pn.date >= es.known)
SELECT a.symbol, a.date, a.idx, a.value, CASE WHEN sign(a.value) = sign(b.value) AND abs(a.value / b.value - 1) <= 1 THEN a.value / b.value - 1 END AS revision FROM k a LEFT JOIN k b ON b.symbol = a.symbol AND b.idx = a.idx - 3""")
def _(t):
    return fd.estimate_revisions(calendar.session_index(t.bars_s.select("symbol", "date"), t.sessions_m), estimates(t), 3)


@query("E43_same_year_revisions", uses="bars_s sessions_m", doubles="estimate revision", sql=EST + """
, fy AS (SELECT symbol, known, value, make_date(CAST(year(known) + CASE WHEN value > 45000 THEN 2 ELSE 1 END AS INTEGER), 3, 31) AS fiscal_end FROM es), yr AS (SELECT symbol, fiscal_end, min(known) AS f FROM fy GROUP BY 1, 2),
nr AS (SELECT pn.symbol, pn.date, pn.idx, min(fiscal_end) AS fiscal_end FROM pn JOIN yr ON yr.symbol = pn.symbol AND fiscal_end > date AND f <= date GROUP BY 1, 2, 3), wt AS (SELECT nr.*, p.date AS wn FROM nr LEFT JOIN pn p ON p.symbol = nr.symbol AND p.idx = nr.idx - 3),
a AS (SELECT wt.*, x.value AS estimate FROM wt ASOF LEFT JOIN fy x ON x.symbol = wt.symbol AND x.fiscal_end = wt.fiscal_end AND wt.date >= x.known), b AS (SELECT a.*, y.value AS was FROM a ASOF LEFT JOIN fy y ON y.symbol = a.symbol AND y.fiscal_end = a.fiscal_end AND a.wn >= y.known)
SELECT symbol, date, idx, fiscal_end, estimate, CASE WHEN sign(estimate) = sign(was) AND abs(estimate / was - 1) <= 1 THEN estimate / was - 1 END AS revision FROM b""")
def _(t):
    year = F.year("known") + F.when(F.col("value") > 45000, 2).otherwise(1)
    rows = estimates(t).withColumn("fiscal_end", F.make_date(year, F.lit(3), F.lit(31)))
    return fd.same_year_revisions(calendar.session_index(t.bars_s.select("symbol", "date"), t.sessions_m), rows, 3)


@query("E44_ownership_qoq", doubles="value change", sql=QTR + """
, o AS (SELECT symbol, 'held' AS field, period_end, value FROM qt WHERE CAST(cash AS BIGINT) % 5 <> 0)
SELECT *, CASE WHEN date_diff('day', lag(period_end) OVER w, period_end) BETWEEN 80 AND 100 THEN value - lag(value) OVER w END AS change FROM o WINDOW w AS (PARTITION BY symbol ORDER BY period_end)""")
def _(t):
    return fd.ownership_qoq(quarters(t).where("CAST(cash AS BIGINT) % 5 <> 0").select("symbol", F.lit("held").alias("field"), "period_end", "value"))


@query("E45_beat_streak", doubles="surprise_pct dispersion", sql=QTR + """
, b AS (SELECT symbol, period_end, CASE WHEN month(period_end) = 3 THEN 'annual' ELSE 'quarter' END AS pt, CASE WHEN value > 560 THEN 1 WHEN value < 420 THEN -1 ELSE 0 END AS s, value / 10 AS sp, value + cash AS hi, value - cash / 2 AS lo, value AS av FROM qt),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS k FROM b WHERE period_end + CASE pt WHEN 'annual' THEN 60 ELSE 45 END <= DATE '2001-06-30'),
f AS (SELECT symbol, max(CASE WHEN k = 1 THEN s END) AS beat_last, coalesce(min(CASE WHEN NOT s > 0 THEN k END), count(*) + 1) - 1 AS beat_streak, coalesce(min(CASE WHEN NOT s < 0 THEN k END), count(*) + 1) - 1 AS miss_streak FROM k WHERE k <= 4 GROUP BY 1),
a AS (SELECT symbol, arg_max(sp, period_end) AS sp, arg_max((hi - lo) / abs(av), period_end) AS d FROM k WHERE pt = 'annual' GROUP BY 1) SELECT f.*, sp AS surprise_pct, d AS dispersion FROM f LEFT JOIN a ON a.symbol = f.symbol""")
def _(t):
    v, c = F.col("value"), F.col("cash")
    rows = quarters(t).select("symbol", "period_end", F.when(F.month("period_end") == 3, "annual").otherwise("quarter").alias("period_type"), F.when(v > 560, 1).when(v < 420, -1).otherwise(0).alias("beat_score"), (v / 10).alias("surprise_pct"),
                              (v + c).alias("est_high"), (v - c / 2).alias("est_low"), v.alias("est_avg"))
    return fd.beat_features(rows, F.to_date(F.lit("2001-06-30")), {"annual": 60, "quarter": 45})


@query("E46_statement_ratios", doubles="profit cash ttm_profit ttm_cash cash_conversion profit_cagr profit_slope", sql=QTR + """
, a AS (SELECT symbol, period_end, value - 100 AS profit, cash, row_number() OVER (PARTITION BY symbol ORDER BY period_end) AS no FROM qt),
b AS (SELECT *, CASE WHEN count(*) OVER f >= 4 THEN sum(profit) OVER f END AS ttm_profit, CASE WHEN count(*) OVER f >= 4 THEN sum(cash) OVER f END AS ttm_cash, CASE WHEN count(*) OVER e >= 8 THEN regr_slope(profit, no) OVER e END AS profit_slope FROM a
  WINDOW f AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), e AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, lag(ttm_profit, 12) OVER (PARTITION BY symbol ORDER BY period_end) AS old FROM b)
SELECT symbol, period_end, profit, cash, ttm_profit, ttm_cash, ttm_cash / ttm_profit AS cash_conversion, CASE WHEN ttm_profit > 0 AND old > 0 THEN (pow(ttm_profit / old, 1 / 3.0) - 1) * 100 END AS profit_cagr, profit_slope FROM c""")
def _(t):
    return fd.statement_ratios(quarters(t).select("symbol", "period_end", (F.col("value") - 100).alias("profit"), "cash"))


@query("E47_pe_bands_asof", uses="bars_s", doubles="pe p25 p50 p75", sql="""
, a AS (SELECT symbol, date, close / n AS pe FROM bars_s WHERE n > 1), q AS (SELECT x.symbol, x.date, x.pe, count(*) AS n, quantile_cont(y.pe, 0.25) AS p25, quantile_cont(y.pe, 0.5) AS p50, quantile_cont(y.pe, 0.75) AS p75 FROM a x JOIN a y ON y.symbol = x.symbol AND y.date BETWEEN x.date - 1095 AND x.date GROUP BY 1, 2, 3)
SELECT symbol, date, pe, CASE WHEN n >= 12 THEN p25 END AS p25, CASE WHEN n >= 12 THEN p50 END AS p50, CASE WHEN n >= 12 THEN p75 END AS p75, CASE WHEN n >= 12 THEN CASE WHEN pe <= p25 THEN 'CHEAP' WHEN pe >= p75 THEN 'DEAR' ELSE 'FAIR' END END AS band FROM q""")
def _(t):
    return fd.pe_bands(t.bars_s.select("symbol", "date", F.when(F.col("n") > 1, F.col("close") / F.col("n")).alias("pe")))


@query("E49_early_mover_features", uses="bars_w trades", doubles="gap_pct imbalance spike score", sql=f"""
, b AS (SELECT symbol, date, 100 * (open / {prev('close')} - 1) AS gap, (high - close) / nullif(high - low, 0) AS imb, {prev('date')} AS pd, n / volume AS dp FROM bars_w), s AS (SELECT symbol, date, dp / avg(dp) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS spike FROM b),
f AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS date, count(*) AS n FROM trades WHERE qty = 50 GROUP BY 1, 2)
SELECT b.symbol, b.date, gap AS gap_pct, imb AS imbalance, pd AS prior_date, spike, coalesce(f.n, 0) AS announcements, least(100, CASE WHEN gap IS NULL THEN 40 ELSE least(abs(gap) * 8, 40) END + CASE WHEN imb > 0.3 THEN 15 ELSE 0 END + CASE WHEN spike >= 1.5 THEN 25 WHEN spike >= 1.2 THEN 12 ELSE 0 END + CASE WHEN f.n > 0 THEN 20 ELSE 0 END) AS score
FROM b LEFT JOIN s ON s.symbol = b.symbol AND s.date = b.pd LEFT JOIN f ON f.symbol = b.symbol AND f.date = b.date WHERE gap IS NOT NULL""")
def _(t):
    pre = t.bars_w.select("symbol", "date", (100 * (F.col("open") / ind.prev("close") - 1)).alias("gap_pct"), F.try_divide(F.col("high") - F.col("close"), F.col("high") - F.col("low")).alias("imbalance"), ind.prev("date").alias("prior_date")).where("gap_pct IS NOT NULL")
    filings = t.trades.where("qty = 50").select("symbol", F.date_trunc("week", "ts").cast("date").alias("known"))
    return fd.early_movers(pre, t.bars_w.select("symbol", "date", (F.col("n") / F.col("volume")).alias("deliv_pct")), filings)


@query("E51_session_cumulative_asof", uses="ticks", doubles="vwap_dev_pct range_position", sql=HOURLY + """
, c AS (SELECT symbol, ts, close, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS v, max(high) OVER w AS h, min(low) OVER w AS l FROM hb WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)), r AS (SELECT event_id, symbol, ts AS run_ts FROM ticks WHERE k >= 50)
SELECT r.event_id, r.symbol, r.run_ts, 100 * (close / v - 1) AS vwap_dev_pct, (close - l) / nullif(h - l, 0) AS range_position FROM r ASOF LEFT JOIN c ON r.symbol = c.symbol AND r.run_ts >= c.ts""")
def _(t):
    runs = t.ticks.where("k >= 50").select("event_id", "symbol", F.col("ts").alias("run_ts"))
    return fd.session_cumulative(hourly(t), runs).withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))
