"""Queries for labels and outcome grading."""

from pyspark.sql import functions as F

from bourse.operators import calendar, labels
from bourse.operators import indicators as ind
from bourse.plans.measure_queries import fwd_sql
from bourse.plans.registry import query
from bourse.plans.sqltext import P, frame, over, prev, rolled
from bourse.session import written


@query("L10_forward_return_open", uses="bars_s sessions_m", doubles="fwd", sql=fwd_sql(3, "bars_s") + "SELECT symbol, date, fwd, stopped FROM panel")
def _(t):
    return labels.forward_return(t.bars_s, t.sessions_m, 3).select("symbol", "date", "fwd", "stopped")


@query("L10_forward_return_close", uses="bars_s sessions_m", doubles="fwd", sql="""
, g AS (SELECT b.*, s.idx FROM bars_s b JOIN sessions_m s ON b.date = s.date)
SELECT a.symbol, a.date, b.close / a.close - 1 AS fwd FROM g a LEFT JOIN g b ON a.symbol = b.symbol AND b.idx = a.idx + 3""")
def _(t):
    return labels.forward_return(t.bars_s, t.sessions_m, 3, "close").select("symbol", "date", "fwd")


@query("L12_vol_threshold", uses="bars_raw", doubles="threshold", sql=f"""
, r AS (SELECT symbol, date, close, 100 * (close - {prev('close')}) / {prev('close')} AS r FROM bars_raw),
c AS (SELECT symbol, date, close, CASE WHEN abs(r) < 25 THEN r END AS r FROM r)
SELECT symbol, date, CASE WHEN count(close) {frame(21)} >= 10 AND count(r) {frame(20)} >= 5
  THEN least(greatest(stddev_samp(r) {frame(20)} * sqrt(5.0), 0.5), 15.0) ELSE sqrt(5.0) END AS threshold FROM c""")
def _(t):
    return labels.vol_threshold(t.bars_raw, 5).select("symbol", "date", "threshold")


ATR = f"""
, g AS (SELECT b.*, s.idx, CASE WHEN {prev('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {prev('close')}), abs(low - {prev('close')})) END AS tr
  FROM bars_m b JOIN sessions_m s ON b.date = s.date WINDOW w AS (PARTITION BY symbol ORDER BY b.date)),
e AS (SELECT symbol, date AS entry_date, idx, close AS entry, CASE WHEN n % 2 = 1 THEN 'short' ELSE 'long' END AS direction,
  close * CASE WHEN n % 2 = 1 THEN 1.06 ELSE 0.94 END AS stop, close * CASE WHEN n % 2 = 1 THEN 0.97 ELSE 1.03 END AS target,
  CASE WHEN count(tr) {frame(14)} >= 14 THEN avg(tr) {frame(14)} END * 0.08 AS atr FROM g)
""".replace("OVER (PARTITION BY symbol ORDER BY date)", "OVER w")


# Entries without a later bar: their windows are empty.
NO_BARS = "FROM e WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.symbol = e.symbol AND b.idx BETWEEN e.idx + 1 AND e.idx + 5)"


def trades(t, horizon: int = 5):
    """One trade per monthly bar: long or short by print count, levels around the close."""
    bars = written(ind.atr(calendar.session_index(t.bars_m, t.sessions_m)), "trade-bars")  # read as entries and as paths
    short = F.col("n") % 2 == 1
    entries = bars.select(
        "symbol", F.col("date").alias("entry_date"), "idx", F.col("close").alias("entry"),
        F.when(short, "short").otherwise("long").alias("direction"),
        (F.col("close") * F.when(short, 1.06).otherwise(0.94)).alias("stop"),
        (F.col("close") * F.when(short, 0.97).otherwise(1.03)).alias("target"), (F.col("atr") * 0.08).alias("atr"))
    return labels.holding_windows(entries, bars, horizon)


@query("L13_exit_path", uses="bars_m sessions_m", doubles="exit_price gross_pct mfe_pct mae_pct", sql=ATR.replace(", g AS", ", RECURSIVE g AS", 1).replace(", RECURSIVE g", ", g") + """
, p AS (SELECT e.*, b.date AS d, b.high AS h, b.low AS l, b.close AS c, row_number() OVER (PARTITION BY e.symbol, e.idx ORDER BY b.idx) AS k,
  count(*) OVER (PARTITION BY e.symbol, e.idx) AS bars, CASE WHEN direction = 'short' THEN -1 ELSE 1 END AS sg
  FROM e JOIN g b ON b.symbol = e.symbol AND b.idx BETWEEN e.idx + 1 AND e.idx + 5),
s1 AS (SELECT *, max(sg * CASE WHEN sg = 1 THEN h ELSE l END) OVER (PARTITION BY symbol, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM p),
s2 AS (SELECT *, sg * greatest(coalesce(best_before, sg * entry), sg * entry) AS anchor FROM s1),
s3 AS (SELECT *, CASE WHEN atr > 0 THEN sg * greatest(sg * stop, sg * (anchor - sg * 3.0 * atr)) ELSE stop END AS eff FROM s2),
s4 AS (SELECT *, sg * CASE WHEN sg = 1 THEN l ELSE h END <= sg * eff AS hit, sg * CASE WHEN sg = 1 THEN h ELSE l END >= sg * target AS reach FROM s3),
s5 AS (SELECT *, min(CASE WHEN hit THEN k END) OVER (PARTITION BY symbol, idx) AS hk FROM s4),
f AS (SELECT symbol, idx, entry_date, entry, direction, stop, target, atr, any_value(sg) AS sg, any_value(hk) AS hk, bool_or(reach AND (hk IS NULL OR k < hk)) AS partial,
  arg_max(d, k) FILTER (WHERE hk IS NULL OR k <= hk) AS exit_date, max(eff) FILTER (WHERE k = hk) AS eff, arg_max(c, k) AS lastc,
  max(sg * (CASE WHEN sg = 1 THEN h ELSE l END)) FILTER (WHERE hk IS NULL OR k <= hk) AS best, min(sg * (CASE WHEN sg = 1 THEN l ELSE h END)) FILTER (WHERE hk IS NULL OR k <= hk) AS worst
  FROM s5 GROUP BY ALL),
x AS (SELECT *, CASE WHEN hk IS NULL THEN lastc ELSE eff END AS px FROM (SELECT * FROM f))
SELECT symbol, entry_date, direction, CASE WHEN hk IS NULL THEN CASE WHEN partial THEN 'TIME_EXIT_PARTIAL' ELSE 'TIME_EXIT' END WHEN eff = stop THEN 'STOP_LOSS' ELSE 'TRAILING_STOP' END AS exit_reason,
  exit_date, px AS exit_price, CASE WHEN partial THEN 0.5 * sg * (target - entry) / entry * 100 + 0.5 * sg * (px - entry) / entry * 100 ELSE sg * (px - entry) / entry * 100 END AS gross_pct,
  greatest(best - sg * entry, 0) / entry * 100 AS mfe_pct, least(worst - sg * entry, 0) / entry * 100 AS mae_pct FROM x
UNION ALL SELECT symbol, entry_date, direction, 'PENDING', NULL, NULL, NULL, NULL, NULL """ + NO_BARS)
def _(t):
    return labels.exit_path(trades(t)).select("symbol", "entry_date", "direction", "exit_reason", "exit_date", "exit_price", "gross_pct", "mfe_pct", "mae_pct")


PATH = ATR + """
, p AS (SELECT e.*, b.date AS d, b.open AS o, b.high AS h, b.low AS l, b.close AS c, row_number() OVER (PARTITION BY e.symbol, e.idx ORDER BY b.idx) AS k,
  count(*) OVER (PARTITION BY e.symbol, e.idx) AS bars FROM e JOIN g b ON b.symbol = e.symbol AND b.idx BETWEEN e.idx + 1 AND e.idx + 5)"""


@query("L14_swing_close", uses="bars_m sessions_m", doubles="exit_price", sql=PATH + """
, q AS (SELECT *, CASE WHEN direction = 'long' THEN l <= stop ELSE h >= stop END AS st, CASE WHEN direction = 'long' THEN h >= target ELSE l <= target END AS tg FROM p),
f AS (SELECT symbol, entry_date, direction, any_value(bars) AS bars, min(CASE WHEN st OR tg THEN k END) AS k1, arg_max(d, k) AS ld, arg_max(c, k) AS lc FROM q GROUP BY 1, 2, 3)
SELECT f.symbol, f.entry_date, f.direction,
  CASE WHEN k1 IS NULL THEN CASE WHEN f.bars >= 5 THEN 'EXPIRED' ELSE 'OPEN' END WHEN st THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k1 IS NULL THEN CASE WHEN f.bars >= 5 THEN 'TIME_EXIT' END WHEN st THEN 'STOP' ELSE 'TARGET' END AS exit_reason,
  CASE WHEN k1 IS NULL THEN CASE WHEN f.bars >= 5 THEN ld END ELSE d END AS exit_date,
  CASE WHEN k1 IS NULL THEN CASE WHEN f.bars >= 5 THEN lc END
    WHEN st THEN CASE WHEN f.direction = 'long' THEN least(o, stop) ELSE greatest(o, stop) END
    ELSE CASE WHEN f.direction = 'long' THEN greatest(o, target) ELSE least(o, target) END END AS exit_price
FROM f LEFT JOIN q ON q.symbol = f.symbol AND q.entry_date = f.entry_date AND q.k = f.k1
UNION ALL SELECT symbol, entry_date, direction, 'OPEN', NULL, NULL, NULL """ + NO_BARS)
def _(t):
    return labels.first_touch(trades(t), 5).select("symbol", "entry_date", "direction", "status", "exit_reason", "exit_date", "exit_price")


@query("L15_intraday_paper_trade", uses="ticks", doubles="exit_price pnl_pct", sql="""
, b AS (SELECT symbol, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hh, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close FROM ticks GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY hh) AS k FROM b),
e AS (SELECT symbol, day, open AS entry, CASE WHEN day(day) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN day(day) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM n WHERE k = 1),
q AS (SELECT n.*, entry, direction, sg, entry * (1 - sg * 0.6) AS stop, entry * (1 + sg * 0.9) AS target FROM n JOIN e ON n.symbol = e.symbol AND n.day = e.day),
r AS (SELECT *, CASE WHEN sg = 1 THEN low <= stop ELSE high >= stop END AS st, CASE WHEN sg = 1 THEN high >= target ELSE low <= target END AS tg FROM q),
f AS (SELECT symbol, day, direction, any_value(entry) AS entry, any_value(sg) AS sg, any_value(stop) AS stop, any_value(target) AS target, min(CASE WHEN k > 1 AND (st OR tg) THEN k END) AS k1, arg_max(close, k) AS lc FROM r GROUP BY 1, 2, 3),
x AS (SELECT f.*, CASE WHEN k1 IS NULL THEN 'CLOSE' WHEN r.st THEN 'STOP' ELSE 'TARGET' END AS exit_reason, CASE WHEN k1 IS NULL THEN lc WHEN r.st THEN f.stop ELSE f.target END AS exit_price
  FROM f LEFT JOIN r ON r.symbol = f.symbol AND r.day = f.day AND r.k = f.k1),
y AS (SELECT symbol, day, direction, exit_reason, exit_price, sg * (exit_price - entry * (1 + sg * 0.001)) / (entry * (1 + sg * 0.001)) * 100 - 0.4 AS pnl_pct FROM x)
SELECT *, CASE WHEN pnl_pct > 0.2 THEN 'WIN' WHEN pnl_pct < -0.2 THEN 'LOSS' ELSE 'NEUTRAL' END AS outcome FROM y""")
def _(t):
    hourly = t.ticks.groupBy("symbol", F.col("ts").cast("date").alias("day"), F.date_trunc("hour", "ts").alias("at")).agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"))
    day = hourly.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(F.struct("at", "open", "high", "low", "close"))).alias("bars"))
    sign = F.when(F.dayofmonth("day") % 2 == 0, 1).otherwise(-1)
    entries = day.withColumns({"entry": F.col("bars")[0]["open"], "direction": F.when(sign > 0, "LONG").otherwise("SHORT")})
    entries = entries.withColumns({"stop": F.col("entry") * (1 - sign * 0.6), "target": F.col("entry") * (1 + sign * 0.9)})
    return labels.same_day_trade(entries).select("symbol", "day", "direction", "exit_reason", "exit_price", "pnl_pct", "outcome")


EXC = PATH + """
, q AS (SELECT *, least(greatest(100 * (h - entry) / entry, -50), 50) AS up, least(greatest(100 * (l - entry) / entry, -50), 50) AS dn,
   greatest(entry, coalesce(max(h) OVER (PARTITION BY symbol, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) - 3.0 * atr AS tstop FROM p),
m AS (SELECT symbol, entry_date, entry, atr, greatest(max(up), 0) AS mfe, least(min(dn), 0) AS mae, least(greatest(100 * (arg_max(c, k) - entry) / entry, -50), 50) AS hc,
   min(CASE WHEN atr > 0 AND l <= tstop THEN k END) AS tk FROM q GROUP BY 1, 2, 3, 4),
exc AS (SELECT m.symbol, m.entry_date, mfe AS mfe_pct, mae AS mae_pct, coalesce(min(CASE WHEN mfe > 0 AND up = mfe THEN k END), 0) AS days_to_mfe, coalesce(min(CASE WHEN mae < 0 AND dn = mae THEN k END), 0) AS days_to_mae,
   hc AS horizon_close_pct, any_value(tk) AS trail_exit_day, coalesce(max(CASE WHEN k = tk THEN 100 * (least(tstop, h) - m.entry) / m.entry END), hc) AS trail_exit_pct,
   CASE WHEN m.atr > 0 THEN 100 * m.atr / m.entry ELSE 0.0 END AS atr_pct FROM m JOIN q ON q.symbol = m.symbol AND q.entry_date = m.entry_date GROUP BY m.symbol, m.entry_date, mfe, mae, hc, m.atr, m.entry
   UNION ALL SELECT symbol, entry_date, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN atr > 0 THEN 100 * atr / entry ELSE 0.0 END """ + NO_BARS + ")"


@query("L16_excursions", uses="bars_m sessions_m", doubles="mfe_pct mae_pct horizon_close_pct trail_exit_pct atr_pct", sql=EXC + """
SELECT *, days_to_mfe > 0 AND (days_to_mae = 0 OR days_to_mfe <= days_to_mae) AS mfe_first FROM exc""")
def _(t):
    return labels.excursions(trades(t)).select("symbol", "entry_date", "mfe_pct", "mae_pct", "days_to_mfe", "days_to_mae", "mfe_first", "horizon_close_pct", "trail_exit_day", "trail_exit_pct", "atr_pct")


@query("L17_triple_barrier", uses="bars_m sessions_m", sql=EXC + """
, v AS (SELECT *, CASE WHEN horizon_close_pct > 0 THEN 0.25 ELSE 0.75 END AS t, days_to_mfe > 0 AND (days_to_mae = 0 OR days_to_mfe <= days_to_mae) AS first FROM exc),
w AS (SELECT *, atr_pct > 0 AND mfe_pct >= (1.0 + t) * atr_pct AS hu, atr_pct > 0 AND mae_pct <= -(0.5 + 0.5 * t) * atr_pct AS hd, CASE WHEN atr_pct > 0 THEN (0.1 + 0.1 * t) * atr_pct ELSE 0.4 END AS cost FROM v)
SELECT symbol, entry_date, CASE WHEN horizon_close_pct IS NULL THEN NULL WHEN hu AND hd THEN CASE WHEN first THEN 1 ELSE 0 END WHEN hu THEN 1 WHEN hd THEN 0 WHEN abs(horizon_close_pct) < cost THEN NULL WHEN horizon_close_pct > cost THEN 1 ELSE 0 END AS tb_label FROM w""")
def _(t):
    exc = labels.excursions(trades(t)).withColumn("vol_rank", F.when(F.col("horizon_close_pct") > 0, 0.25).otherwise(0.75))
    return labels.triple_barrier(exc).select("symbol", "entry_date", "tb_label")


@query("L18_vol_rank", uses="bars_w", doubles="atr vol_rank", sql=f"""
, a AS (SELECT symbol, date, CASE WHEN {prev('close')} IS NOT NULL THEN greatest(high - low, abs(high - {prev('close')}), abs(low - {prev('close')})) END AS tr, row_number() {over()} AS no FROM bars_w),
b AS (SELECT symbol, date, no, {rolled('avg(tr)', 'tr', 14)} AS atr FROM a)
SELECT x.symbol, x.date, x.atr, CASE WHEN x.atr IS NOT NULL AND count(y.atr) > 0 THEN sum(CASE WHEN y.atr <= x.atr THEN 1.0 ELSE 0.0 END) FILTER (WHERE y.atr IS NOT NULL) / count(y.atr) ELSE 0.5 END AS vol_rank
FROM b x LEFT JOIN b y ON x.symbol = y.symbol AND y.no BETWEEN x.no - 19 AND x.no - 1 GROUP BY 1, 2, 3""")
def _(t):
    return labels.vol_rank(t.bars_w).select("symbol", "date", "atr", "vol_rank")


@query("L19_trend_scan")
def _(t):
    """A nested scan; the tests compare it with a plain loop."""
    return labels.trend_scan(t.bars_w).select("symbol", "date", "trend_label")


@query("L20_forward_max_label", uses="bars_w", doubles="fwd_max", sql=f"""
, a AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS m, lead(close, 5) OVER ({P}) AS f FROM bars_w)
SELECT symbol, date, CASE WHEN f IS NOT NULL THEN m / close - 1 END AS fwd_max, CASE WHEN f IS NOT NULL THEN CASE WHEN m / close - 1 >= 0.02 THEN 1 ELSE 0 END END AS label FROM a""")
def _(t):
    return labels.forward_max_label(t.bars_w, 5, 0.02).select("symbol", "date", "fwd_max", "label")


@query("L21_movement_label", uses="bars_s", doubles="range_pct lag_range_pct", sql=f"""
, a AS (SELECT *, 100 * (high - low) / {prev('close')} AS r, {rolled('avg(close * volume)', 'close', 20)} AS t FROM bars_s),
b AS (SELECT *, lag(r) OVER ({P}) AS lr FROM a), c AS (SELECT * FROM b WHERE close >= 20 AND t >= 0 AND r IS NOT NULL)
SELECT symbol, date, r AS range_pct, lr AS lag_range_pct, CASE WHEN (rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0) / count(*) OVER (PARTITION BY date) >= 0.9 THEN 1 ELSE 0 END AS moved FROM c""")
def _(t):
    return labels.movement_label(t.bars_s).select("symbol", "date", "range_pct", "lag_range_pct", "moved")


@query("L22_average_uniqueness", uses="bars_s sessions_m", doubles="uniqueness", sql="""
, e AS (SELECT symbol, b.date, idx FROM bars_s b JOIN sessions_m s ON b.date = s.date),
d AS (SELECT e.symbol, e.idx, e.idx + k AS day FROM e, range(0, 4) r(k)), c AS (SELECT day, count(*) AS c FROM d GROUP BY day)
SELECT e.symbol, e.date, avg(1.0 / c) AS uniqueness FROM e JOIN d ON d.symbol = e.symbol AND d.idx = e.idx JOIN c ON c.day = d.day GROUP BY 1, 2""")
def _(t):
    entries = calendar.session_index(t.bars_s.select("symbol", "date"), t.sessions_m)
    return labels.average_uniqueness(entries, t.sessions_m, 4).select("symbol", "date", "uniqueness")


@query("L23_sample_weights", uses="bars_s", doubles="w_asymmetric w_date w_recency", sql="""
SELECT symbol, date, CASE WHEN n % 3 = 1 THEN 1.0 ELSE 2.0 END AS w_asymmetric, 1.0 / count(*) OVER (PARTITION BY date) AS w_date,
  pow(0.5, date_diff('day', date, max(date) OVER ()) / 365.0) AS w_recency FROM bars_s""")
def _(t):
    return labels.sample_weights(t.bars_s.select("symbol", "date", (F.col("n") % 3).alias("y")), "y", 365.0).drop("y")


FOLDS = """
, n AS (SELECT max(idx) AS n FROM sessions_m), k AS (SELECT CAST(f AS INTEGER) AS fold, n FROM range(0, 4) r(f), n),
b AS (SELECT fold, 33 + CAST(round_even((n - 33) * fold / 4.0, 0) AS BIGINT) + 1 AS test_from, 33 + CAST(round_even((n - 33) * (fold + 1) / 4.0, 0) AS BIGINT) AS test_to FROM k)"""


@query("L24_walk_forward_folds", uses="sessions_m", sql=FOLDS + "SELECT *, test_from - 1 - 2 AS train_to FROM b")
def _(t):
    return labels.walk_forward_folds(t.sessions_m, 4, 2, 30)


@query("L24_fold_rows", uses="bars_m sessions_m", sql=FOLDS + """
, e AS (SELECT symbol, b.date, idx FROM bars_m b JOIN sessions_m s ON b.date = s.date)
SELECT fold, CASE WHEN idx >= test_from THEN 'TEST' ELSE 'TRAIN' END AS part, count(*) AS n, min(e.date) AS first_date, max(e.date) AS last_date
FROM e JOIN b ON idx BETWEEN test_from AND test_to OR idx <= test_from - 3 GROUP BY 1, 2""")
def _(t):
    rows = calendar.session_index(t.bars_m.select("symbol", "date"), t.sessions_m)
    return labels.fold_rows(rows, labels.walk_forward_folds(t.sessions_m, 4, 2, 30)).groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("L25_embargo_split", uses="bars_m sessions_m", sql="""
, m AS (SELECT max(idx) - greatest(1, CAST(floor(max(idx) * 0.2) AS BIGINT)) AS cut FROM sessions_m)
SELECT symbol, b.date, idx, CASE WHEN idx > cut THEN 'TEST' WHEN idx > cut - 5 THEN 'EMBARGO' ELSE 'TRAIN' END AS part FROM bars_m b JOIN sessions_m s ON b.date = s.date, m""")
def _(t):
    return labels.embargo_split(calendar.session_index(t.bars_m.select("symbol", "date"), t.sessions_m), t.sessions_m, 0.2, 5)


@query("L29_resolve_outcomes", uses="bars_s sessions_m", doubles="fwd_w excess", sql=fwd_sql(1, "bars_s").replace("panel AS", "p1 AS") + fwd_sql(3, "bars_s").replace("g AS", "g3 AS").replace("panel AS", "p3 AS").replace(" g ", " g3 ") + """
, u AS (SELECT symbol, date, idx, 1 AS horizon, fwd, stopped FROM p1 UNION ALL SELECT symbol, date, idx, 3, fwd, stopped FROM p3),
i AS (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY fwd NULLS LAST) - 1 AS i, count(fwd) OVER (PARTITION BY date, horizon) AS n FROM u),
c AS (SELECT *, CASE WHEN n < 5 THEN fwd ELSE least(greatest(fwd, max(CASE WHEN i = ceil(0.01 * (n - 1)) THEN fwd END) OVER d), max(CASE WHEN i = floor(0.99 * (n - 1)) THEN fwd END) OVER d) END AS fw
  FROM i WINDOW d AS (PARTITION BY date, horizon))
SELECT symbol, date, horizon, CASE WHEN fwd IS NOT NULL THEN fw END AS fwd_w, CASE WHEN fwd IS NOT NULL THEN fw END - avg(CASE WHEN fwd IS NOT NULL THEN fw END) OVER (PARTITION BY date, horizon) AS excess, stopped,
  CASE WHEN idx + 1 + horizon > (SELECT max(idx) FROM sessions_m) THEN 'PENDING' WHEN fwd IS NULL THEN 'UNGRADEABLE' WHEN stopped THEN 'STOPPED_TRADING' ELSE 'HORIZON' END AS status FROM c""")
def _(t):
    return labels.resolve_outcomes(t.bars_s.select("symbol", "date"), t.bars_s.select("symbol", "date", "open", "close"), t.sessions_m, [1, 3])


@query("L30_target_replay", uses="bars_m", doubles="multiple target_pct stop_pct net", sql="""
, t AS (SELECT CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS sg, open AS e, high, low, close FROM bars_m),
m AS (SELECT *, e * (1 - sg * 0.05) AS s, e * (1 + sg * 0.04 * mult) AS tg FROM t, (VALUES (0.5), (1.0), (1.5)) v(mult)),
k AS (SELECT *, CASE WHEN CASE WHEN sg = 1 THEN low <= s ELSE high >= s END THEN 'STOP' WHEN CASE WHEN sg = 1 THEN high >= tg ELSE low <= tg END THEN 'TARGET' ELSE 'CLOSE' END AS kind FROM m)
SELECT CASE WHEN sg = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, mult AS multiple, count(*) AS n, 100 * avg(CASE WHEN kind = 'TARGET' THEN 1.0 ELSE 0 END) AS target_pct,
  100 * avg(CASE WHEN kind = 'STOP' THEN 1.0 ELSE 0 END) AS stop_pct, avg(sg * (CASE kind WHEN 'STOP' THEN s WHEN 'TARGET' THEN tg ELSE close END - e) / e * 100 - 0.2) AS net FROM k GROUP BY 1, 2""")
def _(t):
    long = F.col("n") % 2 == 0
    sign = F.when(long, 1.0).otherwise(-1.0)
    rows = t.bars_m.select(F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.col("open").alias("entry"), "high", "low", "close",
                           (F.col("open") * (1 - sign * 0.05)).alias("stop"), (F.col("open") * (1 + sign * 0.04)).alias("target"))
    return labels.target_replay(rows, [0.5, 1.0, 1.5], 0.2)


@query("L31_resolve_appearances", uses="trades bars_w", doubles="entry_price entry_close return_same return_1 return_5", sql=f"""
, a AS (SELECT symbol, CAST(ts AS DATE) AS appeared, avg(price) AS entry_price FROM trades WHERE qty > 48 GROUP BY 1, 2),
p AS (SELECT symbol, date, close, lead(close, 1) OVER ({P}) AS c1, lead(close, 5) OVER ({P}) AS c5 FROM bars_w)
SELECT a.symbol, appeared, entry_price, close AS entry_close, CASE WHEN date = appeared THEN 100 * (close / entry_price - 1) END AS return_same,
  100 * (c1 / close - 1) AS return_1, 100 * (c5 / close - 1) AS return_5 FROM a ASOF LEFT JOIN p ON a.symbol = p.symbol AND a.appeared <= p.date""")
def _(t):
    seen = t.trades.where("qty > 48").groupBy("symbol", F.col("ts").cast("date").alias("appeared")).agg(F.avg("price").alias("entry_price"))
    return labels.resolve_appearances(seen, t.bars_w)
