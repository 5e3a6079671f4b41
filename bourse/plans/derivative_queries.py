"""Queries for chains, futures, recursive indicators and chart signals."""

from pyspark.sql import functions as F

from bourse.functions.frames import ratio
from bourse.operators import calendar, derivatives as dv
from bourse.operators import indicators as ind
from bourse.operators.recurrences import recurrences
from bourse.operators.signals import signal_score, technical_signals
from bourse.plans.registry import query
from bourse.plans.sqltext import P, over, prev, rolled


@query("D1_max_pain", uses="chain", doubles="max_pain least_payout", sql="""
, p AS (SELECT a.symbol, a.expiry, a.strike, round(sum(CASE WHEN a.strike > b.strike THEN b.ce_oi * (a.strike - b.strike) ELSE 0 END + CASE WHEN a.strike < b.strike THEN b.pe_oi * (b.strike - a.strike) ELSE 0 END), 4) AS pain
  FROM chain a JOIN chain b ON a.symbol = b.symbol AND a.expiry = b.expiry GROUP BY 1, 2, 3)
SELECT symbol, expiry, arg_min(strike, row(pain, strike)) AS max_pain, min(pain) AS least_payout FROM p GROUP BY 1, 2""")
def _(t):
    return dv.max_pain(t.chain)


@query("D2_put_call_ratios", uses="chain", doubles="pcr_oi pcr_vol", sql="SELECT symbol, expiry, sum(pe_oi) / nullif(sum(ce_oi), 0) AS pcr_oi, sum(pe_vol) / nullif(sum(ce_vol), 0) AS pcr_vol FROM chain GROUP BY 1, 2")
def _(t):
    return dv.put_call_ratios(t.chain)


@query("D3_option_walls", uses="chain spot", doubles="call_wall_pct put_wall_pct", sql="""
, w AS (SELECT symbol, expiry, CASE WHEN max(ce_oi) > 0 THEN arg_min(strike, row(-ce_oi, strike)) END AS c, CASE WHEN max(pe_oi) > 0 THEN arg_min(strike, row(-pe_oi, strike)) END AS p FROM chain GROUP BY 1, 2)
SELECT w.symbol, w.expiry, 100 * (c / spot - 1) AS call_wall_pct, 100 * (1 - p / spot) AS put_wall_pct, date_diff('day', DATE '2000-01-01', w.expiry) <= 7 AS near_expiry FROM w JOIN spot s ON w.symbol = s.symbol AND w.expiry = s.expiry""")
def _(t):
    return dv.option_walls(t.chain, t.spot, F.to_date(F.lit("2000-01-01")))


@query("D4_atm_iv_skew", uses="chain spot", doubles="atm_iv iv_skew", sql="""
, r AS (SELECT c.*, spot FROM chain c JOIN spot s ON c.symbol = s.symbol AND c.expiry = s.expiry WHERE ce_iv IS NOT NULL OR pe_iv IS NOT NULL),
k AS (SELECT symbol, expiry, arg_min(strike, row(round(abs(strike - spot), 9), strike)) AS a, arg_min(strike, row(round(abs(strike - spot * 0.95), 9), strike)) AS p, arg_min(strike, row(round(abs(strike - spot * 1.05), 9), strike)) AS c FROM r GROUP BY 1, 2)
SELECT k.symbol, k.expiry, CASE WHEN x.ce_iv IS NOT NULL AND x.pe_iv IS NOT NULL THEN (x.ce_iv + x.pe_iv) / 2 ELSE coalesce(x.ce_iv, x.pe_iv) END AS atm_iv, y.pe_iv - z.ce_iv AS iv_skew
FROM k JOIN r x ON x.symbol = k.symbol AND x.expiry = k.expiry AND x.strike = k.a JOIN r y ON y.symbol = k.symbol AND y.expiry = k.expiry AND y.strike = k.p JOIN r z ON z.symbol = k.symbol AND z.expiry = k.expiry AND z.strike = k.c""")
def _(t):
    return dv.atm_iv_skew(t.chain, t.spot)


@query("D5_expected_move_gex", uses="chain spot", doubles="expected_move_pct gex", sql="""
, r AS (SELECT c.*, ce_vol + 0.5 AS ce_price, pe_vol + 0.25 AS pe_price, spot FROM chain c JOIN spot s ON c.symbol = s.symbol AND c.expiry = s.expiry)
SELECT symbol, expiry, 100 * arg_min(ce_price + pe_price, row(round(abs(strike - spot), 9), strike)) / any_value(spot) AS expected_move_pct,
  (coalesce(sum(pe_oi) FILTER (WHERE abs(strike / spot - 1) <= 0.05), 0) - coalesce(sum(ce_oi) FILTER (WHERE abs(strike / spot - 1) <= 0.05), 0)) / nullif(coalesce(sum(pe_oi) FILTER (WHERE abs(strike / spot - 1) <= 0.05), 0) + coalesce(sum(ce_oi) FILTER (WHERE abs(strike / spot - 1) <= 0.05), 0), 0) AS gex FROM r GROUP BY 1, 2""")
def _(t):
    return dv.expected_move_gex(t.chain.withColumns({"ce_price": F.col("ce_vol") + 0.5, "pe_price": F.col("pe_vol") + 0.25}), t.spot)


FUT = """
, fut AS (SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('month', ts) AS DATE) AS date, last_day(CAST(date_trunc('month', ts) + l_linenumber * INTERVAL 1 MONTH AS DATE)) AS expiry, sum(qty) AS oi, max(price) AS close, avg(price) AS underlying, 25 AS lot FROM trades GROUP BY 1, 2, 3)"""


def futures(t):
    month = F.date_trunc("month", "ts").cast("date")
    return t.trades.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), month.alias("date"), F.last_day(F.add_months(month, F.col("l_linenumber"))).alias("expiry")).agg(
        F.sum("qty").alias("oi"), F.max("price").alias("close"), F.avg("price").alias("underlying"), F.lit(25).alias("lot"))


@query("D6_rollover_carry", uses="trades", doubles="near_oi next_oi rollover_pct carry_pct", sql=FUT + """
, k AS (SELECT *, dense_rank() OVER (PARTITION BY symbol, date ORDER BY expiry) AS k FROM fut)
SELECT a.symbol, a.date, a.oi AS near_oi, b.oi AS next_oi, 100 * b.oi / (a.oi + b.oi) AS rollover_pct, (a.close / a.underlying - 1) * 100 / date_diff('day', a.date, a.expiry) * 365 AS carry_pct
FROM k a JOIN k b ON a.symbol = b.symbol AND a.date = b.date AND a.k = 1 AND b.k = 2""")
def _(t):
    return dv.rollover_carry(futures(t))


@query("D7_futures_features", uses="trades bars_s", doubles="basis_ann oi_chg_5 oi_days", sql=FUT + f"""
, d AS (SELECT symbol, date, arg_min(close, expiry) AS c, arg_min(underlying, expiry) AS u, min(expiry) AS x, sum(oi * lot) AS sh FROM fut GROUP BY 1, 2), a AS (SELECT symbol, date, {rolled('avg(volume)', 'volume', 20, 15)} AS adt FROM bars_s)
SELECT d.symbol, d.date, (c / u - 1) * 365 / greatest(date_diff('day', d.date, x), 1) AS basis_ann, sh / lag(sh, 5) OVER (PARTITION BY d.symbol ORDER BY d.date) - 1 AS oi_chg_5, ln(1 + sh / adt) AS oi_days FROM d LEFT JOIN a ON a.symbol = d.symbol AND a.date = d.date""")
def _(t):
    return dv.futures_features(futures(t), t.bars_s)


@query("D8_option_term_features", uses="trades bars_s", doubles="iv_front iv_rv iv_term iv_chg_5 log_pcr", sql=FUT + f"""
, o AS (SELECT symbol, date, expiry, 0.1 + oi / 1000 AS iv, oi AS co, close AS po, date_diff('day', date, expiry) >= 45 AS live FROM fut), v AS (SELECT symbol, date, {rolled('stddev_samp(r)', 'r', 12, 8)} AS rv FROM (SELECT symbol, date, ln(close / {prev('close')}) AS r FROM bars_s)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY live DESC, expiry) AS k FROM o), g AS (SELECT symbol, date, max(iv) FILTER (WHERE live AND k = 1) AS f, max(iv) FILTER (WHERE live AND k = 2) AS n, ln(sum(po) / sum(co)) AS l FROM k GROUP BY 1, 2)
SELECT g.symbol, g.date, f AS iv_front, f - rv AS iv_rv, n - f AS iv_term, f - lag(f, 5) OVER (PARTITION BY g.symbol ORDER BY g.date) AS iv_chg_5, l AS log_pcr FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.date = g.date""")
def _(t):
    days = futures(t).select("symbol", "date", "expiry", (0.1 + F.col("oi") / 1000).alias("atm_iv"), F.col("oi").alias("call_oi"), F.col("close").alias("put_oi"))
    vol = t.bars_s.withColumn("r", ind.log_change()).select("symbol", "date", ind.roll(F.stddev_samp, "r", ind.per_symbol(), 12, 8).alias("realised"))
    return dv.option_term_features(days, vol, 45)


@query("D9_implied_vol")
def _(t):
    """A numeric inversion; the tests price the result back."""
    rows = t.chain.join(t.spot, ["symbol", "expiry"]).select("symbol", "expiry", "strike", (F.col("spot") * 0.05 + F.col("ce_vol")).alias("price"), F.col("spot").alias("forward"), F.lit(0.25).alias("years"), (F.col("strike") >= F.col("spot")).alias("is_call"))
    return dv.implied_vol(rows)


@query("D10_chain_day_features")
def _(t):
    rows = t.chain.join(t.spot, ["symbol", "expiry"]).withColumns({
        "years": F.lit(0.25), "ce_price": F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0)) + F.col("spot") * 0.04 + F.col("ce_vol") * 0.1, "pe_price": F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0)) + F.col("spot") * 0.04 + F.col("pe_vol") * 0.1})
    return dv.chain_day_features(rows)


@query("D11_participant_positioning", uses="deals sessions_m", doubles="FII_net PRO_net FII_net_chg_5", sql="""
, r AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, CASE WHEN l_linenumber <= 3 THEN 'FII' ELSE 'PRO' END AS p, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) AS l, sum(CASE WHEN side = 'SELL' THEN qty ELSE 0 END) AS s FROM deals WHERE month(date) NOT IN (4, 5, 6, 7, 8) GROUP BY 1, 2),
w AS (SELECT date, max(CASE WHEN p = 'FII' THEN (l - s) / nullif(l + s, 0) END) AS f, max(CASE WHEN p = 'PRO' THEN (l - s) / nullif(l + s, 0) END) AS q FROM r GROUP BY 1),
x AS (SELECT s.date, idx, last_value(f IGNORE NULLS) OVER v AS fn, last_value(q IGNORE NULLS) OVER v AS qn FROM sessions_m s LEFT JOIN w ON s.date = w.date WINDOW v AS (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT date, idx, fn AS FII_net, qn AS PRO_net, fn - lag(fn, 5) OVER (ORDER BY idx) AS FII_net_chg_5 FROM x""")
def _(t):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    rows = t.deals.where("month(date) NOT IN (4, 5, 6, 7, 8)").groupBy(F.date_trunc("month", "date").cast("date").alias("date"), F.when(F.col("l_linenumber") <= 3, "FII").otherwise("PRO").alias("participant")).agg(side("BUY").alias("long_oi"), side("SELL").alias("short_oi"))
    return dv.participant_positioning(rows, t.sessions_m, ["FII", "PRO"])


@query("D12_expiry_clock", uses="sessions_w", sql="""
, a AS (SELECT date, last_day(date) AS e1, last_day(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE)) AS e2, CASE WHEN date >= DATE '2000-01-01' THEN 2 ELSE 4 END AS k1, CASE WHEN date_trunc('month', date) + INTERVAL 1 MONTH >= DATE '2000-01-01' THEN 2 ELSE 4 END AS k2 FROM sessions_w),
b AS (SELECT date, CAST(e1 - CAST((isodow(e1) - k1 + 7) % 7 AS INTEGER) AS DATE) AS x1, CAST(e2 - CAST((isodow(e2) - k2 + 7) % 7 AS INTEGER) AS DATE) AS x2 FROM a)
SELECT date, CASE WHEN x1 >= date THEN x1 ELSE x2 END AS expiry, date_diff('day', date, CASE WHEN x1 >= date THEN x1 ELSE x2 END) AS days_to_expiry FROM b""")
def _(t):
    return dv.expiry_clock(t.sessions_w.select("date"), t.sessions_w, "2000-01-01")


@query("D13_oi_buildup", uses="bars_m chain", sql=f"""
, o AS (SELECT b.symbol, b.date, close, oi FROM bars_m b JOIN (SELECT symbol, expiry, sum(ce_oi) AS oi FROM chain GROUP BY 1, 2) c ON b.symbol = c.symbol AND b.date = c.expiry), d AS (SELECT symbol, date, close - {prev('close')} AS p, oi - {prev('oi')} AS o FROM o)
SELECT symbol, date, CASE WHEN p > 0 AND o > 0 THEN 'LONG_BUILDUP' WHEN p < 0 AND o > 0 THEN 'SHORT_BUILDUP' WHEN p < 0 AND o < 0 THEN 'LONG_UNWINDING' WHEN p > 0 AND o < 0 THEN 'SHORT_COVERING' END AS buildup FROM d""")
def _(t):
    oi = t.chain.groupBy("symbol", F.col("expiry").alias("date")).agg(F.sum("ce_oi").alias("oi"))
    return dv.oi_buildup(t.bars_m.select("symbol", "date", "close").join(oi, ["symbol", "date"])).select("symbol", "date", "buildup")


EMA_SQL = """
, RECURSIVE_B AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS no FROM bars_m),
r AS (WITH RECURSIVE e AS (SELECT symbol, date, no, close AS e8, close AS e12, close AS e26 FROM RECURSIVE_B WHERE no = 1
  UNION ALL SELECT b.symbol, b.date, b.no, b.close * 2 / 9.0 + e8 * 7 / 9.0, b.close * 2 / 13.0 + e12 * 11 / 13.0, b.close * 2 / 27.0 + e26 * 25 / 27.0 FROM e JOIN RECURSIVE_B b ON b.symbol = e.symbol AND b.no = e.no + 1) SELECT * FROM e)"""


@query("E4_ema_macd", uses="bars_m", doubles="ema_8 macd", sql=EMA_SQL + "SELECT symbol, date, e8 AS ema_8, e12 - e26 AS macd FROM r")
def _(t):
    return recurrences(t.bars_m).select("symbol", "date", "ema_8", "macd")


# Bars numbered from 0 with their moves, ranges and directions.
STEPS = """
, k AS (SELECT symbol, date, high, low, close, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS size, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT *, coalesce(greatest(close - pc, 0), 0) AS g, coalesce(greatest(pc - close, 0), 0) AS l, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS dp, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS dm FROM k)"""


def smoothed(name: str, source: str, columns: str, n: int, first: int) -> str:
    """A table of smoothed means: the plain mean of n values from `first`, then one n-th of each new value."""
    cols = columns.split()
    mean = ", ".join(f"avg({c}) AS {c}" for c in cols)
    step = ", ".join(f"r.{c} + (s.{c} - r.{c}) / {n}.0" for c in cols)
    return f"""
, {name} AS (WITH RECURSIVE r AS (SELECT symbol, CAST({first + n - 1} AS BIGINT) AS i, {mean} FROM {source} WHERE i BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT r.symbol, r.i + 1, {step} FROM r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1) SELECT * FROM r)"""


@query("E5_rsi", uses="bars_w", doubles="rsi_wilder rsi_ewm", sql=STEPS + smoothed("wl", "m", "g l", 14, 1) + """
, ew AS (WITH RECURSIVE r AS (SELECT symbol, i, CAST(g AS DOUBLE) AS g, CAST(l AS DOUBLE) AS l FROM m WHERE i = 1 UNION ALL SELECT r.symbol, m.i, m.g + r.g * 13 / 14.0, m.l + r.l * 13 / 14.0 FROM r JOIN m ON m.symbol = r.symbol AND m.i = r.i + 1) SELECT * FROM r)
SELECT m.symbol, m.date, CASE WHEN wl.l = 0 THEN 100 ELSE 100 - 100 / (1 + wl.g / wl.l) END AS rsi_wilder, CASE WHEN m.i >= 14 THEN 100 - 100 / (1 + ew.g / nullif(ew.l, 0)) END AS rsi_ewm
FROM m LEFT JOIN wl USING (symbol, i) LEFT JOIN ew USING (symbol, i)""")
def _(t):
    return recurrences(t.bars_w).select("symbol", "date", "rsi_wilder", "rsi_ewm")


@query("E6_atr_wilder", uses="bars_w", doubles="atr_wilder", sql=STEPS + smoothed("wl", "m", "tr", 14, 1) + "SELECT m.symbol, m.date, wl.tr AS atr_wilder FROM m LEFT JOIN wl USING (symbol, i)")
def _(t):
    return recurrences(t.bars_w).select("symbol", "date", "atr_wilder")


@query("E7_adx", uses="bars_w", doubles="adx di_plus di_minus", sql=STEPS + smoothed("wl", "m", "tr dp dm", 14, 1) + """
, d AS (SELECT m.symbol, m.i, m.date, 100 * wl.dp / nullif(wl.tr, 0) AS p, 100 * wl.dm / nullif(wl.tr, 0) AS q FROM m LEFT JOIN wl USING (symbol, i)),
x AS (SELECT *, CASE WHEN p + q > 0 THEN 100 * abs(p - q) / (p + q) ELSE 0.0 END AS dx FROM d)""" + smoothed("ax", "x", "dx", 14, 14) + "SELECT x.symbol, x.date, ax.dx AS adx, p AS di_plus, q AS di_minus FROM x LEFT JOIN ax USING (symbol, i)")
def _(t):
    return recurrences(t.bars_w).select("symbol", "date", "adx", "di_plus", "di_minus")


@query("E10_supertrend", uses="bars_w", sql=STEPS + smoothed("wl", "m", "tr", 10, 1) + """
, b AS (SELECT m.symbol, m.i, close, pc, (high + low) / 2 + 2.5 * wl.tr AS up, (high + low) / 2 - 2.5 * wl.tr AS dn FROM m JOIN wl USING (symbol, i) WHERE size >= 12),
t AS (WITH RECURSIVE r AS (SELECT symbol, i, up, 0.0::DOUBLE AS dn, close > up AS side FROM b WHERE i = 10 UNION ALL
  SELECT symbol, i, up, dn, CASE WHEN side THEN close >= dn ELSE close > up END FROM (SELECT b.symbol, b.i, b.close, r.side, CASE WHEN pc > r.up THEN b.up ELSE least(r.up, b.up) END AS up, CASE WHEN pc < r.dn THEN b.dn ELSE greatest(r.dn, b.dn) END AS dn FROM r JOIN b ON b.symbol = r.symbol AND b.i = r.i + 1)) SELECT * FROM r)
SELECT m.symbol, m.date, coalesce(side, false) AS supertrend_up FROM m LEFT JOIN t USING (symbol, i)""")
def _(t):
    return recurrences(t.bars_w).select("symbol", "date", "supertrend_up")


@query("E38_technical_signals")
def _(t):
    rows = technical_signals(t.bars_w, blocked=("DISTRIBUTION_DAY",))
    return rows.select("symbol", "date", F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["type"], s["strength"])), ",").alias("signals"))


@query("E39_signal_score", uses="outcomes", doubles="signal_score", sql="""
, s AS (SELECT symbol, date, regime, CASE WHEN prints > 10 THEN -4000 ELSE 0 END AS flow, source AS type, CASE prints % 3 WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 10 END AS pts FROM outcomes UNION ALL SELECT symbol, date, regime, CASE WHEN prints > 10 THEN -4000 ELSE 0 END, 'BB_COMPRESSION', 10 FROM outcomes WHERE prints > 6),
r AS (SELECT source AS type, avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0 END) + CASE source WHEN 'P1' THEN 0.2 ELSE 0.1 END AS wr FROM outcomes WHERE outcome <> 'PENDING' GROUP BY 1)
SELECT symbol, date, sum(pts * CASE WHEN wr >= 0.65 THEN 1.25 WHEN wr >= 0.55 THEN 1 WHEN wr >= 0.45 THEN 0.85 WHEN wr IS NOT NULL THEN 0.7 ELSE 1 END * CASE WHEN s.type = 'BB_COMPRESSION' THEN 0.5 ELSE 1 END * least(greatest(coalesce(CASE s.type WHEN 'P0' THEN 2.5 WHEN 'P1' THEN 0.1 END, 1), 0.3), 2)
  * CASE WHEN regime = 'BEAR' THEN 0.6 WHEN regime = 'SIDEWAYS' THEN 0.8 ELSE 1 END * CASE WHEN flow < -3000 THEN 0.85 ELSE 1 END) AS signal_score, count(*) AS n_signals FROM s LEFT JOIN r ON r.type = s.type GROUP BY 1, 2""")
def _(t):
    strength = F.when(F.col("prints") % 3 == 0, "HIGH").when(F.col("prints") % 3 == 1, "MEDIUM").otherwise("WATCH")
    first = F.struct(F.col("source").alias("type"), strength.alias("strength"))
    squeeze = F.when(F.col("prints") > 6, F.struct(F.lit("BB_COMPRESSION").alias("type"), F.lit("WATCH").alias("strength")))
    rows = t.outcomes.select("symbol", "date", "regime", F.when(F.col("prints") > 10, -4000).otherwise(0).alias("flow_3d"), F.filter(F.array(first, squeeze), lambda s: s.isNotNull()).alias("signals"))
    rates = t.outcomes.where("outcome <> 'PENDING'").groupBy(F.col("source").alias("type")).agg((F.avg((F.col("outcome") == "WIN").cast("double")) + F.when(F.col("source") == "P1", 0.2).otherwise(0.1)).alias("win_rate"))
    weights = t.outcomes.select(F.col("source").alias("type")).distinct().where("type <> 'P2'").withColumn("weight", F.when(F.col("type") == "P0", 2.5).otherwise(0.1))
    return signal_score(rows, rates, weights)
