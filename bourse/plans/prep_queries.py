"""Queries for price preparation, on the wild weekly bars so that the thresholds fire."""

from pyspark.sql import functions as F

from bourse.operators import indicators as ind
from bourse.operators import prep
from bourse.plans.registry import query
from bourse.plans.sqltext import P, prev


def raw_bars(t):
    return t.bars_raw.withColumn("prev_close", ind.prev("close"))


def actions(t):
    """Declared actions: the weeks of each brand's ten-unit first lines."""
    return t.trades.where("qty = 10 and l_linenumber = 1").groupBy("symbol", F.date_trunc("week", "ts").cast("date").alias("ex_date")).agg(
        F.max(F.col("l_discount") * 5 + 0.5).alias("factor"))


RAW = f", rb AS (SELECT *, {prev('close')} AS prev_close FROM bars_raw)"
ACTIONS = """, act AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS ex_date, max(l_discount * 5 + 0.5) AS factor
  FROM trades WHERE qty = 10 AND l_linenumber = 1 GROUP BY 1, 2)"""
DETECT = """
, ratios AS (SELECT DISTINCT r FROM (SELECT CAST(p.x AS DOUBLE) / q.x AS r FROM range(1, 11) p(x), range(1, 11) q(x)
    UNION SELECT CAST(k AS DOUBLE) FROM (VALUES (20), (25), (50), (100), (1000)) v(k) UNION SELECT CAST(1 AS DOUBLE) / k FROM (VALUES (20), (25), (50), (100), (1000)) v(k)) WHERE abs(r - 1) > 0.15),
mv AS (SELECT *, close / prev_close AS raw, CASE WHEN open > 0 THEN open / prev_close ELSE close / prev_close END AS basis
  FROM rb WHERE prev_close > 0 AND close > 0 AND abs(close / prev_close - 1) > 0.15),
near AS (SELECT symbol, date, min(abs(basis - r) / r) AS err, arg_min(r, row(abs(basis - r) / r, r)) AS ratio FROM mv, ratios GROUP BY 1, 2),
dt AS (SELECT m.symbol, m.date, raw, basis, ratio, CASE WHEN prev_close < 5 OR close < 5 THEN 'below_price_floor' WHEN high <= low THEN 'circuit_locked_zero_range'
  WHEN raw < 1 AND high / prev_close > 0.85 THEN 'range_touches_old_basis' WHEN raw >= 1 AND low / prev_close < 1.15 THEN 'range_touches_old_basis'
  WHEN err > 0.025 THEN 'not_a_clean_ratio' END AS reason FROM mv m JOIN near n ON m.symbol = n.symbol AND m.date = n.date),
det AS (SELECT symbol, date, raw, basis, CASE WHEN reason IS NULL THEN ratio END AS factor, reason FROM dt)"""


@query("L1_detect_adjustments", uses="bars_raw", doubles="raw basis factor", sql=RAW + DETECT + "SELECT * FROM det")
def _(t):
    return prep.detect_adjustments(raw_bars(t))


def with_reference_close(t):
    """Monthly bars with an official previous close that disagrees on some dates."""
    shift = F.when(F.col("n") % 5 == 0, F.lit(0.5)).otherwise(1.0)
    return t.bars_m.withColumns({"prev_close": ind.prev("close") * shift, "is_suspect": F.col("n") % 7 == 0})


DERIVE = f"""
, b AS (SELECT symbol, date, close, CASE WHEN n % 5 = 0 THEN 0.5 ELSE 1.0 END * {prev('close')} AS prev_close, n % 7 = 0 AS is_suspect,
   {prev('close')} AS last_close, {prev('n % 7 = 0')} AS last_bad FROM bars_m),
ok AS (SELECT * FROM b WHERE NOT is_suspect AND NOT last_bad AND last_close > 0),
inf AS (SELECT symbol, date AS ex_date, prev_close / last_close AS factor, 'prev_close' AS source FROM ok
  WHERE prev_close > 0 AND abs(prev_close - last_close) > 0.051 AND abs(prev_close / last_close - 1) > 0.002),
decl AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS ex_date, max(0.9 + l_discount) AS factor FROM trades WHERE qty = 10 GROUP BY 1, 2),
obs AS (SELECT ok.symbol, ex_date, factor, 'declared_gap' AS source FROM ok JOIN decl ON ok.symbol = decl.symbol AND ok.date = ex_date
  WHERE close > 0 AND abs(close / last_close / factor - 1) <= 0.2),
fac AS (SELECT * FROM inf UNION ALL SELECT * FROM obs o WHERE NOT EXISTS (SELECT 1 FROM inf i WHERE i.symbol = o.symbol AND i.ex_date = o.ex_date))"""


def derived(t):
    declared = t.trades.where("qty = 10").groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("ex_date")).agg(F.max(0.9 + F.col("l_discount")).alias("factor"))
    return prep.derive_adjustments(with_reference_close(t), declared)


@query("L2_derive_adjustments", uses="trades bars_m", doubles="factor", sql=DERIVE + "SELECT * FROM fac")
def _(t):
    return derived(t)


@query("L3_back_adjust", uses="bars_raw", doubles="log_multiplier log_close log_volume", sql=RAW + DETECT + """
SELECT b.symbol, b.date, coalesce(sum(ln(f.factor)), 0.0) AS log_multiplier, ln(b.close) + coalesce(sum(ln(f.factor)), 0.0) AS log_close,
  ln(b.volume) - coalesce(sum(ln(f.factor)), 0.0) AS log_volume
FROM bars_raw b LEFT JOIN (SELECT symbol, date, factor FROM det WHERE factor IS NOT NULL) f ON f.symbol = b.symbol AND f.date > b.date
GROUP BY b.symbol, b.date, b.close, b.volume""")
def _(t):
    """The wild prices carry many factors, so the adjusted values are compared as logarithms."""
    factors = prep.detect_adjustments(raw_bars(t)).where("factor IS NOT NULL").select("symbol", F.col("date").alias("ex_date"), "factor")
    out = prep.back_adjust(t.bars_raw, factors)
    return out.select("symbol", "date", *[F.log(c).alias(f"log_{c}") for c in ("multiplier", "close", "volume")])


@query("L4_promote_declared_seams", uses="trades bars_raw", doubles="factor", sql=RAW + DETECT + ACTIONS + f"""
, nx AS (SELECT symbol, date, close, lead(close, 1) OVER ({P}) AS c1, lead(close, 2) OVER ({P}) AS c2, lead(close, 3) OVER ({P}) AS c3 FROM bars_raw)
SELECT d.symbol, d.date, d.basis AS factor FROM det d JOIN nx ON d.symbol = nx.symbol AND d.date = nx.date
WHERE reason = 'not_a_clean_ratio' AND abs(basis - 1) > 0.25 AND c2 IS NOT NULL
  AND EXISTS (SELECT 1 FROM act a WHERE a.symbol = d.symbol AND abs(date_diff('day', a.ex_date, d.date)) <= 3)
  AND abs(c1 / close - 1) <= 0.8 AND abs(c2 / close - 1) <= 0.8 AND coalesce(abs(c3 / close - 1) <= 0.8, true)""")
def _(t):
    return prep.promote_declared(prep.detect_adjustments(raw_bars(t)), t.bars_raw, actions(t), band=0.8)


@query("L5_cross_validate_actions", uses="trades bars_raw", doubles="factor", sql=RAW + DETECT + ACTIONS + """
, j AS (SELECT a.symbol, a.ex_date, a.factor, count(d.factor) AS nearby, bool_or(abs(d.factor - a.factor) / a.factor <= 0.025) AS ok FROM act a
  LEFT JOIN det d ON d.symbol = a.symbol AND d.factor IS NOT NULL AND abs(date_diff('day', d.date, a.ex_date)) <= 5 GROUP BY 1, 2, 3)
SELECT symbol, ex_date, factor, nearby, CASE WHEN ok THEN 'CONFIRMED' WHEN nearby > 0 THEN 'DISAGREEMENT' ELSE 'FILLED' END AS status FROM j""")
def _(t):
    factors = prep.detect_adjustments(raw_bars(t)).where("factor IS NOT NULL").select("symbol", F.col("date").alias("ex_date"), "factor")
    return prep.cross_validate_actions(factors, actions(t))


@query("L6_flag_suspect", uses="bars_raw", doubles="close", sql=RAW + """
, m AS (SELECT symbol, date, prev_close, n, CASE WHEN n % 11 = 0 THEN -close ELSE close END AS close, CASE WHEN n % 13 = 0 THEN low * 0.99 ELSE high END AS high, low, open FROM rb)
SELECT symbol, date, close, CASE WHEN close IS NULL OR close <= 0 OR open IS NULL OR open <= 0 THEN 'nonpositive_or_missing_price' WHEN high < low THEN 'high_below_low'
  WHEN close > high * 1.0005 OR close < low * 0.9995 THEN 'close_outside_range' WHEN open > high * 1.0005 OR open < low * 0.9995 THEN 'open_outside_range'
  WHEN prev_close > 0 AND abs(close / prev_close - 1) > 0.6 THEN 'implausible_move' END AS suspect_reason FROM m""")
def _(t):
    spoiled = raw_bars(t).withColumns({
        "close": F.when(F.col("n") % 11 == 0, -F.col("close")).otherwise(F.col("close")),
        "high": F.when(F.col("n") % 13 == 0, F.col("low") * 0.99).otherwise(F.col("high"))})
    return prep.flag_suspect(spoiled).select("symbol", "date", "close", "suspect_reason")


NOT_NEAR = "NOT EXISTS (SELECT 1 FROM act a WHERE a.symbol = b.symbol AND abs(date_diff('day', a.ex_date, b.date)) <= 3)"


@query("L7_flag_bad_prints", uses="trades bars_raw", doubles="close prev_close next_close", sql=ACTIONS + f"""
, b AS (SELECT symbol, date, close, {prev('close')} AS prev_close, lead(close) OVER ({P}) AS next_close FROM bars_raw)
SELECT * FROM b WHERE abs(close - prev_close) / prev_close > 0.35 AND abs(close - next_close) / next_close > 0.35 AND {NOT_NEAR}""")
def _(t):
    return prep.flag_bad_prints(t.bars_raw.select("symbol", "date", "close"), actions(t))


@query("L8_flag_level_shifts", uses="trades bars_raw", doubles="close prev_close", sql=ACTIONS + f"""
, b AS (SELECT symbol, date, close, {prev('close')} AS prev_close FROM bars_raw)
SELECT * FROM b WHERE abs(close - prev_close) / prev_close > 0.75 AND {NOT_NEAR}""")
def _(t):
    return prep.flag_level_shifts(t.bars_raw.select("symbol", "date", "close"), actions(t))


SPOILED = """
, f AS (SELECT *, month(date) = 3 AS shut, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, lag(volume) OVER w AS pv
  FROM bars_s WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s AS (SELECT symbol, date, CASE WHEN month(date) = 7 AND po IS NOT NULL THEN po WHEN shut THEN close ELSE open END AS open, CASE WHEN month(date) = 7 AND po IS NOT NULL THEN ph WHEN shut THEN close ELSE high END AS high,
  CASE WHEN month(date) = 7 AND po IS NOT NULL THEN pl WHEN shut THEN close ELSE low END AS low, CASE WHEN month(date) = 7 AND po IS NOT NULL THEN pc ELSE close END AS close,
  CASE WHEN month(date) = 7 AND po IS NOT NULL THEN pv WHEN shut THEN 0.0 ELSE volume END AS volume FROM f)"""


def spoiled_bars(t):
    """March is shut (flat, no volume) and July repeats the bar before it."""
    cols = ("open", "high", "low", "close", "volume")
    last = {c: ind.prev(c) for c in cols}
    shut, copied = F.month("date") == 3, (F.month("date") == 7) & last["open"].isNotNull()
    flat = {"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "close": F.col("close"), "volume": F.lit(0.0)}
    return t.bars_s.select("symbol", "date", *[F.when(copied, last[c]).when(shut, flat[c]).otherwise(F.col(c)).alias(c) for c in cols])


@query("L9_fabricated_sessions", uses="bars_s", doubles="flat_share copy_share", sql=SPOILED + """
, c AS (SELECT date, coalesce(volume = 0 AND open = high AND high = low AND low = close, false) AS flat,
  coalesce(open = lag(open) OVER w AND high = lag(high) OVER w AND low = lag(low) OVER w AND close = lag(close) OVER w AND volume = lag(volume) OVER w, false) AS cp
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT date, count(*) AS bars, avg(CASE WHEN flat THEN 1.0 ELSE 0 END) AS flat_share, avg(CASE WHEN cp THEN 1.0 ELSE 0 END) AS copy_share FROM c GROUP BY date HAVING count(*) > 50)
SELECT *, CASE WHEN flat_share >= 0.95 THEN 'FLAT' WHEN copy_share >= 0.95 THEN 'COPY' END AS reason FROM g""")
def _(t):
    return prep.fabricated_sessions(spoiled_bars(t))
