"""Queries for aggregates over graded outcomes."""

from pyspark.sql import functions as F

from bourse.operators import calendar, outcomes as oc
from bourse.operators import indicators as ind
from bourse.plans.registry import query
from bourse.plans.sqltext import P, frame, prev, rolled

COUNTS = """count(*) AS total, count(*) FILTER (WHERE outcome = 'WIN') AS wins, count(*) FILTER (WHERE outcome = 'LOSS') AS losses,
  count(*) FILTER (WHERE outcome = 'NEUTRAL') AS neutrals, count(*) FILTER (WHERE outcome = 'STOP_LOSS') AS stops,
  100.0 * count(*) FILTER (WHERE outcome = 'WIN') / nullif(count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS', 'STOP_LOSS')), 0) AS win_rate,
  100.0 * count(*) FILTER (WHERE outcome <> 'NEUTRAL') / count(*) AS decisive_rate, avg(return_pct) AS avg_return, max(horizon_days) AS max_horizon"""
DONE = "outcome IN ('WIN', 'LOSS', 'NEUTRAL', 'STOP_LOSS')"


@query("AG1_conditional_counts", uses="outcomes", doubles="win_rate decisive_rate avg_return", sql=f"SELECT source, regime, {COUNTS} FROM outcomes WHERE {DONE} GROUP BY 1, 2")
def _(t):
    return oc.outcome_counts(t.outcomes, ["source", "regime"])


@query("AG2_outcome_grouping_sets", uses="outcomes", doubles="win_rate decisive_rate avg_return", sql=f"""
SELECT * FROM (SELECT source, regime, horizon_days, grouping_id(source, regime, horizon_days) AS level, {COUNTS.replace('max(horizon_days)', 'max(hz)')}
FROM (SELECT *, horizon_days AS hz FROM outcomes) WHERE {DONE} GROUP BY GROUPING SETS ((), (source), (regime), (horizon_days), (source, regime, horizon_days))) WHERE level <> 0 OR total >= 600""")
def _(t):
    return oc.outcome_grouping_sets(t.outcomes, 600)


def metrics_sql(keys: str, table: str = "oc") -> str:
    return f"""
, path AS (SELECT {keys}, date, symbol, sum(ln(1 + least(greatest(return_pct, -95), 95) / 100)) OVER (PARTITION BY {keys} ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS lc FROM {table}),
peak AS (SELECT {keys}, lc - max(lc) OVER (PARTITION BY {keys} ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS dd FROM path),
fall AS (SELECT {keys}, 100 * (exp(min(dd)) - 1) AS max_drawdown_pct FROM peak GROUP BY ALL),
stats AS (SELECT {keys}, count(*) AS total, count(*) FILTER (WHERE outcome = 'WIN') AS wins, count(*) FILTER (WHERE outcome IN ('LOSS', 'STOP_LOSS')) AS losses, count(*) FILTER (WHERE outcome = 'NEUTRAL') AS neutrals,
  avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END) AS win_rate, avg(return_pct) AS avg_return, quantile_cont(return_pct, 0.5) AS median_return,
  coalesce(avg(return_pct) FILTER (WHERE outcome = 'WIN'), 0) AS avg_win, coalesce(avg(return_pct) FILTER (WHERE outcome IN ('LOSS', 'STOP_LOSS')), 0) AS avg_loss,
  coalesce(sum(return_pct) FILTER (WHERE outcome = 'WIN'), 0) / abs(sum(return_pct) FILTER (WHERE outcome IN ('LOSS', 'STOP_LOSS'))) AS profit_factor,
  avg(return_pct) / stddev_samp(return_pct) * sqrt(252 / 15.0) AS sharpe,
  1.0 * count(*) FILTER (WHERE outcome IN ('LOSS', 'STOP_LOSS')) / count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS', 'STOP_LOSS')) AS false_positive_rate FROM {table} GROUP BY ALL)"""


METRICS = "win_rate avg_return median_return avg_win avg_loss profit_factor sharpe false_positive_rate max_drawdown_pct"


@query("AG3_trade_metrics", uses="outcomes", doubles=METRICS, sql=", oc AS (SELECT * FROM outcomes WHERE outcome <> 'PENDING')" + metrics_sql("source, horizon_days") + """
SELECT stats.*, max_drawdown_pct FROM stats JOIN fall ON stats.source = fall.source AND stats.horizon_days = fall.horizon_days""")
def _(t):
    return oc.trade_metrics(t.outcomes.where("outcome <> 'PENDING'"), ["source", "horizon_days"], 15, ["symbol"])


@query("AG4_segment_metrics", uses="outcomes", doubles=METRICS, sql="""
, oc AS (SELECT *, CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.5 THEN 'mid' ELSE 'low' END AS segment FROM outcomes WHERE outcome <> 'PENDING')""" + metrics_sql("segment") + """
, md AS (SELECT segment, regime AS modal_regime, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, regime) AS rn FROM oc GROUP BY segment, regime)
SELECT stats.*, max_drawdown_pct, modal_regime FROM stats JOIN fall ON stats.segment = fall.segment JOIN md ON md.segment = stats.segment AND rn = 1 WHERE total >= 5""")
def _(t):
    segment = F.when(F.col("p") >= 0.9, "high").when(F.col("p") >= 0.5, "mid").otherwise("low")
    return oc.segment_metrics(t.outcomes.where("outcome <> 'PENDING'"), segment, 15, ["symbol"])


@query("AG5_wilson_interval", uses="outcomes", doubles="eff_windows win_ci_lo win_ci_hi", sql=f"""
, a AS (SELECT source, count(*) FILTER (WHERE outcome = 'WIN') AS wins, count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS', 'STOP_LOSS')) AS decided, count(DISTINCT date) AS dates, max(horizon_days) AS max_horizon
  FROM outcomes WHERE {DONE} GROUP BY 1),
b AS (SELECT *, 1.0 * dates / max_horizon AS eff, least(1, 1.0 / max_horizon) AS s FROM a), c AS (SELECT *, CAST(wins AS DOUBLE) / decided AS q, decided * s AS m FROM b)
SELECT source, wins, decided, dates, max_horizon, eff AS eff_windows, eff < 20 AS low_data,
  100 * greatest(0, (q + 3.8416 / (2 * m) - 1.96 * sqrt(q * (1 - q) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m)) AS win_ci_lo,
  100 * least(1, (q + 3.8416 / (2 * m) + 1.96 * sqrt(q * (1 - q) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m)) AS win_ci_hi FROM c""")
def _(t):
    daily = t.outcomes.where(oc.is_(*oc.DECIDED, "NEUTRAL")).groupBy("source", "date").agg(
        F.count_if(oc.is_("WIN")).alias("w"), F.count_if(oc.is_(*oc.DECIDED)).alias("d"), F.max("horizon_days").alias("h"))
    rows = daily.groupBy("source").agg(F.sum("w").alias("wins"), F.sum("d").alias("decided"), F.count("*").alias("dates"), F.max("h").alias("max_horizon"))
    return oc.with_uncertainty(rows)


@query("AG6_bayes_shrunk_rate", uses="outcomes index_m", doubles="win_rate alpha sharpe worst shrunk_rate composite", sql="""
, b AS (SELECT date, 100 * (lead(close) OVER (ORDER BY date) / close - 1) AS bench FROM index_m),
r AS (SELECT o.*, bench, CASE WHEN screener_id IN ('L1', 'L4') THEN -return_pct ELSE return_pct END AS x FROM outcomes o JOIN b ON o.date = b.date WHERE outcome IN ('WIN', 'LOSS', 'NEUTRAL')),
g AS (SELECT avg(wr) AS g FROM (SELECT avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0 END) AS wr FROM r GROUP BY screener_id HAVING count(*) >= 10)),
s AS (SELECT screener_id, count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(x - bench) AS alpha, avg(x) / stddev_samp(x) AS sharpe, min(x) AS worst FROM r GROUP BY 1),
c AS (SELECT s.*, (n * win_rate + 20 * g) / (n + 20) AS shrunk_rate FROM s, g),
d AS (SELECT *, 0.4 * shrunk_rate + 0.3 * least(greatest((coalesce(alpha, 0) + 5) / 15, 0), 1) + 0.2 * least(greatest(sharpe / 3, 0), 1) + 0.1 * (1 - least(abs(worst) / 20, 1)) AS composite FROM c)
SELECT *, CASE WHEN n < 5 THEN 'Unranked' WHEN composite >= 0.7 THEN 'A' WHEN composite >= 0.55 THEN 'B' WHEN composite >= 0.4 THEN 'C' ELSE 'D' END AS tier FROM d""")
def _(t):
    from pyspark.sql import Window
    index = t.index_m.select("date", (100 * (F.lead("close").over(Window.orderBy("date")) / F.col("close") - 1)).alias("benchmark_pct"))
    return oc.bayes_shrunk_rate(t.outcomes.join(index, "date"), "screener_id", 20.0, F.col("screener_id").isin("L1", "L4"))


@query("AG7_bayes_shrunk_rate_pit", uses="outcomes", doubles="shrunk_rate", sql="""
, s AS (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS as_of FROM outcomes),
a AS (SELECT screener_id, as_of, count(*) AS n, count(*) FILTER (WHERE outcome = 'WIN') AS wins FROM outcomes JOIN s ON resolved_on < as_of WHERE outcome IN ('WIN', 'LOSS', 'NEUTRAL') GROUP BY 1, 2)
SELECT *, (wins + 20 * coalesce(avg(CASE WHEN n >= 10 THEN 1.0 * wins / n END) OVER (PARTITION BY as_of), 0.52)) / (n + 20) AS shrunk_rate FROM a""")
def _(t):
    snaps = t.outcomes.select(F.date_trunc("year", "date").cast("date").alias("as_of")).distinct()
    return oc.bayes_shrunk_rate_pit(t.outcomes, "screener_id", snaps, 20.0)


@query("AG8_beta_priors", uses="outcomes", doubles="posterior", sql="""
, e AS (SELECT outcome, unnest([source, regime, screener_id]) AS signal_type FROM outcomes WHERE outcome <> 'PENDING' AND prints % 5 <> 0)
SELECT signal_type, count(*) FILTER (WHERE outcome = 'WIN') AS wins, count(*) AS n, (1.0 + count(*) FILTER (WHERE outcome = 'WIN')) / (2.0 + count(*)) AS posterior FROM e GROUP BY 1""")
def _(t):
    listed = F.concat(F.lit('[{"type":"'), "source", F.lit('"},{"type":"'), "regime", F.lit('"},{"type":"'), "screener_id", F.lit('"}]'))
    rows = t.outcomes.where("outcome <> 'PENDING'").withColumn("signals", F.when(F.col("prints") % 5 == 0, "{broken").otherwise(listed))
    return oc.beta_priors(rows, "signals")


@query("AG9_calibration_bins", uses="preds", doubles="lo predicted realised brier brier_base", sql="""
, t AS (SELECT avg((p - y) * (p - y)) AS brier, avg(y) * (1 - avg(y)) AS brier_base, count(*) AS total FROM preds)
SELECT CAST(least(greatest(floor(p * 10), 0), 9) AS BIGINT) AS bin, least(greatest(floor(p * 10), 0), 9) / 10 AS lo, count(*) AS n, avg(p) AS predicted, avg(y) AS realised, any_value(brier) AS brier, any_value(brier_base) AS brier_base, any_value(total) AS total FROM preds, t GROUP BY 1, 2""")
def _(t):
    return oc.calibration_bins(t.preds, "p", "y")


@query("AG10_decile_table", uses="outcomes", doubles="predicted realised", sql="""
, n AS (SELECT p, return_pct, ntile(10) OVER (ORDER BY p, symbol || date) AS bucket FROM outcomes WHERE outcome <> 'PENDING')
SELECT bucket, count(*) AS n, avg(p) AS predicted, avg(return_pct) AS realised FROM n GROUP BY 1""")
def _(t):
    rows = t.outcomes.where("outcome <> 'PENDING'").withColumn("id", F.concat("symbol", F.col("date").cast("string")))
    return oc.decile_table(rows, "p", "return_pct", "id")


@query("AG11_weighted_roc", uses="outcomes", doubles="auc fpr tpr", sql="""
, f AS (SELECT regime, p, count(*) FILTER (WHERE outcome = 'WIN') AS w, count(*) FILTER (WHERE outcome = 'LOSS') AS l FROM outcomes WHERE outcome IN ('WIN', 'LOSS') GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER d AS tw, sum(l) OVER d AS tl, sum(w + l) OVER (PARTITION BY regime ORDER BY p) - (w + l) AS before, count(*) OVER d AS pts, row_number() OVER (PARTITION BY regime ORDER BY p DESC) AS i,
  sum(w) OVER (PARTITION BY regime ORDER BY p DESC) AS tp, sum(l) OVER (PARTITION BY regime ORDER BY p DESC) AS fp FROM f WINDOW d AS (PARTITION BY regime)),
a AS (SELECT regime, (sum(w * (before + (w + l + 1) / 2.0)) - max(tw) * (max(tw) + 1) / 2.0) / (max(tw) * max(tl)) AS auc FROM c GROUP BY 1)
SELECT c.regime, auc, CAST(tw + tl AS BIGINT) AS n, CAST(fp AS DOUBLE) / tl AS fpr, CAST(tp AS DOUBLE) / tw AS tpr FROM c JOIN a ON c.regime = a.regime
WHERE pts + 1 <= 50 OR round(round(i / (pts / 49.0)) * (pts / 49.0)) = i""")
def _(t):
    return oc.weighted_roc(t.outcomes.where("outcome IN ('WIN', 'LOSS')"), ["regime"], "p", 50)


AUC = """avg(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0.0 END)"""


@query("AG12_auc_rank", uses="preds", doubles="auc", sql=f"""
, n AS (SELECT stratum, count(*) AS n FROM preds GROUP BY 1)
SELECT n.stratum, n.n, avg(CASE WHEN x.p IS NULL OR y.p IS NULL THEN NULL WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0.0 END) AS auc FROM n LEFT JOIN preds x ON x.stratum = n.stratum AND x.y = 1 LEFT JOIN preds y ON y.stratum = n.stratum AND y.y = 0 GROUP BY 1, 2""")
def _(t):
    return oc.auc_by_rank(t.preds, ["stratum"], "p", "y")


@query("AG13_stratified_auc", uses="preds", doubles="auc", sql=f"""
, n AS (SELECT stratum, count(*) AS n FROM preds GROUP BY 1),
a AS (SELECT n.stratum, n.n, {AUC} AS auc FROM n JOIN preds x ON x.stratum = n.stratum AND x.y = 1 JOIN preds y ON y.stratum = n.stratum AND y.y = 0 GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * auc) / sum(n) AS auc, count(*) AS strata FROM a WHERE n >= 60""")
def _(t):
    return oc.stratified_auc(t.preds, "stratum", "p", "y", 60, 50)


@query("AG14_stratified_slope", uses="preds", doubles="slope", sql="""
, a AS (SELECT stratum, count(*) AS n, sum((p - 0.5) * (y - 0.5)) / sum((p - 0.5) * (p - 0.5)) AS slope FROM preds GROUP BY 1 HAVING min(y) <> max(y) AND count(*) >= 60)
SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * slope) / sum(n) AS slope, count(*) AS strata FROM a""")
def _(t):
    return oc.stratified_calibration_slope(t.preds, "stratum", "p", "y", 60, 50)


PSI = """
, l AS (UNPIVOT (SELECT date >= DATE '2000-01-01' AS recent, close, volume, CAST(n AS DOUBLE) AS n FROM bars_s) ON close, volume, n INTO NAME "column" VALUE x),
q AS (SELECT "column", quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM l WHERE NOT recent GROUP BY 1),
b AS (SELECT l."column", recent, len(list_filter(c, lambda z: z <= x)) AS bin FROM l JOIN q ON l."column" = q."column"),
g AS (SELECT "column", k AS bin, count(*) FILTER (WHERE NOT recent AND b.bin = k) AS eb, count(*) FILTER (WHERE recent AND b.bin = k) AS rb, count(*) FILTER (WHERE NOT recent) AS te, count(*) FILTER (WHERE recent) AS tr FROM b, range(0, 10) r(k) GROUP BY 1, 2),
s AS (SELECT "column", greatest(eb / te, 1e-6) AS e, greatest(rb / tr, 1e-6) AS a FROM g),
psi AS (SELECT "column", sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY 1)"""


def _psi(t):
    bars = t.bars_s.withColumn("n", F.col("n").cast("double"))
    return oc.psi(bars.where("date < '2000-01-01'"), bars.where("date >= '2000-01-01'"), ["close", "volume", "n"])


@query("AG15_psi", uses="bars_s", doubles="psi", sql=PSI + "SELECT * FROM psi")
def _(t):
    return _psi(t)


@query("AG15_drift_status", uses="bars_s", doubles="crit_share max_psi avg_psi", sql=PSI + """
SELECT count(*) AS columns, avg(CASE WHEN psi > 3.6 THEN 1.0 ELSE 0 END) AS crit_share, max(psi) AS max_psi, avg(psi) AS avg_psi,
  CASE WHEN avg(CASE WHEN psi > 3.6 THEN 1.0 ELSE 0 END) > 0.2 THEN 'EMERGENCY_RETRAIN' WHEN avg(CASE WHEN psi > 3.6 THEN 1.0 ELSE 0 END) > 0.1 OR avg(psi) > 1.2 THEN 'WARNING' ELSE 'OK' END AS status FROM psi""")
def _(t):
    return oc.drift_status(_psi(t), 3.6, 0.2, 1.2)


@query("AG16_latest_per_key", doubles="o_totalprice", sql="""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return oc.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("AG17_first_last_in_group", uses="ticks", doubles="open high low close", sql="""
, p AS (SELECT *, CASE WHEN k % 10 <> 0 THEN price END AS q FROM ticks)
SELECT symbol, CAST(ts AS DATE) AS day, arg_min(q, event_id) AS open, max(q) AS high, min(q) AS low, arg_max(q, event_id) AS close FROM p WHERE q IS NOT NULL GROUP BY 1, 2""")
def _(t):
    rows = t.ticks.withColumns({"q": F.when(F.col("k") % 10 != 0, F.col("price")), "day": F.col("ts").cast("date")})
    return oc.first_last(rows, ["symbol", "day"], ["event_id"], "q")


@query("AG18_sector_breadth", uses="bars_w sectors", doubles="avg_score", sql=f"""
, a AS (SELECT symbol, date, close, volume, {rolled('avg(close)', 'close', 50)} AS s50, {rolled('avg(close)', 'close', 200)} AS s200 FROM bars_w)
SELECT date, sector, count(*) AS members, count(*) FILTER (WHERE close > s50) AS above_50, count(*) FILTER (WHERE close > s200) AS above_200, avg(volume) AS avg_score FROM a JOIN sectors USING (symbol) GROUP BY 1, 2""")
def _(t):
    rows = ind.moving_averages(t.bars_w, (50, 200)).join(t.sectors, "symbol")
    return rows.groupBy("date", "sector").agg(F.count("*").alias("members"), F.count_if("above_sma_50").alias("above_50"), F.count_if("above_sma_200").alias("above_200"), F.avg("volume").alias("avg_score"))


@query("AG19_sector_rotation", uses="bars_m sectors", doubles="breadth momentum", sql=f"""
, m AS (SELECT symbol, date, CASE WHEN close > open THEN n ELSE 0 END AS bull, CASE WHEN close < open THEN n ELSE 0 END AS bear, CASE WHEN volume > 700 THEN 1 ELSE 0 END AS tier1, volume FROM bars_m),
g AS (SELECT date, sector, CAST(sum(bull) AS BIGINT) AS bull_count, CAST(sum(bear) AS BIGINT) AS bear_count, CAST(sum(bull - bear) AS BIGINT) AS net_score, CAST(sum(tier1) AS BIGINT) AS tier1_count, avg(CASE WHEN bull > bear THEN 1.0 ELSE 0 END) AS breadth, sum(volume) AS momentum
  FROM m JOIN sectors USING (symbol) GROUP BY 1, 2)
SELECT *, net_score - lag(net_score) OVER (PARTITION BY sector ORDER BY date) AS net_change FROM g""")
def _(t):
    from bourse.operators.breadth import sector_rotation
    rows = t.bars_m.select("symbol", "date", F.when(F.col("close") > F.col("open"), F.col("n")).otherwise(0).alias("bull"), F.when(F.col("close") < F.col("open"), F.col("n")).otherwise(0).alias("bear"),
                           F.when(F.col("volume") > 700, 1).otherwise(0).alias("tier1"), "volume")
    return sector_rotation(rows.join(t.sectors, "symbol"))


@query("AG21_top_holders_pivot", doubles="f_high f_low f_urgent", sql="""
, a AS (SELECT o_custkey AS symbol, CASE o_orderpriority WHEN '1-URGENT' THEN 'f_urgent' WHEN '2-HIGH' THEN 'f_high' WHEN '5-LOW' THEN 'f_low' END AS field, o_totalprice AS value, o_orderkey AS k FROM orders)
SELECT symbol, arg_max(value, k) FILTER (WHERE field = 'f_urgent') AS f_urgent, arg_max(value, k) FILTER (WHERE field = 'f_high') AS f_high, arg_max(value, k) FILTER (WHERE field = 'f_low') AS f_low FROM a GROUP BY 1""")
def _(t):
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "f_urgent").when(F.col("o_orderpriority") == "2-HIGH", "f_high").when(F.col("o_orderpriority") == "5-LOW", "f_low")
    rows = t.orders.select(F.col("o_custkey").alias("symbol"), field.alias("field"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("k"))
    return oc.top_holders_pivot(rows, ["symbol"], "field", ["f_urgent", "f_high", "f_low"], "value", "k")


@query("AG22_market_breadth", uses="bars_w", doubles="pct_above_sma adv_decline_ratio pct_at_high net_highs_lows", sql=f"""
, a AS (SELECT symbol, date, close, {rolled('avg(close)', 'close', 200)} AS sma, close - {prev('close')} AS chg, {rolled('max(close)', 'close', 20)} AS h20, {rolled('max(close)', 'close', 252)} AS hi, {rolled('min(close)', 'close', 252)} AS lo FROM bars_w)
SELECT date, CASE WHEN count(*) >= 20 THEN 1.0 * count(*) FILTER (WHERE close > sma) / nullif(count(sma), 0) END AS pct_above_sma,
  CASE WHEN count(*) >= 20 THEN 1.0 * count(*) FILTER (WHERE chg > 0) / nullif(count(*) FILTER (WHERE chg <> 0), 0) END AS adv_decline_ratio,
  CASE WHEN count(*) >= 20 THEN 1.0 * count(*) FILTER (WHERE close >= h20) / nullif(count(h20), 0) END AS pct_at_high,
  CASE WHEN count(*) >= 20 THEN 1.0 * (count(*) FILTER (WHERE close >= hi) - count(*) FILTER (WHERE close <= lo)) / nullif(count(hi), 0) END AS net_highs_lows FROM a GROUP BY date""")
def _(t):
    from bourse.operators.breadth import market_breadth
    return market_breadth(t.bars_w, min_universe=20)


@query("AG23_intraday_breadth", uses="bars_s", doubles="adv_decline_ratio pct_positive avg_change breadth_score", sql=f"""
, q AS (SELECT date, 100 * (close / {prev('close')} - 1) AS c FROM bars_s),
g AS (SELECT date, count(*) FILTER (WHERE c > 0.1) AS adv, count(*) FILTER (WHERE c < -0.1) AS dec, count(*) AS total, avg(c) AS m FROM q WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT *, CASE WHEN adv + dec > 0 THEN 1.0 * adv / (adv + dec) ELSE 0.5 END AS r FROM g), b AS (SELECT *, 0.6 * r + 0.4 / (1 + exp(-m / 0.75)) AS sc FROM s)
SELECT date, adv, dec, total, r AS adv_decline_ratio, 1.0 * adv / total AS pct_positive, m AS avg_change, sc AS breadth_score, CASE WHEN sc >= 0.62 THEN 'RISK_ON' WHEN sc <= 0.38 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS risk_tilt FROM b""")
def _(t):
    from bourse.operators.breadth import intraday_breadth
    return intraday_breadth(t.bars_s.select("date", (100 * ind.change()).alias("change_pct")), ["date"], min_universe=20)


@query("AG24_sector_option_pcr", uses="chain sectors", doubles="pcr", sql="SELECT expiry, sector, sum(pe_oi) / nullif(sum(ce_oi), 0) AS pcr FROM chain JOIN sectors USING (symbol) GROUP BY 1, 2")
def _(t):
    from bourse.functions.frames import ratio
    return t.chain.groupBy("symbol", "expiry").agg(F.sum("pe_oi").alias("p"), F.sum("ce_oi").alias("c")).join(t.sectors, "symbol").groupBy("expiry", "sector").agg(ratio(F.sum("p"), F.sum("c")).alias("pcr"))


@query("AG25_signed_flow", uses="deals bars_s", doubles="buy_pct", sql="""
, d AS (SELECT symbol, CAST(date + 2 AS DATE) AS avail, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN qty ELSE 0 END) AS s
  FROM (SELECT DISTINCT symbol, date, side, qty, l_orderkey, l_linenumber, l_partkey FROM deals WHERE side IS NOT NULL) GROUP BY 1, 2)
SELECT p.symbol, p.date, coalesce(sum(b) / nullif(sum(b) + sum(s), 0), 0.5) AS buy_pct FROM bars_s p LEFT JOIN d ON d.symbol = p.symbol AND d.avail > p.date - 90 AND d.avail <= p.date GROUP BY 1, 2""")
def _(t):
    from bourse.operators.flows import signed_flow
    return signed_flow(t.deals, t.bars_s.select("symbol", "date"), ["symbol", "date", "side", "qty", "l_orderkey", "l_linenumber", "l_partkey"])


@query("AG26_block_deal_flow", uses="deals", doubles="net_qty net_value net_qty_5 net_value_5", sql=f"""
, d AS (SELECT symbol, date, sum(CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty ELSE 0 END) AS net_qty, sum(CASE side WHEN 'BUY' THEN value WHEN 'SELL' THEN -value ELSE 0 END) AS net_value, count(*) AS deals FROM deals GROUP BY 1, 2)
SELECT *, sum(net_qty) {frame(5)} AS net_qty_5, sum(net_value) {frame(5)} AS net_value_5 FROM d""")
def _(t):
    from bourse.operators.flows import block_deal_flow
    return block_deal_flow(t.deals)


@query("AG27_broker_consensus", uses="deals bars_s", doubles="buy_share mean_target upside", sql="""
, r AS (SELECT symbol, date AS reco_date, count(*) AS n, count(*) FILTER (WHERE side = 'BUY') AS b, sum(value / qty) AS t FROM deals GROUP BY 1, 2)
SELECT p.symbol, p.date, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS recos, sum(b) / sum(r.n) AS buy_share, sum(t) / sum(r.n) AS mean_target, sum(t) / sum(r.n) / p.close - 1 AS upside
FROM bars_s p LEFT JOIN r ON r.symbol = p.symbol AND reco_date >= p.date - 30 AND reco_date < p.date GROUP BY p.symbol, p.date, p.close""")
def _(t):
    from bourse.operators.flows import broker_consensus
    recos = t.deals.select("symbol", F.col("date").alias("reco_date"), (F.col("side") == "BUY").alias("is_buy"), (F.col("value") / F.col("qty")).alias("target"))
    return broker_consensus(t.bars_s.select("symbol", "date", "close"), recos, 30)


@query("AG28_fund_sector_flow", uses="trades", doubles="aum_pct flow_pct", sql="""
, h AS (SELECT p_type AS sector, CAST(date_trunc('month', ts) AS DATE) AS month, sum(l_extendedprice) AS v FROM trades GROUP BY 1, 2), p AS (SELECT *, 100 * v / sum(v) OVER (PARTITION BY month) AS aum_pct FROM h)
SELECT sector, month, aum_pct, aum_pct - lag(aum_pct) OVER (PARTITION BY sector ORDER BY month) AS flow_pct FROM p""")
def _(t):
    from bourse.operators.flows import sector_flow
    return sector_flow(t.trades.select(F.col("p_type").alias("sector"), F.date_trunc("month", "ts").cast("date").alias("month"), F.col("l_extendedprice").alias("value")))


EPISODES = """
, d AS (SELECT DISTINCT {k}, date FROM {t}), e AS (SELECT *, date - lag(date) OVER (PARTITION BY {k} ORDER BY date) AS gap FROM d),
ep AS (SELECT {k}, count(*) AS distinct_days, CAST(sum(CASE WHEN gap IS NULL OR gap > {g} THEN 1 ELSE 0 END) AS BIGINT) AS episodes, min(date) AS first_day, max(date) AS last_day FROM e GROUP BY 1)"""


@query("AG29_episodes", uses="decisions", sql=EPISODES.format(k="symbol", t="decisions", g=20) + "SELECT * FROM ep")
def _(t):
    return oc.episodes(t.decisions, ["symbol"], 20)


@query("AG40_episode_coverage", uses="outcomes", sql=EPISODES.format(k="regime", t="outcomes", g=45) + """
SELECT ep.*, n, distinct_days >= 20 AND episodes >= 2 AS ready FROM ep JOIN (SELECT regime, count(*) AS n FROM outcomes GROUP BY 1) s ON ep.regime = s.regime""")
def _(t):
    return oc.episode_coverage(t.outcomes, "regime", 45, 20, 2)


@query("AG30_turnover", uses="bars_s sessions_m", doubles="turnover", sql="""
, s AS (SELECT symbol, idx FROM (SELECT symbol, idx, row_number() OVER (PARTITION BY b.date ORDER BY volume DESC, symbol) AS rn FROM bars_s b JOIN sessions_m m ON b.date = m.date) WHERE rn <= 10),
d AS (SELECT a.idx, 1 - 1.0 * count(b.symbol) / count(*) AS x FROM s a LEFT JOIN s b ON b.symbol = a.symbol AND b.idx = a.idx - 1 WHERE a.idx - 1 IN (SELECT idx FROM s) GROUP BY 1)
SELECT avg(x) AS turnover, count(*) AS sessions FROM d""")
def _(t):
    from bourse.operators.xsection import peers
    rows = calendar.session_index(t.bars_s.select("symbol", "date", "volume"), t.sessions_m)
    top = rows.withColumn("rn", F.row_number().over(peers("date").orderBy(F.desc("volume"), F.asc("symbol")))).where("rn <= 10")
    return oc.turnover(top.select("idx", "symbol"))


FLAGS = f"""
, f AS (SELECT symbol, date, lead(close) OVER ({P}) / close - 1 AS fwd, coalesce(close > open, false) AS up_bar, coalesce(volume > {prev('volume')}, false) AS more_volume, coalesce(close = high, false) AS at_high FROM bars_raw),
g AS (SELECT *, coalesce(fwd >= 1.0, false) AS flyer, coalesce(fwd <= -0.5, false) AS diver FROM f),
l AS (UNPIVOT g ON up_bar, more_volume, at_high INTO NAME flag VALUE v),
d AS (SELECT date, flag, count(*) FILTER (WHERE flyer) AS nf, count(*) FILTER (WHERE diver) AS nd, count(*) AS nu, count(*) FILTER (WHERE flyer AND v) AS pf, count(*) FILTER (WHERE diver AND v) AS pd, count(*) FILTER (WHERE v) AS pu FROM l GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN nf > 0 AND nd > 0 THEN pf / nf - pd / nd END AS diff, CASE WHEN nf > 0 AND nd > 0 THEN ln((pf + 0.5) / (nf + 1.0)) - ln((pd + 0.5) / (nd + 1.0)) END AS lg FROM d)"""


@query("AG31_lift_table", uses="bars_raw", doubles="lift direction_t mean_diff_pp flyer_lift movement_lift", sql=FLAGS + """
SELECT flag, exp(avg(lg)) AS lift, CAST(sum(pf) + sum(pd) AS BIGINT) AS support, avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) AS direction_t, count(diff) AS dates, 100 * avg(diff) AS mean_diff_pp,
  (sum(pf) / sum(nf)) / (sum(pu) / sum(nu)) AS flyer_lift, ((sum(pf) + sum(pd)) / (sum(nf) + sum(nd))) / (sum(pu) / sum(nu)) AS movement_lift FROM x GROUP BY flag""")
def _(t):
    fwd = F.lead("close").over(ind.per_symbol()) / F.col("close") - 1
    rows = t.bars_raw.select(
        "symbol", "date", F.coalesce(fwd >= 1.0, F.lit(False)).alias("flyer"), F.coalesce(fwd <= -0.5, F.lit(False)).alias("diver"),
        (F.col("close") > F.col("open")).alias("up_bar"), (F.col("volume") > ind.prev("volume")).alias("more_volume"), (F.col("close") == F.col("high")).alias("at_high"))
    return oc.lift_table(rows, ["up_bar", "more_volume", "at_high"])


@query("AG32_percentile_summary", uses="outcomes", doubles="p50 p95", sql="SELECT source, count(return_pct) AS n, quantile_cont(return_pct, 0.5) AS p50, quantile_cont(return_pct, 0.95) AS p95 FROM outcomes GROUP BY 1")
def _(t):
    return oc.percentile_summary(t.outcomes, ["source"], "return_pct")


@query("AG33_persistence_streak", uses="outcomes", doubles="reliability streak_score", sql="""
SELECT symbol, count(DISTINCT source) AS screeners, count(*) AS appearances, sum(p) AS reliability, count(DISTINCT source) * sum(p) AS streak_score FROM outcomes GROUP BY 1""")
def _(t):
    return oc.persistence_streak(t.outcomes.select("symbol", F.col("source").alias("screener_id"), F.col("p").alias("reliability")))


META = """, meta AS (SELECT source, screener_id, CASE WHEN avg(return_pct) > 0 THEN 'bullish' ELSE 'bearish' END AS sentiment, CASE WHEN count(*) > 300 THEN 'A' ELSE 'C' END AS tier,
  avg(p) AS score, avg(return_pct) AS alpha, screener_id AS category FROM outcomes WHERE outcome <> 'PENDING' GROUP BY source, screener_id)"""


@query("AG34_membership_features", uses="outcomes", doubles="momentum_score alpha_score", sql=META + """
SELECT symbol, count(*) FILTER (WHERE sentiment = 'bullish') AS bull_count, count(*) FILTER (WHERE sentiment = 'bearish') AS bear_count, count(DISTINCT category) AS category_breadth,
  count(*) FILTER (WHERE tier IN ('A', 'B')) AS tier1_count, coalesce(sum(score) FILTER (WHERE sentiment = 'bullish'), 0) AS momentum_score, avg(alpha) FILTER (WHERE sentiment = 'bullish') AS alpha_score
FROM (SELECT DISTINCT symbol, source, screener_id FROM outcomes) o JOIN meta m ON o.source = m.source AND o.screener_id = m.screener_id GROUP BY 1""")
def _(t):
    done = t.outcomes.where("outcome <> 'PENDING'")
    meta = done.groupBy("source", "screener_id").agg(
        F.when(F.avg("return_pct") > 0, "bullish").otherwise("bearish").alias("sentiment"), F.when(F.count("*") > 300, "A").otherwise("C").alias("tier"),
        F.avg("p").alias("score"), F.avg("return_pct").alias("alpha")).withColumn("category", F.col("screener_id"))
    return oc.membership_features(t.outcomes.select("symbol", "source", "screener_id").distinct(), meta)


@query("AG35_rank_vote_reliability", uses="outcomes", doubles="avg_return win_rate", sql="""
, m AS (SELECT 'A' || screener_id AS screener_id, symbol, date FROM outcomes WHERE p > 0.7 UNION SELECT 'B' || source, symbol, date FROM outcomes WHERE prints > 8 UNION SELECT 'A' || screener_id, symbol, date FROM outcomes WHERE prints > 9)
SELECT screener_id, count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS', 'STOP_LOSS')) AS n, count(*) FILTER (WHERE outcome = 'WIN') AS wins, avg(return_pct) AS avg_return,
  1.0 * count(*) FILTER (WHERE outcome = 'WIN') / count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS', 'STOP_LOSS')) AS win_rate FROM m JOIN outcomes o ON m.symbol = o.symbol AND m.date = o.date GROUP BY m.screener_id HAVING n >= 20""".replace("SELECT screener_id, count(*)", "SELECT m.screener_id, count(*)"))
def _(t):
    pick = lambda prefix, name, cond: t.outcomes.where(cond).select(F.concat(F.lit(prefix), name).alias("screener_id"), "symbol", "date")
    return oc.rank_vote_reliability([pick("A", "screener_id", "p > 0.7"), pick("B", "source", "prints > 8"), pick("A", "screener_id", "prints > 9")],
                                    t.outcomes.select("symbol", "date", "outcome", "return_pct"), 20)


@query("AG36_bucket_lifts", uses="outcomes", doubles="avg_pnl win_rate lift", sql="""
, l AS (UNPIVOT (SELECT outcome, return_pct, source, regime, CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END AS conviction FROM outcomes WHERE outcome IN ('WIN', 'LOSS')) ON source, regime, conviction INTO NAME dimension VALUE bucket)
SELECT dimension, bucket, count(*) AS n, count(*) FILTER (WHERE outcome = 'WIN') AS wins, avg(return_pct) AS avg_pnl, count(*) FILTER (WHERE outcome = 'WIN') / count(*) AS win_rate,
  count(*) FILTER (WHERE outcome = 'WIN') / count(*) / (SELECT avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0 END) FROM outcomes WHERE outcome IN ('WIN', 'LOSS')) AS lift FROM l GROUP BY 1, 2""")
def _(t):
    return oc.bucket_lifts(t.outcomes.where("outcome IN ('WIN', 'LOSS')"), {
        "source": F.col("source"), "regime": F.col("regime"), "conviction": F.when(F.col("p") >= 0.5, "high").otherwise("low")})


@query("AG37_chance_adjusted_recall", uses="outcomes", doubles="expected recall over_chance", sql="""
, g AS (SELECT date, count(*) AS universe, count(*) FILTER (WHERE abs(return_pct) >= 5) AS movers, count(*) FILTER (WHERE p > 0.7) AS rated, count(*) FILTER (WHERE abs(return_pct) >= 5 AND p > 0.7) AS hits FROM outcomes WHERE outcome <> 'PENDING' GROUP BY 1)
SELECT *, rated * movers / universe AS expected, hits / nullif(movers, 0) AS recall, hits - rated * movers / universe AS over_chance FROM g""")
def _(t):
    return oc.chance_adjusted_recall(t.outcomes.where("outcome <> 'PENDING'").select("date", (F.abs("return_pct") >= 5).alias("mover"), (F.col("p") > 0.7).alias("rated")))


@query("AG38_reward_weights", uses="outcomes", doubles="mean_reward weight", sql="""
, r AS (SELECT source, regime, screener_id, CASE outcome WHEN 'WIN' THEN 1 WHEN 'LOSS' THEN 1.5 WHEN 'STOP_LOSS' THEN 2 END * return_pct / horizon_days * 10 AS x, outcome FROM outcomes WHERE outcome <> 'PENDING'),
g AS (SELECT source, regime, screener_id, count(*) AS n, avg(CASE WHEN outcome = 'NEUTRAL' THEN -0.05 ELSE x END) AS m FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 100)
SELECT source, regime, screener_id, m AS mean_reward, least(greatest(CASE WHEN regime = 'BULL' THEN 1.2 ELSE 1.0 END * 0.85 + m * 0.15, 0.3), 2.0) AS weight, n + CASE WHEN regime = 'BULL' THEN 7 ELSE 0 END AS sample_count FROM g""")
def _(t):
    prior = t.outcomes.where("regime = 'BULL'").select("source", "regime", "screener_id").distinct().withColumns({"weight": F.lit(1.2), "sample_count": F.lit(7)})
    return oc.reward_weights(t.outcomes, ["source", "regime", "screener_id"], prior, 100)


@query("AG39_pick_audit", uses="bars_s", doubles="hit_rate avg_return profit_factor alpha", sql="""
, l AS (SELECT symbol, arg_max(close, date) AS price FROM bars_s GROUP BY 1),
p AS (SELECT CAST(date AS VARCHAR) AS list, symbol, close AS entry, close * 0.97 AS stop, close * 1.02 AS target FROM bars_s WHERE volume > 400),
r AS (SELECT p.*, price, 100 * (price / entry - 1) AS ret, CASE WHEN price IS NULL THEN 'OPEN' WHEN price <= stop THEN 'MISS' WHEN price >= target THEN 'HIT' ELSE 'OPEN' END AS o FROM p LEFT JOIN l ON p.symbol = l.symbol)
SELECT list, count(*) AS picks, count(*) FILTER (WHERE o = 'HIT') AS hits, count(*) FILTER (WHERE o = 'MISS') AS misses, coalesce(100.0 * count(*) FILTER (WHERE o = 'HIT') / nullif(count(*) FILTER (WHERE o IN ('HIT', 'MISS')), 0), 0) AS hit_rate,
  avg(ret) AS avg_return, coalesce(nullif(sum(ret) FILTER (WHERE ret > 0), 0), 0.001) / coalesce(nullif(sum(-ret) FILTER (WHERE ret < 0), 0), 0.001) AS profit_factor,
  arg_max(symbol, row(ret, symbol)) AS best, arg_min(symbol, row(ret, symbol)) AS worst, avg(ret) - 1.5 AS alpha FROM r GROUP BY 1""")
def _(t):
    last = t.bars_s.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    picks = t.bars_s.where("volume > 400").select(F.col("date").cast("string").alias("list"), "symbol", F.col("close").alias("entry"), (F.col("close") * 0.97).alias("stop"), (F.col("close") * 1.02).alias("target"))
    return oc.pick_audit(picks, last, F.lit(1.5))
