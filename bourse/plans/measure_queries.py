"""Queries for the measurement operators, on five-session momentum over monthly bars."""

from pyspark.sql import functions as F

from bourse.operators import labels, measure
from bourse.operators.indicators import change
from bourse.operators.prep import flag_suspect
from bourse.plans.registry import query
from bourse.plans.sqltext import prev


def momentum_panel(t, horizon: int = 1):
    """Trusted bars with momentum and the open-to-open forward return."""
    clean = flag_suspect(t.bars_m).where("suspect_reason IS NULL")
    rows = labels.forward_return(clean, t.sessions_m, horizon)
    return rows.withColumn("score", change("close", 5)).select("symbol", "date", "idx", "close", "volume", "score", "fwd")


def fwd_sql(horizon: int, bars: str = "bars_m", sessions: str = "sessions_m", extra: str = "") -> str:
    return f"""
, g AS (SELECT b.*, s.idx FROM {bars} b JOIN {sessions} s ON b.date = s.date),
panel AS (SELECT a.symbol, a.date, a.idx, a.close, a.volume, a.close / lag(a.close, 5) OVER (PARTITION BY a.symbol ORDER BY a.date) - 1 AS score,
  CASE WHEN a.idx + 1 + {horizon} <= (SELECT max(idx) FROM {sessions}) THEN coalesce(o.open, w.close) / e.open - 1 END AS fwd,
  (a.idx + 1 + {horizon} <= (SELECT max(idx) FROM {sessions}) AND o.open IS NULL AND e.open IS NOT NULL AND w.close IS NOT NULL) AS stopped{extra}
  FROM g a LEFT JOIN g e ON e.symbol = a.symbol AND e.idx = a.idx + 1 LEFT JOIN g o ON o.symbol = a.symbol AND o.idx = a.idx + 1 + {horizon}
  LEFT JOIN (SELECT p.symbol, p.idx, arg_max(q.close, q.idx) AS close FROM g p JOIN g q ON q.symbol = p.symbol AND q.idx BETWEEN p.idx + 1 AND p.idx + {horizon}
             GROUP BY 1, 2) w ON w.symbol = a.symbol AND w.idx = a.idx)"""


IC = """
, ok AS (SELECT * FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM ok),
ic AS (SELECT date, corr(a, b) AS ic, count(*) AS names FROM rk GROUP BY date HAVING count(*) >= 10)"""


@query("K1_per_date_ic", uses="bars_m sessions_m", doubles="ic", sql=fwd_sql(1) + IC + "SELECT * FROM ic")
def _(t):
    return measure.per_date_ic(momentum_panel(t), "score", "fwd")


def nw_sql(table: str, value: str, lags: int) -> str:
    """HAC statistics of a dated series, by self-joining it on its own numbering."""
    return f"""
, e AS (SELECT {value} AS v, {value} - avg({value}) OVER () AS e, row_number() OVER (ORDER BY date) AS i FROM {table} WHERE {value} IS NOT NULL),
c AS (SELECT (SELECT sum(e * e) FROM e) AS c0, coalesce(sum(2 * (1 - (x.i - y.i) / {lags + 1}.0) * x.e * y.e), 0) AS cl
      FROM e x JOIN e y ON x.i - y.i BETWEEN 1 AND {lags}),
s AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS pct_positive FROM e),
nw AS (SELECT s.*, mean / sqrt((c0 + cl) / n / n) AS t_nw FROM s, c)"""


@query("K2_newey_west", uses="bars_m sessions_m", doubles="mean std pct_positive t_nw",
       sql=fwd_sql(5) + IC + nw_sql("ic", "ic", 4) + "SELECT * FROM nw")
def _(t):
    return measure.newey_west(measure.per_date_ic(momentum_panel(t, 5), "score", "fwd"), "ic", 4)


@query("K3_momentum_ic_summary", uses="bars_m sessions_m", doubles="eff_dates mean_ic ic_std t_nw pct_positive",
       sql=fwd_sql(1) + IC + nw_sql("ic", "ic", 0) + """
SELECT 1 AS horizon, n AS n_dates, round(CAST(n AS DOUBLE), 2) AS eff_dates, mean AS mean_ic, std AS ic_std, t_nw, pct_positive, n >= 20 AS reliable FROM nw""")
def _(t):
    return measure.ic_summary(measure.per_date_ic(momentum_panel(t), "score", "fwd"), 1)


TOPK = """
, ok AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
topk AS (SELECT date, avg(fwd) FILTER (WHERE rn <= 5) AS top, avg(fwd) AS mean, quantile_cont(fwd, 0.5) AS median, count(*) AS names
  FROM ok GROUP BY date HAVING count(*) >= 10)"""


@query("K4_topk_excess", uses="bars_m sessions_m", doubles="top mean median exc_mean exc_median",
       sql=fwd_sql(1) + TOPK + "SELECT *, top - mean AS exc_mean, top - median AS exc_median FROM topk")
def _(t):
    return measure.topk_excess(momentum_panel(t), "score", "fwd", 5)


@query("K4_median_beater", uses="bars_m sessions_m", doubles="mean_ic topk_exc_mean topk_exc_median",
       sql=fwd_sql(1) + IC + TOPK.replace("ok AS", "ok2 AS").replace("FROM ok ", "FROM ok2 ") + """
, a AS (SELECT avg(ic) AS m FROM ic), b AS (SELECT avg(top - mean) AS x, avg(top - median) AS y FROM topk)
SELECT m AS mean_ic, x AS topk_exc_mean, y AS topk_exc_median, m > 0 AND x < 0 AS median_beater FROM a, b""")
def _(t):
    panel = momentum_panel(t)
    return measure.median_beater(measure.per_date_ic(panel, "score", "fwd"), measure.topk_excess(panel, "score", "fwd", 5))


@query("K5_tail_aucs", uses="bars_m sessions_m", doubles="auc_winners auc_losers auc_win_vs_lose", sql=fwd_sql(1) + """
, ok AS (SELECT * FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
q AS (SELECT date, quantile_cont(fwd, 0.8) AS hi, quantile_cont(fwd, 0.2) AS lo FROM ok GROUP BY date HAVING count(*) >= 20),
j AS (SELECT ok.date, score, fwd >= hi AS top, fwd <= lo AS bot FROM ok JOIN q ON ok.date = q.date),
p AS (SELECT x.date, avg(CASE WHEN x.top AND NOT y.top THEN CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END END) AS w,
  avg(CASE WHEN x.bot AND NOT y.bot THEN CASE WHEN x.score < y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END END) AS l,
  avg(CASE WHEN x.top AND y.bot THEN CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END END) AS s
  FROM j x JOIN j y ON x.date = y.date GROUP BY x.date)
SELECT avg(w) AS auc_winners, avg(l) AS auc_losers, avg(s) AS auc_win_vs_lose, count(*) AS dates FROM p""")
def _(t):
    return measure.tail_aucs(momentum_panel(t), "score", "fwd")


@query("K6_quantile_returns", uses="bars_s", doubles="mean_excess", sql=f"""
, p AS (SELECT symbol, date, close / {prev('close', 3)} - 1 AS score, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM bars_s),
ok AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY date) AS n, avg(fwd) OVER (PARTITION BY date) AS u
  FROM p WHERE score IS NOT NULL AND fwd IS NOT NULL),
b AS (SELECT date, CAST(greatest(ceil((r - 1) * 10.0 / (n - 1)) - 1, 0) AS BIGINT) AS bucket, avg(fwd) - first(u) AS x FROM ok WHERE n >= 30 GROUP BY 1, 2)
SELECT bucket, avg(x) AS mean_excess, count(*) AS dates FROM b GROUP BY 1""")
def _(t):
    from bourse.operators.indicators import per_symbol
    panel = t.bars_s.select("symbol", "date", change("close", 3).alias("score"), (F.lead("close").over(per_symbol()) / F.col("close") - 1).alias("fwd"))
    return measure.quantile_returns(panel, "score", "fwd", 10)
