"""Queries for cross-sectional operators."""

from pyspark.sql import functions as F

from bourse.operators import xsection as xs
from bourse.operators.indicators import change
from bourse.plans.registry import query
from bourse.plans.sqltext import prev

RET = f", r AS (SELECT symbol, date, close / {prev('close')} - 1 AS x FROM bars_s)"


def _returns(t):
    return t.bars_s.select("symbol", "date", change().alias("x"))


AVG_RANK = "rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0"


@query("E20_percentile_rank", uses="bars_s", doubles="x pct", sql=f"""{RET}
SELECT symbol, date, x, CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY date) >= 20 THEN
  ({AVG_RANK}) / count(x) OVER (PARTITION BY date) END AS pct FROM r""")
def _(t):
    return _returns(t).withColumn("pct", xs.percentile_rank("x", min_n=20))


@query("E21_midrank_percentile", uses="bars_s", doubles="pct", sql="""
, a AS (SELECT date, symbol, n FROM bars_s)
SELECT x.symbol, x.date, CASE WHEN count(*) = 1 THEN 50.0 ELSE
  100.0 * (sum(CASE WHEN y.n < x.n THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN y.n = x.n THEN 1 ELSE 0 END)) / count(*) END AS pct
FROM a x JOIN a y ON x.date = y.date GROUP BY 1, 2""")
def _(t):
    return t.bars_s.select("symbol", "date", xs.midrank_percentile("n").alias("pct"))


@query("E22_linear_percentile", uses="bars_s", doubles="rising falling", sql=f"""{RET}
, n AS (SELECT *, count(x) OVER (PARTITION BY date) AS n FROM r)
SELECT symbol, date,
  CASE WHEN symbol LIKE '%7' THEN 0.0 WHEN x IS NULL OR n <= 1 THEN 50.0
       ELSE 100.0 * (row_number() OVER (PARTITION BY date ORDER BY x ASC NULLS LAST, symbol) - 1) / (n - 1) END AS rising,
  CASE WHEN x IS NULL OR n <= 1 THEN 50.0
       ELSE 100.0 * (row_number() OVER (PARTITION BY date ORDER BY x DESC NULLS LAST, symbol) - 1) / (n - 1) END AS falling
FROM n""")
def _(t):
    return _returns(t).select(
        "symbol", "date", xs.linear_percentile("x", known_bad=F.col("symbol").endswith("7")).alias("rising"),
        xs.linear_percentile("x", higher_is_better=False).alias("falling"))


@query("E23_rank_gauss")
def _(t):
    """Checked against the inverse normal in the tests; DuckDB has none."""
    return xs.rank_gauss(_returns(t), "x", F.col("symbol") != "S1")


@query("E24_zscore", uses="bars_s", doubles="z", sql=f"""{RET}
SELECT symbol, date, CASE WHEN coalesce(stddev_samp(x) OVER d, 0) = 0 THEN 0.0 ELSE (x - avg(x) OVER d) / stddev_samp(x) OVER d END AS z
FROM r WINDOW d AS (PARTITION BY date)""")
def _(t):
    return _returns(t).select("symbol", "date", xs.zscore("x").alias("z"))


@query("E24_sector_zscore", uses="bars_m sectors", doubles="z", sql=f"""
, r AS (SELECT symbol, date, close / {prev('close')} - 1 AS x FROM bars_m), j AS (SELECT r.*, sector FROM r JOIN sectors USING (symbol))
SELECT symbol, date, sector, CASE WHEN count(x) OVER d >= 3 THEN (x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0) END AS z
FROM j WINDOW d AS (PARTITION BY date, sector)""")
def _(t):
    rows = t.bars_m.select("symbol", "date", change().alias("x")).join(t.sectors, "symbol")
    return rows.select("symbol", "date", "sector", xs.sector_zscore("x", min_n=3).alias("z"))


@query("E25_winsorize", uses="bars_s", doubles="x x_w", sql=f"""{RET}
, n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST) - 1 AS i, count(x) OVER (PARTITION BY date) AS n FROM r),
c AS (SELECT date, max(CASE WHEN i = ceil(0.05 * (n - 1)) THEN x END) AS lo, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN x END) AS hi FROM n GROUP BY date)
SELECT symbol, n.date, x, CASE WHEN x IS NULL OR n < 5 THEN x ELSE least(greatest(x, lo), hi) END AS x_w FROM n JOIN c ON n.date = c.date""")
def _(t):
    return xs.winsorize(_returns(t), "x", 0.05)


@query("E26_relative_strength", uses="bars_w sectors", doubles="rs_rank_21 rs_rank_63 rs_vs_sector_21 rs_vs_sector_63", sql=f"""
, r AS (SELECT symbol, date, close / {prev('close', 21)} - 1 AS a, {prev('close', 21)} / {prev('close', 63)} - 1 AS b FROM bars_w),
j AS (SELECT r.*, sector FROM r LEFT JOIN sectors USING (symbol))
SELECT symbol, date, sector, {", ".join(f'''
  CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY date) >= 20 THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST)
    + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END AS rs_rank_{n},
  CASE WHEN count({c}) OVER (PARTITION BY date, sector) >= 5 THEN {c} - avg({c}) OVER (PARTITION BY date, sector) END AS rs_vs_sector_{n}'''
  for c, n in (("a", 21), ("b", 63)))} FROM j""")
def _(t):
    return xs.relative_strength(t.bars_w, t.sectors)


@query("E27_sector_momentum", uses="bars_w sectors", doubles="sector_ret_5 sector_ret_21", sql=f"""
, r AS (SELECT symbol, date, 100 * (close / {prev('close', 5)} - 1) AS a, 100 * (close / {prev('close', 21)} - 1) AS b FROM bars_w)
SELECT date, sector, avg(a) AS sector_ret_5, avg(b) AS sector_ret_21 FROM r JOIN sectors USING (symbol) GROUP BY 1, 2""")
def _(t):
    return xs.sector_momentum(t.bars_w, t.sectors)


@query("L11_excess", uses="bars_s", doubles="over_mean over_median", sql=f"""{RET}
, m AS (SELECT date, avg(x) AS a, quantile_cont(x, 0.5) AS b FROM r GROUP BY date)
SELECT symbol, r.date, x - a AS over_mean, x - b AS over_median FROM r JOIN m ON r.date = m.date""")
def _(t):
    rows = xs.excess(_returns(t), "x", "mean", "over_mean")
    return xs.excess(rows, "x", "median", "over_median").drop("x")


@query("AG20_sector_mean_excess", uses="bars_m sectors", doubles="sector_excess", sql=f"""
, r AS (SELECT symbol, date, close / {prev('close')} - 1 AS x FROM bars_m), j AS (SELECT r.*, sector FROM r JOIN sectors USING (symbol)),
g AS (SELECT date, sector, avg(x) AS m, count(x) AS n FROM j GROUP BY 1, 2), d AS (SELECT date, avg(x) AS m FROM j GROUP BY 1)
SELECT symbol, j.date, j.sector, x - CASE WHEN g.n >= 5 THEN g.m ELSE d.m END AS sector_excess
FROM j JOIN g ON j.date = g.date AND j.sector = g.sector JOIN d ON j.date = d.date""")
def _(t):
    rows = t.bars_m.select("symbol", "date", change().alias("x")).join(t.sectors, "symbol")
    return xs.sector_mean_excess(rows, "x").drop("x")
