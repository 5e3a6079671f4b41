"""Queries for the point-in-time, interval and dimension joins."""

from pyspark.sql import functions as F

from bourse.operators import asof, calendar, spans
from bourse.operators.indicators import change
from bourse.plans.registry import query
from bourse.plans.sqltext import prev

DKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "symbol", "date"]
DK = ", ".join(f"d.{c}" for c in DKEY)


@query("J1_asof_join", uses="decisions facts", doubles="value",
       sql=f"SELECT {DK}, f.value, f.as_of_date AS matched FROM decisions d ASOF LEFT JOIN facts f ON d.symbol = f.symbol AND d.date >= f.as_of_date")
def _(t):
    return asof.asof_join(t.decisions, t.facts, "symbol", "date", "as_of_date", ["value"])


@query("J1_asof_lag_tolerance", uses="decisions facts", doubles="value", sql=f"""
SELECT {DK}, CASE WHEN date_diff('day', f.t, d.date) <= 90 THEN f.value END AS value, CASE WHEN date_diff('day', f.t, d.date) <= 90 THEN f.t END AS matched
FROM decisions d ASOF LEFT JOIN (SELECT symbol, value, CAST(as_of_date + 2 AS DATE) AS t FROM facts) f ON d.symbol = f.symbol AND d.date >= f.t""")
def _(t):
    return asof.asof_join(t.decisions, t.facts, "symbol", "date", "as_of_date", ["value"], lag_days=2, tolerance_days=90)


@query("J2_asof_nearest_yoy", uses="facts", doubles="value prior growth", sql="""
, q AS (SELECT symbol, as_of_date, value, as_of_date - 365 AS target FROM facts),
c AS (SELECT q.symbol, q.as_of_date, q.value, p.value AS prior, p.as_of_date AS matched, row_number() OVER (PARTITION BY q.symbol, q.as_of_date
      ORDER BY abs(date_diff('day', p.as_of_date, CAST(q.target AS DATE))) NULLS LAST, p.as_of_date) AS rn
      FROM q LEFT JOIN facts p ON p.symbol = q.symbol AND abs(date_diff('day', p.as_of_date, CAST(q.target AS DATE))) <= 15)
SELECT symbol, as_of_date, value, prior, matched, (value - prior) / abs(prior) AS growth FROM c WHERE rn = 1""")
def _(t):
    asked = t.facts.withColumn("target", F.date_sub("as_of_date", 365))
    prior = t.facts.select("symbol", F.col("as_of_date").alias("d"), F.col("value").alias("prior"))
    out = asof.asof_join(asked, prior, "symbol", "target", "d", ["prior"], tolerance_days=15, direction="nearest")
    return out.drop("target").withColumn("growth", F.try_divide(F.col("value") - F.col("prior"), F.abs("prior")))


@query("J3_first_session_on_or_after", uses="sessions_w", sql="""
, e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date FROM orders)
SELECT o_orderkey, event_date, s.date AS session FROM e ASOF LEFT JOIN sessions_w s ON e.event_date <= s.date""")
def _(t):
    events = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("event_date"))
    return calendar.roll_forward(events, t.sessions_w, "event_date")


@query("J3_asof_forward", uses="decisions facts", doubles="value",
       sql=f"SELECT {DK}, f.value, f.as_of_date AS matched FROM decisions d ASOF LEFT JOIN facts f ON d.symbol = f.symbol AND d.date <= f.as_of_date")
def _(t):
    return asof.asof_join(t.decisions, t.facts, "symbol", "date", "as_of_date", ["value"], direction="forward")


IST = "(ts + INTERVAL '5 hours 30 minutes')"


@query("J4_known_date", uses="ticks", sql=f"""
SELECT event_id, CAST(CAST({IST} AS DATE) + CASE WHEN hour({IST}) >= 19 THEN 1 ELSE 0 END AS DATE) AS known FROM ticks""")
def _(t):
    return t.ticks.select("event_id", calendar.known_date(F.col("ts")).alias("known"))


@query("J5_lateral_top1", uses="decisions facts", doubles="value", sql=f"""
SELECT {DK}, x.value, x.as_of_date AS matched FROM decisions d JOIN LATERAL (
  SELECT value, as_of_date FROM facts f WHERE f.symbol = d.symbol AND f.value > 100000 AND f.as_of_date <= d.date AND f.as_of_date >= d.date - 30
  ORDER BY as_of_date DESC LIMIT 1) x ON true""")
def _(t):
    hist = t.facts.where("value > 100000")
    return asof.asof_join(t.decisions, hist, "symbol", "date", "as_of_date", ["value"], tolerance_days=30).where("matched IS NOT NULL")


@query("J6_lateral_window_mean", uses="decisions facts", doubles="window_mean", sql=f"""
SELECT {DK}, avg(f.value) AS window_mean, count(f.value) AS window_n FROM decisions d LEFT JOIN facts f
  ON f.symbol = d.symbol AND f.as_of_date >= d.date - 30 AND f.as_of_date < d.date GROUP BY ALL""")
def _(t):
    return asof.window_aggregate(t.decisions, t.facts, "symbol", "date", "as_of_date", "value", 30)


@query("J7_trailing_bars", uses="bars_m", doubles="close", sql="""
, p AS (SELECT DISTINCT p_brand AS symbol, CAST(date_trunc('day', l_shipdate) AS DATE) AS as_of FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1),
r AS (SELECT p.symbol, p.as_of, b.date, b.close, row_number() OVER (PARTITION BY p.symbol, p.as_of ORDER BY b.date DESC) AS k
      FROM p JOIN bars_m b ON b.symbol = p.symbol AND b.date <= p.as_of)
SELECT * FROM r WHERE k <= 3""")
def _(t):
    pairs = t.trades.where("l_linenumber = 1").select("symbol", F.col("ts").cast("date").alias("as_of")).distinct()
    return asof.trailing_bars(pairs, t.bars_m.select("symbol", "date", "close"), 3)


def _anchors(t):
    return t.trades.select("symbol", F.col("ts").cast("date").alias("anchor")).distinct()


@query("J8_next_bar_after_open", uses="trades bars_w", doubles="price", sql="""
SELECT a.symbol, a.anchor, b.open AS price, b.date AS bar_date FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS anchor FROM trades) a
ASOF LEFT JOIN bars_w b ON a.symbol = b.symbol AND a.anchor < b.date""")
def _(t):
    return asof.next_bar(_anchors(t), t.bars_w, "AFTER_OPEN")


@query("J8_next_bar_geq_close", uses="trades bars_w", doubles="price", sql="""
SELECT a.symbol, a.anchor, b.close AS price, b.date AS bar_date FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS anchor FROM trades) a
ASOF LEFT JOIN bars_w b ON a.symbol = b.symbol AND a.anchor <= b.date""")
def _(t):
    return asof.next_bar(_anchors(t), t.bars_w, "GEQ_CLOSE")


@query("J9_active_memberships", uses="spans sessions_m", sql="""
SELECT list, date, count(*) AS open_spans, count(DISTINCT symbol) AS symbols FROM spans JOIN sessions_m
  ON start_date <= date AND (end_date IS NULL OR end_date > date) GROUP BY 1, 2""")
def _(t):
    return spans.membership_counts(t.spans, t.sessions_m.select("date"))


@query("J10_span_breadth", uses="spans decisions", sql="""
, p AS (SELECT DISTINCT symbol, date FROM decisions),
e AS (SELECT symbol, start_date AS d, 1 AS n FROM spans UNION ALL SELECT symbol, end_date + 1, -1 FROM spans WHERE end_date IS NOT NULL)
SELECT p.symbol, p.date, CAST(sum(n) AS BIGINT) AS breadth FROM p LEFT JOIN e ON e.symbol = p.symbol AND e.d <= p.date GROUP BY 1, 2""")
def _(t):
    return spans.span_breadth(t.spans, t.decisions.select("symbol", "date").distinct())


HISTORY_SQL = """
, h AS (SELECT 'S' || s_suppkey AS symbol, 2 * s_suppkey AS instrument_id, DATE '1990-01-01' AS valid_from, DATE '1998-06-30' AS valid_to FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 2 * s_suppkey + 1, DATE '1998-07-01', CASE WHEN s_suppkey % 2 = 0 THEN DATE '2000-12-31' END FROM supplier)"""


@query("J11_symbol_history_join", uses="bars_s", doubles="close", sql=HISTORY_SQL + """
SELECT b.symbol, b.date, b.close, h.instrument_id FROM bars_s b LEFT JOIN h ON b.symbol = h.symbol AND b.date >= h.valid_from AND (h.valid_to IS NULL OR b.date <= h.valid_to)""")
def _(t):
    s = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), "s_suppkey")
    day = lambda x: F.to_date(F.lit(x))
    first = s.select("symbol", (2 * F.col("s_suppkey")).alias("instrument_id"), day("1990-01-01").alias("valid_from"), day("1998-06-30").alias("valid_to"))
    second = s.select("symbol", (2 * F.col("s_suppkey") + 1).alias("instrument_id"), day("1998-07-01").alias("valid_from"),
                      F.when(F.col("s_suppkey") % 2 == 0, day("2000-12-31")).alias("valid_to"))
    return spans.history_join(t.bars_s.select("symbol", "date", "close"), first.unionByName(second))


@query("J12_unambiguous_map", sql="""
SELECT s_suppkey % 60 AS code, count(DISTINCT s_name) AS owners, CASE WHEN count(DISTINCT s_name) = 1 THEN min(s_name) END AS symbol,
  string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS candidates FROM supplier GROUP BY 1""")
def _(t):
    return spans.unambiguous_map(t.supplier.select((F.col("s_suppkey") % 60).alias("code"), "s_name"), "code", "s_name").select("code", "owners", "symbol", "candidates")


FIN_SQL = """
, fin AS (SELECT o_custkey AS symbol, CASE WHEN o_orderpriority < '3' THEN 'C' ELSE 'S' END AS basis,
  last_day(CAST(o_orderdate AS DATE)) AS period_end, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)"""


def statements(t):
    return t.orders.groupBy(
        F.col("o_custkey").alias("symbol"), F.when(F.col("o_orderpriority") < "3", "C").otherwise("S").alias("basis"),
        F.last_day(F.col("o_orderdate").cast("date")).alias("period_end")).agg(F.sum("o_totalprice").alias("value"))


@query("J13_prior_year_self_join", doubles="value prior growth", sql=FIN_SQL + """
, g AS (SELECT c.*, p.value AS prior, c.value / p.value - 1 AS growth FROM fin c JOIN fin p ON p.symbol = c.symbol AND p.basis = c.basis
  AND c.period_end = CASE WHEN month(p.period_end) = 2 AND day(p.period_end) = 29 THEN CAST(p.period_end + INTERVAL 1 YEAR AS DATE) ELSE CAST(p.period_end + INTERVAL 1 YEAR AS DATE) END
  WHERE c.value > 0 AND p.value > 0 AND c.value / p.value BETWEEN 0.05 AND 11)
SELECT symbol, basis, period_end, value, prior, growth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC, basis DESC) AS rn FROM g) WHERE rn = 1""")
def _(t):
    return asof.prior_year_growth(statements(t))


@query("J14_prefer_source", doubles="value", sql="""
, a AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS source, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)
SELECT symbol, date, source, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY
  CASE source WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, source) AS rn FROM a) WHERE rn = 1""")
def _(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("source")).agg(F.max("o_totalprice").alias("value"))
    return asof.prefer_source(rows, ["symbol", "date"], {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 2})


@query("J15_semi_anti", sql="""
SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')""")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    kept = t.orders.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi")
    return kept.join(lines.where("l_returnflag = 'N'"), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("J16_band_join", uses="facts", doubles="value", sql="""
, e AS (SELECT DISTINCT o_custkey AS symbol, CAST(l_shipdate AS DATE) AS event_date FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1)
SELECT f.symbol, f.as_of_date, f.value, e.event_date FROM facts f JOIN e ON f.symbol = e.symbol AND e.event_date BETWEEN f.as_of_date - 5 AND f.as_of_date + 5""")
def _(t):
    events = t.decisions.where("l_linenumber = 1").select("symbol", F.col("date").alias("event_date")).distinct()
    return asof.band_join(t.facts, events, "symbol", "as_of_date", "event_date", 5)


@query("J17_coverage_reconcile", sql="""
, e AS (SELECT DISTINCT o_custkey AS symbol FROM orders), a AS (SELECT c_custkey AS symbol FROM customer WHERE c_acctbal > 0)
SELECT coalesce(e.symbol, a.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'MISSING' WHEN e.symbol IS NULL THEN 'GHOST' ELSE 'OK' END AS status
FROM e FULL JOIN a ON e.symbol = a.symbol""")
def _(t):
    from bourse.operators.quality import coverage_reconcile
    return coverage_reconcile(t.orders.select(F.col("o_custkey").alias("symbol")).distinct(),
                              t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol")), ["symbol"])


@query("J18_reconcile_overwrite", uses="trades bars_m", doubles="open high low close", sql="""
, off AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS date, min(price) AS low, max(price) AS high, avg(price) AS close,
  CASE WHEN count(*) % 5 <> 0 THEN avg(price) END AS open FROM trades WHERE l_linenumber <> 3 GROUP BY 1, 2),
c AS (SELECT coalesce(b.symbol, o.symbol) AS symbol, coalesce(b.date, o.date) AS date,
  (o.open + o.high + o.low + o.close) IS NOT NULL AS full_bar, o.symbol IS NULL AS ghost, b.open bo, b.high bh, b.low bl, b.close bc, o.open oo, o.high oh, o.low ol, o.close oc
  FROM bars_m b FULL JOIN off o ON b.symbol = o.symbol AND b.date = o.date)
SELECT symbol, date, CASE WHEN full_bar THEN oo ELSE bo END AS open, CASE WHEN full_bar THEN oh ELSE bh END AS high, CASE WHEN full_bar THEN ol ELSE bl END AS low,
  CASE WHEN full_bar THEN oc ELSE bc END AS close, CASE WHEN ghost THEN 'GHOST' WHEN full_bar THEN 'OFFICIAL' ELSE 'OFFICIAL_INCOMPLETE' END AS reason FROM c""")
def _(t):
    from bourse.operators.quality import reconcile_overwrite
    official = t.trades.where("l_linenumber <> 3").groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("date")).agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("close"),
        F.when(F.count("*") % 5 != 0, F.avg("price")).alias("open"))
    return reconcile_overwrite(t.bars_m.select("symbol", "date", "open", "high", "low", "close"), official)


@query("J19_dimension_lookup", uses="bars_m sectors", doubles="close",
       sql="SELECT b.symbol, date, close, sector FROM bars_m b LEFT JOIN sectors s ON b.symbol = s.symbol")
def _(t):
    return t.bars_m.select("symbol", "date", "close").join(t.sectors, "symbol", "left")


@query("J20_market_column", uses="bars_m index_m", doubles="close market",
       sql="SELECT b.symbol, b.date, b.close, i.close AS market FROM bars_m b LEFT JOIN index_m i ON b.date = i.date")
def _(t):
    return t.bars_m.select("symbol", "date", "close").join(t.index_m.select("date", F.col("close").alias("market")), "date", "left")


@query("J21_limited_ffill_onto", uses="bars_s sessions_m", doubles="value", sql="""
, f AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS fact_date, max(l_extendedprice) AS value FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2),
p AS (SELECT f.*, s.idx AS start FROM f ASOF JOIN sessions_m s ON f.fact_date <= s.date),
b AS (SELECT symbol, b.date, idx FROM bars_s b JOIN sessions_m s ON b.date = s.date)
SELECT b.symbol, b.date, b.idx, CASE WHEN b.idx - p.start <= 2 THEN p.value END AS value, CASE WHEN b.idx - p.start <= 2 THEN b.idx - p.start END AS age
FROM b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.date >= p.fact_date""")
def _(t):
    facts = t.deals.where("qty >= 49").groupBy("symbol", F.col("date").alias("fact_date")).agg(F.max("value").alias("value"))
    panel = calendar.session_index(t.bars_s.select("symbol", "date"), t.sessions_m)
    return asof.limited_ffill(panel, facts, t.sessions_m, "symbol", "fact_date", "value", 2)


@query("J22_pair_correlation", uses="bars_m", doubles="corr", sql=f"""
, bk AS (SELECT symbol FROM bars_m GROUP BY 1 ORDER BY sum(CAST(close * volume AS DECIMAL(38,4))) DESC, symbol LIMIT 15),
r AS (SELECT * FROM (SELECT symbol, date, close / {prev('close')} - 1 AS ret FROM bars_m) WHERE symbol IN (SELECT symbol FROM bk))
SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol
WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    returns = t.bars_m.select("symbol", "date", change().alias("ret"))
    return spans.pair_correlation(returns, spans.top_by_turnover(t.bars_m, 15), 20)


@query("J23_eligible_asof", uses="bars_s trades", sql="""
, l AS (SELECT DISTINCT 'S' || l_suppkey AS symbol, CAST(date_trunc('month', ts) AS DATE) AS date FROM trades WHERE qty > 45 AND month(ts) <> 7)
SELECT b.symbol, b.date, CASE WHEN b.date IN (SELECT date FROM l) THEN l.symbol IS NOT NULL END AS eligible FROM bars_s b LEFT JOIN l ON b.symbol = l.symbol AND b.date = l.date""")
def _(t):
    listed = t.trades.where((F.col("qty") > 45) & (F.month("ts") != 7)).select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.date_trunc("month", "ts").cast("date").alias("date"))
    return spans.eligible_asof(t.bars_s.select("symbol", "date"), listed)


@query("J24_events_in_window", uses="spans", sql="""
, p AS (SELECT span_id AS plan_id, symbol, start_date AS entry_date, start_date + 60 AS exit_date FROM spans),
e AS (SELECT DISTINCT symbol, list AS kind, start_date AS event_date FROM spans),
f AS (SELECT plan_id, count(*) AS n, min(event_date) AS first_event, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
  FROM p JOIN e ON p.symbol = e.symbol AND event_date > entry_date AND event_date <= exit_date GROUP BY 1)
SELECT p.plan_id, p.symbol, p.entry_date, CAST(p.exit_date AS DATE) AS exit_date, coalesce(n, 0) AS n_events, first_event, kinds FROM p LEFT JOIN f ON p.plan_id = f.plan_id""")
def _(t):
    plans = t.spans.select(F.col("span_id").alias("plan_id"), "symbol", F.col("start_date").alias("entry_date"), F.date_add("start_date", 60).alias("exit_date"))
    events = t.spans.select("symbol", F.col("list").alias("kind"), F.col("start_date").alias("event_date"))
    return spans.events_in_window(plans, events)


@query("J25_all_filters_match", sql="""
, a AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS run_id, l_suppkey AS symbol, l_returnflag AS filter FROM lineitem)
SELECT run_id, symbol FROM a WHERE filter IN ('N', 'R', 'A') GROUP BY 1, 2 HAVING count(DISTINCT filter) = 3""")
def _(t):
    rows = t.lineitem.select(F.date_trunc("month", "l_shipdate").cast("date").alias("run_id"), F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("filter"))
    return spans.all_filters_match(rows, ["N", "R", "A"])


@query("J26_usable_before_open", uses="ticks", doubles="preopen", sql="""
, s AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM ticks)),
d AS (SELECT DISTINCT symbol, s.idx, s.date FROM ticks JOIN s ON CAST(ts AS DATE) = s.date),
e AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_max(price, row(ts, price)) AS preopen FROM ticks WHERE strftime(ts, '%H:%M:%S') < '09:15:00' GROUP BY 1, 2)
SELECT d.symbol, d.idx, d.date, e.preopen FROM d LEFT JOIN (SELECT symbol, s.idx - 1 AS idx, preopen FROM e JOIN s ON e.date = s.date) e ON d.symbol = e.symbol AND d.idx = e.idx""")
def _(t):
    days = calendar.session_table(t.ticks.select(F.col("ts").cast("date").alias("date")))
    decisions = t.ticks.select("symbol", F.col("ts").cast("date").alias("date")).distinct().join(days, "date")
    return spans.usable_before_open(decisions, t.ticks.select("symbol", F.col("ts").alias("captured_at"), F.col("price").alias("value")), days)


@query("I7_membership_intervals", uses="trades", sql="""
, m AS (SELECT DISTINCT l_returnflag AS index_name, CAST(date_trunc('month', ts) AS DATE) AS date, symbol FROM trades WHERE qty > 40),
d AS (SELECT index_name, date, dense_rank() OVER (PARTITION BY index_name ORDER BY date) AS no FROM m),
r AS (SELECT m.*, d.no - row_number() OVER (PARTITION BY m.index_name, symbol ORDER BY m.date) AS run, d.no FROM m JOIN (SELECT DISTINCT * FROM d) d ON m.index_name = d.index_name AND m.date = d.date)
, g AS (SELECT index_name, symbol, min(date) AS joined, max(no) AS last_no FROM r GROUP BY index_name, symbol, run)
SELECT g.index_name, symbol, joined, x.date AS exited FROM g LEFT JOIN (SELECT DISTINCT * FROM d) x ON x.index_name = g.index_name AND x.no = g.last_no + 1""")
def _(t):
    snaps = t.trades.where("qty > 40").select(F.col("l_returnflag").alias("index_name"), F.date_trunc("month", "ts").cast("date").alias("date"), "symbol")
    return spans.membership_intervals(snaps)


@query("U5_roster_diff", uses="trades", sql="""
, a AS (SELECT DISTINCT l_suppkey AS symbol FROM trades WHERE qty = 50 AND year(ts) = 2000), b AS (SELECT DISTINCT l_suppkey AS symbol FROM trades WHERE qty = 50 AND year(ts) = 1999)
SELECT symbol, 'JOIN' AS change FROM a WHERE symbol NOT IN (SELECT symbol FROM b) UNION ALL SELECT symbol, 'EXIT' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""")
def _(t):
    roster = lambda y: t.trades.where((F.col("qty") == 50) & (F.year("ts") == y)).select(F.col("l_suppkey").alias("symbol"))
    return spans.roster_diff(roster(2000), roster(1999))


@query("F12_add_sessions", uses="bars_w sessions_w", sql="""
SELECT symbol, b.date, n.date AS valid_until FROM bars_w b JOIN sessions_w s ON b.date = s.date LEFT JOIN sessions_w n ON n.idx = s.idx + 5""")
def _(t):
    return calendar.add_sessions(t.bars_w.select("symbol", "date"), t.sessions_w, 5)
