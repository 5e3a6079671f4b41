"""Queries for universe predicates, sorts, set operations and scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourse.functions import normal, scalar
from bourse.functions.frames import clamp, ratio
from bourse.operators import calendar, universe
from bourse.operators import indicators as ind
from bourse.operators.outcomes import latest_per_key
from bourse.plans.registry import query
from bourse.plans.sqltext import frame, over, prev, rolled


@query("P1_universe_mask", uses="bars_s", sql=f"""
SELECT symbol, date, close >= 850 AND coalesce({rolled('avg(close * volume)', 'close', 20, 15)} >= 150000, false) AND count(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) >= 24 AS eligible FROM bars_s""")
def _(t):
    return universe.universe_mask(t.bars_s, 850, 150000, 24).select("symbol", "date", "eligible")


@query("P2_restrict_tradeable", sql="""
SELECT c_custkey AS symbol, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey * 3 FROM supplier) AND c_custkey IN (SELECT o_custkey FROM orders)""")
def _(t):
    master = t.supplier.select((F.col("s_suppkey") * 3).alias("symbol"))
    return universe.restrict_tradeable(t.customer.select(F.col("c_custkey").alias("symbol"), "c_name"), master, t.orders.select(F.col("o_custkey").alias("symbol")))


LIQUID = """, liq AS (SELECT symbol, avg(close * volume) AS adt FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars_s) WHERE rn <= 20 GROUP BY 1 HAVING avg(close * volume) >= 150000)"""


@query("P3_liquid_symbols", uses="bars_s", doubles="adt", sql=LIQUID + "SELECT * FROM liq")
def _(t):
    return universe.liquid_symbols(t.bars_s, 150000)


@query("P4_post_exit", uses="bars_s deals", sql="""
, a AS (SELECT symbol, max(date) AS last_bar FROM bars_s GROUP BY 1), b AS (SELECT symbol, max(date) AS last_trade FROM deals WHERE side = 'BUY' AND qty < 5 GROUP BY 1)
SELECT a.symbol, last_bar, last_trade FROM a JOIN b ON a.symbol = b.symbol WHERE last_bar > last_trade + 30""")
def _(t):
    return universe.post_exit(t.bars_s, t.deals.where("side = 'BUY' AND qty < 5"), 30)


@query("P5_valid_observation", uses="bars_s", sql="""
, b AS (SELECT symbol, date, open, high, low, close, CASE WHEN month(date) = 5 THEN 0.0 ELSE volume END AS volume, month(date) = 5 AS shut FROM bars_s),
f AS (SELECT symbol, date, CASE WHEN shut THEN close ELSE open END AS open, CASE WHEN shut THEN close ELSE high END AS high, CASE WHEN shut THEN close ELSE low END AS low, close, volume FROM b),
k AS (SELECT date FROM f GROUP BY date HAVING count(*) > 50 AND avg(CASE WHEN volume = 0 AND open = high AND high = low AND low = close THEN 1.0 ELSE 0 END) >= 0.95)
SELECT symbol, f.date, CASE WHEN symbol NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 1000) THEN 'UNLISTED' WHEN f.date > DATE '2001-06-01' AND symbol IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 3) THEN 'POST_EXIT'
  WHEN month(f.date) = 8 THEN 'HOLIDAY' WHEN f.date IN (SELECT date FROM k) THEN 'CLOSED_SESSION' END AS reject_reason FROM f""")
def _(t):
    shut = F.month("date") == 5
    bars = t.bars_s.select("symbol", "date", *[F.when(shut, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")], "close", F.when(shut, 0.0).otherwise(F.col("volume")).alias("volume"))
    name = F.concat(F.lit("S"), "s_suppkey").alias("symbol")
    exits = t.supplier.where("s_nationkey = 3").select(name, F.to_date(F.lit("2001-06-01")).alias("last_trade"))
    return universe.valid_observation(bars, t.supplier.where("s_acctbal > 1000").select(name), exits, t.sessions_m.where("month(date) = 8")).select("symbol", "date", "reject_reason")


@query("P6_finite_only", uses="bars_s", doubles="a b", sql="""
SELECT symbol, date, CASE WHEN n > 1 THEN close / (n - 1) END AS a, CASE WHEN n <> 3 THEN volume END AS b FROM bars_s""")
def _(t):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    rows = t.bars_s.select("symbol", "date", F.when(F.col("n") > 1, F.col("close") / (F.col("n") - 1)).otherwise(inf).alias("a"), F.when(F.col("n") == 3, nan).otherwise(F.col("volume")).alias("b"))
    return universe.finite_only(rows, ["a", "b"])


@query("P7_session_filter", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, isodow(o_orderdate) < 6 AND NOT (month(o_orderdate) = 12 AND day(o_orderdate) = 25) AS is_session FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return universe.session_filter(rows, rows.where("month(date) = 12 AND day(date) = 25").select("date").distinct())


@query("P8_on_grid", uses="ticks", sql="SELECT event_id, symbol FROM ticks WHERE minute(ts) % 15 = 0 AND second(ts) = 0")
def _(t):
    return universe.on_grid(t.ticks, 15).select("event_id", "symbol")


@query("P9_screen", sql="SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 5000 AND c_nationkey >= 5")
def _(t):
    return universe.screen(t.customer, {"c_acctbal": (0, 5000), "c_nationkey": (5, None), "c_name": (None, None)}).select("c_custkey")


COV = "SELECT symbol, date, CASE WHEN n > 3 THEN close END AS a, CASE WHEN n > 8 THEN volume END AS b, CASE WHEN date < DATE '2000-01-01' THEN close END AS c, 1.0 AS d FROM bars_s"


def _sparse(t):
    return t.bars_s.select("symbol", "date", F.when(F.col("n") > 3, F.col("close")).alias("a"), F.when(F.col("n") > 8, F.col("volume")).alias("b"),
                           F.when(F.col("date") < "2000-01-01", F.col("close")).alias("c"), F.lit(1.0).alias("d"))


@query("P10_coverage_gate", uses="bars_s", doubles="coverage", sql=f"""
, x AS ({COV}) SELECT 'a' AS "column", count(a) / count(*) AS coverage, count(a) AS filled, count(a) / count(*) >= 0.5 AS passes FROM x
UNION ALL SELECT 'b', count(b) / count(*), count(b), count(b) / count(*) >= 0.5 FROM x UNION ALL SELECT 'c', count(c) / count(*), count(c), count(c) / count(*) >= 0.5 FROM x UNION ALL SELECT 'd', count(d) / count(*), count(d), true FROM x""")
def _(t):
    return universe.coverage(_sparse(t), ["a", "b", "c", "d"], 0.5)


@query("P11_drop_untrainable", uses="bars_s", doubles="share std", sql=f"""
, x AS ({COV}), l AS (SELECT date, 'a' AS "column", a AS v FROM x UNION ALL SELECT date, 'b', b FROM x UNION ALL SELECT date, 'c', c FROM x UNION ALL SELECT date, 'd', CAST(d AS DOUBLE) FROM x),
s AS (SELECT "column", count(v) / count(*) AS share, coalesce(stddev_samp(v), 0) AS std, count(v) FILTER (WHERE date >= DATE '2001-01-01') AS recent, min(v) = max(v) AS k FROM l GROUP BY 1)
SELECT "column", share, std, recent, CASE WHEN share < 0.2 THEN 'SPARSE' WHEN coalesce(k, true) THEN 'FEW_VALUES' WHEN std < 1e-6 THEN 'NO_SPREAD' WHEN recent = 0 THEN 'NOT_WRITTEN' END AS drop_reason FROM s""")
def _(t):
    return universe.untrainable(_sparse(t), ["a", "b", "c", "d"], F.col("date") >= "2001-01-01", 0.2, 2, 1e-6)


@query("P12_restricted_exclude", uses="bars_s", sql="""
SELECT symbol, date FROM bars_s b WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'S' || s_suppkey = b.symbol AND s_nationkey % 4 >= 2
  AND b.date >= DATE '1997-01-01' AND (s_acctbal >= 5000 OR b.date <= DATE '1999-12-31'))""")
def _(t):
    flags = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), (F.col("s_nationkey") % 4).alias("stage"), F.to_date(F.lit("1997-01-01")).alias("from_date"),
                              F.when(F.col("s_acctbal") < 5000, F.to_date(F.lit("1999-12-31"))).alias("to_date"))
    return universe.restricted_exclude(t.bars_s.select("symbol", "date"), flags, 2)


STAGE_TEXT = "CASE s_suppkey % 6 WHEN 0 THEN 'Graded Measure - Stage IV' WHEN 1 THEN 'GSM stage II and more' WHEN 2 THEN 'Shortlisted' WHEN 3 THEN 'Stage 0' WHEN 4 THEN 'stage 3' END"


@query("P13_surveillance_stage", sql="SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS stage FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", scalar.surveillance_stage(F.expr(STAGE_TEXT)).alias("stage"))


@query("P14_ensure_grid", uses="bars_s", doubles="close volume", sql=LIQUID + """
SELECT liq.symbol, DATE '2000-03-01' AS date, close, volume, close IS NOT NULL AS observed FROM liq LEFT JOIN bars_s b ON b.symbol = liq.symbol AND b.date = DATE '2000-03-01'""")
def _(t):
    return universe.ensure_grid(t.bars_s, universe.liquid_symbols(t.bars_s, 150000), F.to_date(F.lit("2000-03-01")))


@query("X1_global_topk", doubles="score", sql="SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders ORDER BY score DESC NULLS LAST, o_orderkey LIMIT 25")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), "o_orderkey").limit(25)


@query("X2_topk_per_group", doubles="o_totalprice", sql="""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def _(t):
    from bourse.operators.sets import topk_per_group
    return topk_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("X3_topn_groups", uses="bars_m sectors", doubles="avg_score", sql="SELECT sector, avg(close) AS avg_score, count(*) AS members FROM bars_m JOIN sectors USING (symbol) GROUP BY 1 HAVING count(*) >= 50 ORDER BY avg_score DESC, sector LIMIT 3")
def _(t):
    return t.bars_m.join(t.sectors, "symbol").groupBy("sector").agg(F.avg("close").alias("avg_score"), F.count("*").alias("members")).where("members >= 50").orderBy(F.desc("avg_score"), "sector").limit(3)


@query("X4_keyset_page", sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1999-06-01' OR (CAST(o_orderdate AS DATE) = DATE '1999-06-01' AND o_orderkey > 7000) ORDER BY day DESC, o_orderkey LIMIT 40")
def _(t):
    from bourse.operators.sets import keyset_page
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return keyset_page(rows, "day", "o_orderkey", F.to_date(F.lit("1999-06-01")), 7000, 40)


@query("X5_percent_cut", uses="bars_s", sql="""
SELECT symbol, date FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS rn, count(*) OVER (PARTITION BY date) AS c FROM bars_s) WHERE rn <= greatest(1, ceil(CAST(0.07 AS DOUBLE) * c))""")
def _(t):
    from bourse.operators.sets import percent_cut
    return percent_cut(t.bars_s, "volume", 0.07).select("symbol", "date")


@query("X6_first_appearance", uses="outcomes", sql="SELECT screener_id, symbol, min(date) AS date FROM outcomes WHERE p > 0.6 GROUP BY 1, 2 HAVING min(date) >= DATE '1996-01-01'")
def _(t):
    from bourse.operators.sets import first_appearance
    return first_appearance(t.outcomes.where("p > 0.6"), ["screener_id", "symbol"], F.to_date(F.lit("1996-01-01")))


@query("U1_union_all_sources", doubles="score", sql="""
SELECT 'A' AS source, c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT 'B', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'C', p_partkey, p_retailprice FROM part UNION ALL SELECT 'D', n_nationkey, NULL FROM nation""")
def _(t):
    from bourse.operators.sets import union_sources
    return union_sources({
        "A": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), "B": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")),
        "C": t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), "D": t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"))})


@query("U2_union_distinct", sql="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("U3_intersect", sql="SELECT l_suppkey AS symbol FROM lineitem WHERE l_returnflag = 'N' AND l_quantity = 50 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity = 1 AND l_discount > 0.05")
def _(t):
    pick = lambda cond: t.lineitem.where(cond).select(F.col("l_suppkey").alias("symbol"))
    return pick("l_returnflag = 'N' AND l_quantity = 50").intersect(pick("l_returnflag = 'R' AND l_quantity = 49")).intersect(pick("l_quantity = 1 AND l_discount > 0.05"))


@query("U4_except", sql="SELECT c_custkey AS symbol FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("symbol")).exceptAll(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("symbol")).distinct())


@query("F1_parse_money_size", doubles="a b c d", sql="SELECT o_orderkey, floor(o_totalprice) AS a, floor(o_totalprice / 10) / 100 * 1e6 AS b, -round(o_totalprice, 2) AS c, NULL AS d FROM orders")
def _(t):
    price = F.col("o_totalprice")
    texts = {"a": F.format_number(F.floor(price), 0), "b": F.concat((F.floor(price / 10) / 100).cast("decimal(20,2)").cast("string"), F.lit("m")),
             "c": F.concat(F.lit(" -"), F.round(price, 2).cast("decimal(20,2)").cast("string")), "d": F.lit("NA")}
    return t.orders.select("o_orderkey", *[scalar.parse_number(v).alias(k) for k, v in texts.items()])


@query("F2_round_half", doubles="as_decimal as_js", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(CAST(-l_quantity AS DECIMAL(18,6)) / 4, 1) AS DOUBLE) AS as_decimal, floor(-l_quantity / 4 * 10 + 0.5) / 10 AS as_js FROM lineitem""")
def _(t):
    q = -F.col("l_quantity") / 4
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", scalar.round_decimal(q, 1).alias("as_decimal"), scalar.round_js(q, 1).alias("as_js"))


@query("F3_ratio_clamp_lerp", doubles="r c l", sql="""
SELECT c_custkey, c_acctbal / nullif(c_nationkey, 0) AS r, least(greatest(c_acctbal, 0), 5000) AS c, 10 + (20 - 10) * c_nationkey / 24.0 AS l FROM customer""")
def _(t):
    return t.customer.select("c_custkey", ratio("c_acctbal", "c_nationkey").alias("r"), clamp("c_acctbal", 0.0, 5000.0).alias("c"),
                             scalar.lerp(F.lit(10.0), F.lit(20.0), F.col("c_nationkey") / 24.0).alias("l"))


@query("F4_growth", doubles="pct cagr rev", sql="""
, a AS (SELECT o_custkey, o_orderkey, o_totalprice - 250000 AS now, lag(o_totalprice - 250000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_orderkey, 100 * (now - before) / nullif(abs(before), 0) AS pct, CASE WHEN now > 0 AND before > 0 THEN (pow(now / before, 1 / 3.0) - 1) * 100 END AS cagr,
  CASE WHEN sign(now) = sign(before) AND abs(now / before - 1) <= 1 THEN now / before - 1 END AS rev FROM a""")
def _(t):
    now = F.col("o_totalprice") - 250000
    rows = t.orders.select("o_orderkey", now.alias("now"), F.lag(now).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    return rows.select("o_orderkey", scalar.pct_change_abs("now", "before").alias("pct"), scalar.cagr("now", "before", 3).alias("cagr"), scalar.bounded_revision("now", "before").alias("rev"))


def _horner(factors, x: str) -> str:
    out = repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r})"
    return out


@query("F5_normal_cdf", uses="preds", doubles="cdf bet_size", sql=f"""
, z AS (SELECT doc_id, (p - 0.5) / 0.2 AS x, abs((p - 0.5) / 0.2) AS a FROM preds),
c AS (SELECT doc_id, x, exp(-a * a / 2) * {_horner(normal.TAIL_TOP, 'a')} / {_horner(normal.TAIL_BOTTOM, 'a')} AS tail FROM z),
d AS (SELECT doc_id, CASE WHEN x > 0 THEN 1 - tail ELSE tail END AS cdf FROM c) SELECT doc_id, cdf, 2 * cdf - 1 AS bet_size FROM d""")
def _(t):
    """The same rational form in both; against math.erf in the tests."""
    return t.preds.select("doc_id", normal.cdf((F.col("p") - 0.5) / 0.2).alias("cdf"), (2 * normal.cdf((F.col("p") - 0.5) / 0.2) - 1).alias("bet_size"))


@query("F6_strings", sql="SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '-' || p_type || '!! '), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", scalar.title_key(F.concat(F.lit("  "), "p_name", F.lit("-"), "p_type", F.lit("!! "))).alias("key"))


@query("F7_regex_extract", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE year(o_orderdate) END AS fy FROM orders")
def _(t):
    y = F.year("o_orderdate").cast("string")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FY"), y)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Results Mar "), y)).otherwise("no label")
    return t.orders.select("o_orderkey", scalar.fiscal_year(label).alias("fy"))


@query("F8_string_agg", sql="SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("F9_multi_format_dates", sql="""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN last_day(CAST(o_orderdate AS DATE)) WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed,
  CASE WHEN o_orderkey % 6 = 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '22 hours 37 minutes' END AS at FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    text = (F.when(F.col("o_orderkey") % 6 == 0, F.date_format(d, "d MMM, yyyy")).when(F.col("o_orderkey") % 6 == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(F.col("o_orderkey") % 6 == 2, F.concat(F.upper(F.date_format(d, "dd-MMM-yyyy")), F.lit(" 22:37"))).when(F.col("o_orderkey") % 6 == 3, F.date_format(d, "dd MMM yyyy"))
            .when(F.col("o_orderkey") % 6 == 4, F.upper(F.date_format(d, "MMM yyyy"))).otherwise("soon"))
    return t.orders.select("o_orderkey", scalar.parse_date(text).alias("parsed"), scalar.parse_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("F10_calendar_ends", sql="""
, a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS quarter_end, last_day(make_date(year(d) + CASE WHEN month(d) > 3 THEN 1 ELSE 0 END, 3, 1)) AS fiscal_end,
  CAST(last_day(d) - CAST((isodow(last_day(d)) - 4 + 7) % 7 AS INTEGER) AS DATE) AS last_thursday FROM a""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", scalar.quarter_end(d).alias("quarter_end"), scalar.fiscal_year_end(d).alias("fiscal_end"), scalar.last_weekday_of_month(d, "Thu").alias("last_thursday"))


@query("F11_session_date", uses="ticks", sql="""
SELECT event_id, CAST(CAST(ts + INTERVAL '5 hours 30 minutes' AS DATE) - CASE WHEN hour(ts + INTERVAL '5 hours 30 minutes') < 9 THEN 1 ELSE 0 END AS DATE) AS session FROM ticks""")
def _(t):
    return t.ticks.select("event_id", calendar.session_date(F.col("ts")).alias("session"))


@query("F13_trading_days_stale", sql="""
SELECT o_orderkey, (SELECT count(*) FROM range(1, 4000) r(k) WHERE k <= date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AND isodow(CAST(o_orderdate AS DATE) + CAST(k AS INTEGER)) < 6) AS stale FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", calendar.weekdays_between(F.col("o_orderdate").cast("date"), F.to_date(F.lit("2001-12-31"))).alias("stale"))


@query("F14_json", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderpriority ELSE 'UNKNOWN' END AS first_type, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderpriority || ',' || o_orderstatus END AS types FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 3, "[{oops").otherwise(F.concat(F.lit('[{"type":"'), "o_orderpriority", F.lit('"},{"type":"'), "o_orderstatus", F.lit('","x":1}]')))
    listed = F.from_json(text, "array<struct<type:string>>")
    types = F.filter(F.transform(listed, lambda s: s["type"]), lambda x: x.isNotNull())
    return t.orders.select("o_orderkey", F.coalesce(F.get(types, F.lit(0)), F.lit("UNKNOWN")).alias("first_type"), F.when(F.size(types) > 0, F.array_join(types, ",")).alias("types"))


@query("F15_array_folds", sql="SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END)), 0) AS BIGINT) AS weighted, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS has_big FROM embeddings")
def _(t):
    positive = F.transform("embedding", lambda x, i: F.when(x > 0, i + 1).otherwise(0))
    return t.embeddings.select("vec_id", F.aggregate(positive, F.lit(0), lambda a, x: a + x).cast("bigint").alias("weighted"), F.exists("embedding", lambda x: x > 0.3).alias("has_big"))


@query("F16_map_lookup", doubles="w", sql="SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2.0 WHEN '2-HIGH' THEN 1.5 ELSE 1.0 END AS w FROM orders")
def _(t):
    table = F.create_map(F.lit("1-URGENT"), F.lit(2.0), F.lit("2-HIGH"), F.lit(1.5))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(table, F.col("o_orderpriority")), F.lit(1.0)).alias("w"))


@query("F17_buckets_and_labels", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'untradable' WHEN c_acctbal < 5000 THEN 'thin' ELSE 'ok' END AS tier, CASE WHEN c_acctbal >= 8000 THEN 'A' WHEN c_acctbal >= 4000 THEN 'B' WHEN c_acctbal >= 0 THEN 'C' END AS bucket,
  CASE c_nationkey % 4 WHEN 0 THEN 'SWING' WHEN 1 THEN 'INTRADAY' WHEN 2 THEN 'LONG_TERM' ELSE 'POSITIONAL' END AS horizon FROM customer""")
def _(t):
    raw = F.when(F.col("c_nationkey") % 4 == 0, " short term").when(F.col("c_nationkey") % 4 == 1, "day").when(F.col("c_nationkey") % 4 == 2, "Long-Term").otherwise("?")
    return t.customer.select("c_custkey", scalar.liquidity_tier(F.col("c_acctbal") / 1000).alias("tier"), scalar.bucket("c_acctbal", [0, 4000, 8000], ["C", "B", "A"]).alias("bucket"), scalar.canonical_horizon(raw).alias("horizon"))


@query("F18_content_hash", sql="SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS id FROM orders")
def _(t):
    return t.orders.select("o_orderkey", scalar.content_id(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("id"))


@query("F19_half_life", uses="outcomes", doubles="half_life_days", sql="""
, b AS (SELECT screener_id, floor(date_diff('day', date, DATE '2001-12-31') / 365) AS bucket, avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0 END) AS wr FROM outcomes WHERE outcome <> 'PENDING' GROUP BY 1, 2 HAVING count(*) >= 5),
s AS (SELECT screener_id, regr_slope(ln(wr), bucket) AS k FROM b WHERE wr > 0 GROUP BY 1 HAVING count(*) >= 3)
SELECT screener_id, CASE WHEN k < 0 THEN ln(2) / -k * 365 END AS half_life_days FROM s""")
def _(t):
    from bourse.operators.sets import half_life
    return half_life(t.outcomes.where("outcome <> 'PENDING'"), "screener_id", F.to_date(F.lit("2001-12-31")), 365)


@query("F20_trade_geometry", uses="bars_w", doubles="target stop rr", sql=f"""
, a AS (SELECT symbol, date, close, {rolled('avg(high - low)', 'close', 14)} AS atr FROM bars_w),
b AS (SELECT symbol, date, close, coalesce(CASE WHEN atr > 0 THEN atr / close END, 0) AS s FROM a)
SELECT symbol, date, close * (1 + least(greatest(2.5 * s, 0.03), 0.15)) AS target, close * (1 - least(greatest(1.5 * s, 0.02), 0.08)) AS stop,
  least(greatest(2.5 * s, 0.03), 0.15) / least(greatest(1.5 * s, 0.02), 0.08) AS rr FROM b""")
def _(t):
    from bourse.functions.frames import roll
    rows = t.bars_w.withColumn("atr", roll(F.avg, F.col("high") - F.col("low"), ind.per_symbol(), 14))
    target, stop = scalar.atr_levels("close", "atr", F.lit(True), digits=None)
    rows = rows.withColumns({"target": target, "stop": stop})
    return rows.select("symbol", "date", "target", "stop", scalar.reward_risk("close", "stop", "target").alias("rr"))
