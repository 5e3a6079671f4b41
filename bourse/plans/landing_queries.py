"""Queries for landing, upserts and data quality."""

from pyspark.sql import functions as F

from bourse.operators import quality as q
from bourse.operators import indicators as ind
from bourse.operators.asof import band_join
from bourse.plans.prep_queries import ACTIONS, DERIVE, actions, derived
from bourse.plans.registry import query
from bourse.plans.sqltext import P, prev
from bourse.sources import landing as ld


@query("A1_read_bars", doubles="l_extendedprice", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate <= DATE '1997-06-30' AND l_extendedprice > 0 AND l_returnflag <> 'R'""")
def _(t):
    """The range comparison is on the stored column, so it reaches the scan."""
    rows = t.lineitem.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") <= F.lit("1997-06-30").cast("timestamp_ntz")) & (F.col("l_extendedprice") > 0) & (F.col("l_returnflag") != "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))


@query("A2_land_exchange_csv", uses="bars_w", doubles="open high low close", sql="""
SELECT date, symbol, 'EQ' AS series, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM (SELECT symbol, date, open, high, CASE WHEN n % 4 = 0 THEN NULL ELSE low END AS low, close, volume, n FROM bars_w) WHERE n % 3 <> 0""")
def _(t):
    """A padded day file written from the weekly bars and landed again."""
    from bourse.streaming.sinks import work_folder
    folder = work_folder(t.spark, "csv")
    pad = lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit(" "))
    cells = {"SYMBOL": F.col("symbol"), " SERIES": pad(F.when(F.col("n") % 3 == 0, "GB").otherwise("EQ")), " DATE1": pad(F.date_format("date", "dd-MMM-yyyy")), " OPEN_PRICE": pad(F.col("open")), " HIGH_PRICE": pad(F.col("high")),
             " LOW_PRICE": F.when(F.col("n") % 4 == 0, " -").otherwise(pad(F.col("low"))), " CLOSE_PRICE": pad(F.col("close")), " TTL_TRD_QNTY": pad(F.col("volume").cast("bigint"))}
    t.bars_w.select(*[c.alias(n) for n, c in cells.items()]).write.csv(folder, header=True)
    return ld.land_exchange_csv(t.spark, folder, {"DATE1": ("date", "date"), "SYMBOL": ("symbol", "string"), "SERIES": ("series", "string"), "OPEN_PRICE": ("open", "double"), "HIGH_PRICE": ("high", "double"), "LOW_PRICE": ("low", "double"), "CLOSE_PRICE": ("close", "double"), "TTL_TRD_QNTY": ("volume", "long")})


@query("A3_land_two_layouts", doubles="close", sql="""
SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, CAST(l_quantity AS BIGINT) AS oi, l_linestatus AS kind FROM lineitem WHERE l_shipdate < DATE '1998-01-01'
UNION ALL SELECT 'S' || l_suppkey, CAST(l_shipdate AS DATE), l_extendedprice, CAST(l_quantity AS BIGINT), NULL FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'""")
def _(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = t.lineitem.where(F.col("l_shipdate") < cut).select(F.col("l_suppkey").alias("SYMBOL"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("TIMESTAMP"), F.col("l_extendedprice").cast("string").alias("CLOSE"), F.col("l_quantity").alias("OPEN_INT"), F.col("l_linestatus").alias("INSTRUMENT"))
    new = t.lineitem.where(F.col("l_shipdate") >= cut).select(F.col("l_suppkey").alias("TckrSymb"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("TradDt"), F.col("l_extendedprice").alias("ClsPric"), F.col("l_quantity").alias("OpnIntrst"))
    s = lambda c: F.concat(F.lit("S"), F.col(c))
    return ld.land_two_layouts(old, new,
                               {"symbol": s("SYMBOL"), "date": F.to_date("TIMESTAMP", "dd-MMM-yyyy"), "close": F.col("CLOSE").cast("double"), "oi": F.col("OPEN_INT").cast("bigint"), "kind": F.col("INSTRUMENT")},
                               {"symbol": s("TckrSymb"), "date": F.to_date("TradDt"), "close": F.col("ClsPric"), "oi": F.col("OpnIntrst").cast("bigint")})


@query("A4_land_positional_table", doubles="price", sql="SELECT o_custkey, o_orderkey AS id, o_totalprice AS price, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders")
def _(t):
    """Every third customer's payload lists its columns in another order and lacks the status."""
    full = '{"tableHeaders":[{"unique_name":"id"},{"unique_name":"price"},{"unique_name":"status"}],"tableData":['
    thin = '{"tableHeaders":[{"unique_name":"price"},{"unique_name":"id"}],"tableData":['
    row = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("["), F.col("o_totalprice").cast("string"), F.lit(","), F.col("o_orderkey").cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_totalprice").cast("string"), F.lit(',"'), "o_orderstatus", F.lit('"]')))
    pages = t.orders.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.array_join(F.collect_list(row), ",").alias("rows")).select(
        "o_custkey", F.concat(F.when(F.col("o_custkey") % 3 == 0, thin).otherwise(full), "rows", F.lit("]}")).alias("payload"))
    return ld.land_positional_table(pages, "payload", {"id": ("id", "bigint"), "price": ("price", "double"), "status": ("status", "string")})


@query("A5_explode_statement", doubles="value", sql="""
SELECT c_custkey, 0 AS level, 'Revenue' AS line_item, 'q1' AS period, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 0, 'Revenue', 'q2', 2.0 FROM customer
UNION ALL SELECT c_custkey, 1, 'Domestic', 'q1', 1234.5 FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment, 'q2', c_nationkey FROM customer""")
def _(t):
    text = F.concat(F.lit('[{"line_item":"Revenue","q1":"'), F.col("c_acctbal").cast("string"), F.lit('","q2":"2","items":[{"line_item":"Domestic","q1":"1,234.5","items":[{"line_item":"'), "c_mktsegment", F.lit('","q1":"-","q2":"'), F.col("c_nationkey").cast("string"), F.lit('"}]}]}]'))
    return ld.explode_statement(t.customer.select("c_custkey", text.alias("payload")), "payload", ["q1", "q2"])


@query("Y6_flatten_statement", sql="SELECT c_custkey, 0 AS level, 'Revenue' AS line_item, 'q1' AS period, CAST(c_nationkey AS VARCHAR) AS raw FROM customer UNION ALL SELECT c_custkey, 1, 'Domestic', 'q2', c_mktsegment FROM customer")
def _(t):
    ld.register_flatten_statement(t.spark)
    text = F.concat(F.lit('[{"line_item":"Revenue","q1":'), F.col("c_nationkey").cast("string"), F.lit(',"items":[{"line_item":"Domestic","q2":"'), "c_mktsegment", F.lit('"}]}]'))
    t.customer.select("c_custkey", text.alias("payload")).createOrReplaceTempView("statement_payloads")
    return t.spark.sql("SELECT c_custkey, f.* FROM statement_payloads, LATERAL flatten_statement(payload) f")


UPS = """
, tg AS (SELECT o_custkey AS symbol, max(o_totalprice) AS value, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE max(o_orderpriority) END AS note FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
up AS (SELECT o_custkey AS symbol, arg_max(o_totalprice, o_orderkey) AS value, arg_max(o_orderstatus, o_orderkey) AS note FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
fj AS (SELECT coalesce(tg.symbol, up.symbol) AS symbol, tg.symbol IS NOT NULL AS ht, up.symbol IS NOT NULL AS hu, tg.value AS tv, up.value AS uv, tg.note AS tn, up.note AS un FROM tg FULL JOIN up ON tg.symbol = up.symbol)"""


def _upsert(t, mode):
    target = t.orders.where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_totalprice").alias("value"), F.max("o_orderpriority").alias("note")).withColumn("note", F.when(F.col("symbol") % 4 != 0, F.col("note")))
    updates = t.orders.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("note"), "o_orderkey")
    return ld.merge_upsert(target, updates, ["symbol"], "o_orderkey", mode)


for _mode, _value, _note in (("update", "CASE WHEN hu THEN uv ELSE tv END", "CASE WHEN hu THEN un ELSE tn END"), ("ignore", "CASE WHEN ht THEN tv ELSE uv END", "CASE WHEN ht THEN tn ELSE un END"), ("fill_gaps", "coalesce(tv, uv)", "coalesce(tn, un)")):
    query(f"A6_merge_upsert_{_mode}", doubles="value", sql=UPS + f"SELECT symbol, {_value} AS value, {_note} AS note FROM fj")(lambda t, m=_mode: _upsert(t, m))


@query("A7_append_changes_only", sql="""
, u AS (SELECT o_custkey AS symbol, o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), h AS (SELECT o_custkey AS symbol, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 5 <> 0 GROUP BY 1),
l AS (SELECT u.*, lag(v) OVER (PARTITION BY u.symbol ORDER BY k) AS b, row_number() OVER (PARTITION BY u.symbol ORDER BY k) AS rn, h.symbol AS hs, s FROM u LEFT JOIN h ON h.symbol = u.symbol)
SELECT symbol, k, v FROM l WHERE CASE WHEN rn > 1 THEN v IS DISTINCT FROM b ELSE hs IS NULL OR v IS DISTINCT FROM s END""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return ld.append_changes_only(rows.where("k % 2 = 1 AND symbol % 5 <> 0"), rows.where("k % 2 = 0"), ["symbol"], "v", "k")


@query("A8_append_after_high_water", sql="""
SELECT o_orderkey, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders o WHERE o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) > coalesce((SELECT max(CAST(o_orderdate AS DATE)) FROM orders h WHERE h.o_orderkey % 2 = 1 AND h.o_custkey = o.o_custkey), DATE '1900-01-01')""")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
    return ld.append_after_high_water(rows.where("o_orderkey % 2 = 1"), rows.where("o_orderkey % 2 = 0"), ["symbol"], "date")


@query("A9_replace_partition", doubles="value", sql="""
SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN year(o_orderdate) = 1998 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders""")
def _(t):
    """Three partitions written, one of them replaced by a second batch."""
    from bourse.streaming.sinks import work_folder
    folder = work_folder(t.spark, "partitions")
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("value"))
    ld.replace_partition(rows, folder, ["y"])
    ld.replace_partition(rows.where("y = 1998").withColumn("value", -F.col("value")), folder, ["y"])
    return t.spark.read.parquet(folder)


@query("A10_snapshot_with_manifest", sql="""
SELECT 'supplier' AS "table", '2001-12-31' AS as_of, count(*) AS rows, count(*) > 100 AS over_budget FROM supplier UNION ALL SELECT 'part', '2001-12-31', count(*), count(*) > 100 FROM part""")
def _(t):
    from bourse.streaming.sinks import work_folder
    manifest = ld.snapshot_with_manifest(t.spark, {"supplier": t.supplier, "part": t.part}, "2001-12-31", work_folder(t.spark, "snapshot"), 100)
    return manifest.drop("hash")


@query("A10_content_hash")
def _(t):
    return ld.content_hash(t.orders)


@query("A11_completeness_watermark", uses="ticks", sql="""
, g AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE price <= 60) AS accepted, count(*) FILTER (WHERE NOT price <= 60) AS rejected, min(event_id) AS first_event, max(event_id) AS last_event FROM ticks GROUP BY 1)
SELECT day, 330 AS expected, 'ticks' AS dataset, accepted, rejected, first_event, last_event, accepted >= 330 AS complete FROM g""")
def _(t):
    rows = t.ticks.withColumn("day", F.col("ts").cast("date"))
    expected = rows.select("day").distinct().withColumn("expected", F.lit(330))
    return ld.completeness_watermark("ticks", rows, "day", "event_id", F.col("price") <= 60, expected)


@query("A12_stale_worklist", sql="""
SELECT c_custkey AS symbol, last_done FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_done FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1) ON o_custkey = c_custkey WHERE last_done IS NULL OR last_done < DATE '2001-01-01' ORDER BY last_done NULLS FIRST, symbol LIMIT 300""")
def _(t):
    done = t.orders.where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
    return ld.stale_worklist(t.customer.select(F.col("c_custkey").alias("symbol")), done, F.to_date(F.lit("2001-01-01")), 300)


@query("A13_url_templates", sql="""
, u AS (SELECT url, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segs,
  array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: string_split(p, '=')[1])), ',') AS query_keys FROM pages),
v AS (SELECT *, len(segs) AS segments FROM u), s AS (SELECT host, segments, query_keys, i, min(segs[i]) AS lo, max(segs[i]) AS hi FROM v, range(1, 30) r(i) WHERE i <= segments GROUP BY 1, 2, 3, 4),
p AS (SELECT host, segments, query_keys, string_agg(CASE WHEN lo = hi THEN lo WHEN regexp_matches(lo, '^\\d{4}-\\d{2}-\\d{2}$') THEN '{date}' WHEN regexp_matches(lo, '^1\\d{9}$') THEN '{epoch}' WHEN regexp_matches(lo, '^\\d+$') THEN '{int_id}' ELSE '{string}' END, '/' ORDER BY i) AS path FROM s GROUP BY 1, 2, 3)
SELECT c.host, c.segments, c.query_keys, '/' || coalesce(path, '') AS template, urls FROM (SELECT host, segments, query_keys, count(*) AS urls FROM v GROUP BY 1, 2, 3) c LEFT JOIN p ON p.host = c.host AND p.segments = c.segments AND p.query_keys = c.query_keys""")
def _(t):
    return ld.url_templates(t.pages)


@query("A13_url_params", sql="""
, u AS (SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segs, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '') AS pairs FROM pages),
v AS (SELECT *, len(segs) AS segments, array_to_string(list_sort(list_transform(pairs, lambda p: string_split(p, '=')[1])), ',') AS query_keys FROM u),
p AS (SELECT host, segments, query_keys, 'path' AS location, 'path_' || (i - 1) AS name, segs[i] AS value FROM v, range(1, 30) r(i) WHERE i <= segments
  UNION SELECT host, segments, query_keys, 'query', url_decode(string_split(x, '=')[1]), url_decode(CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END) FROM (SELECT *, unnest(pairs) AS x FROM v)),
g AS (SELECT host, segments, query_keys, location, name, count(*) AS distinct_count, min(value) AS lo, list_sort(list(value))[1 : 5] AS sample_values FROM p GROUP BY ALL), k AS (SELECT DISTINCT upper(CAST(n_nationkey AS VARCHAR)) AS s FROM nation UNION SELECT 'SUBMIT')
SELECT host, segments, query_keys, location, name, CASE WHEN distinct_count = 1 THEN 'const' WHEN trim(lo) = '' THEN 'string' WHEN upper(trim(lo)) IN (SELECT s FROM k) THEN 'ticker' WHEN regexp_matches(lo, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date'
  WHEN regexp_matches(lo, '^\\d+$') THEN CASE WHEN length(lo) = 10 AND TRY_CAST(lo AS BIGINT) BETWEEN 1000000000 AND 2000000000 THEN 'epoch' ELSE 'int_id' END ELSE 'string' END AS inferred_type, distinct_count > 1 AS is_variable, distinct_count, sample_values
FROM g WHERE distinct_count > 1 OR location = 'query'""")
def _(t):
    universe = t.nation.select(F.col("n_nationkey").cast("string").alias("symbol")).union(t.spark.range(1).select(F.lit("submit").alias("symbol")))
    return ld.url_params(t.pages, universe)


@query("A14_url_clean_triage", sql="""
, u AS (SELECT regexp_replace(trim(CASE WHEN page_id % 3 = 0 THEN replace(url, '://', ':////') ELSE url END), '^(https?):/+', '\\1://') AS url FROM pages),
c AS (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/{2,}', '/', 'g') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/{2,}', '/', 'g') END || regexp_extract(url, '(\\?[^#]*)', 1) AS clean FROM u)
SELECT clean, count(*) AS seen, CASE WHEN regexp_matches(clean, '^[a-z]+://m\\.') THEN 'mobile' WHEN regexp_matches(clean, '^[a-z]+://[^/?#]*\\.com/en') THEN 'english' ELSE 'unclassified' END AS family FROM c GROUP BY 1""")
def _(t):
    rows = t.pages.select(F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit(":////"))).otherwise(F.col("url")).alias("url"))
    return ld.url_triage(rows, [("mobile", r"^m\.", ""), ("english", r"\.com$", "^/en")])


@query("A15_profile_json_fields", uses="ticks", doubles="coverage numeric_share min max mean", sql="""
, p AS (SELECT symbol, 'k' AS path, CAST(k AS DOUBLE) AS x, CAST(k AS VARCHAR) AS v FROM ticks UNION ALL SELECT symbol, 'user', CAST(user_id AS DOUBLE), CAST(user_id AS VARCHAR) FROM ticks WHERE user_id % 2 = 0 UNION ALL SELECT symbol, 'name', NULL, symbol FROM ticks), n AS (SELECT symbol, count(*) AS n FROM ticks GROUP BY 1)
SELECT p.symbol, path, count(*) / any_value(n) AS coverage, count(x) / count(*) AS numeric_share, count(DISTINCT v) AS distinct_values, min(x) AS min, max(x) AS max, avg(x) AS mean, path = 'user' AS is_new FROM p JOIN n ON n.symbol = p.symbol GROUP BY 1, 2""")
def _(t):
    text = F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"user":'), F.col("user_id").cast("string"))).otherwise(""), F.lit(',"name":"'), "symbol", F.lit('"}'))
    old = t.ticks.select("symbol", F.explode(F.array(F.lit("k"), F.lit("name"))).alias("path")).distinct()
    return ld.profile_json_fields(t.ticks.select("symbol", text.alias("payload")), "payload", "symbol", old)


@query("A15_profile_nested_fields", uses="ticks", doubles="fill_rate min max mean overlap", sql="""
, p AS (SELECT symbol, 'a.k' AS path, 'number' AS kind, CAST(k AS VARCHAR) AS v, CAST(k AS DOUBLE) AS x, event_id FROM ticks UNION ALL SELECT symbol, 'a.tags', 'string', symbol, NULL, event_id FROM ticks UNION ALL SELECT symbol, 'a.tags.s', 'string', 'u' || user_id, NULL, event_id FROM ticks
  UNION ALL SELECT symbol, 'a.tags.n', 'number', CAST(k + 1 AS VARCHAR), k + 1.0, event_id FROM ticks WHERE user_id % 3 = 0 UNION ALL SELECT symbol, 'a.tags.n', 'string', 'n/a', NULL, event_id FROM ticks WHERE user_id % 3 <> 0
  UNION ALL SELECT symbol, 'user', 'number', CAST(user_id AS VARCHAR), CAST(user_id AS DOUBLE), event_id FROM ticks WHERE user_id % 2 = 0 UNION ALL SELECT symbol, 'flag', 'other', 'true', NULL, event_id FROM ticks UNION ALL SELECT symbol, 'none', 'other', NULL, NULL, event_id FROM ticks),
n AS (SELECT symbol, count(*) AS n FROM ticks GROUP BY 1), known AS (SELECT 'CLICK' AS s UNION SELECT 'U7'),
g AS (SELECT symbol, path, count(*) FILTER (WHERE kind = 'number') AS nums, count(*) FILTER (WHERE kind = 'string') AS texts, count(*) FILTER (WHERE kind = 'string' AND upper(v) IN (SELECT s FROM known)) AS met, count(DISTINCT event_id) AS present, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS cardinality, min(x) AS lo, max(x) AS hi, avg(x) AS m FROM p GROUP BY 1, 2)
SELECT g.symbol, path, CASE WHEN nums > 0 AND nums >= texts THEN 'numeric' WHEN texts > 0 THEN 'string' ELSE 'other' END AS dtype, present / n AS fill_rate, cardinality, CASE WHEN nums > 0 AND nums >= texts THEN lo END AS min, CASE WHEN nums > 0 AND nums >= texts THEN hi END AS max, CASE WHEN nums > 0 AND nums >= texts THEN m END AS mean,
  CASE WHEN texts > 0 THEN met / texts ELSE 0 END AS overlap, path NOT IN ('user', 'a.k') AS is_new FROM g JOIN n ON n.symbol = g.symbol""")
def _(t):
    user, k = F.col("user_id").cast("string"), F.col("k")
    number = F.when(F.col("user_id") % 3 == 0, (k + 1).cast("string")).otherwise('"n/a"')
    tags = F.concat(F.lit('["'), "symbol", F.lit('",{"s":"u'), user, F.lit('","n":'), number, F.lit("}]"))
    text = F.concat(F.lit('{"a":{"k":'), k.cast("string"), F.lit(',"tags":'), tags, F.lit("}"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"user":'), user)).otherwise(""), F.lit(',"flag":true,"none":null}'))
    old = t.ticks.select("symbol", F.explode(F.array(F.lit("user"), F.lit("a.k"))).alias("path")).distinct()
    universe = t.spark.createDataFrame([("Click",), ("U7",)], "symbol string")
    return ld.profile_nested_fields(t.ticks.select("symbol", text.alias("payload")), "payload", "symbol", universe, old)


@query("A16_payload_features", doubles="balance score", sql="SELECT c_custkey AS symbol, c_acctbal AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey * 1.5 END AS score FROM customer")
def _(t):
    one = t.customer.select(F.col("c_custkey").alias("symbol"), F.lit("header").alias("endpoint"), F.concat(F.lit('{"data":{"summary":{"bal":'), F.col("c_acctbal").cast("string"), F.lit("}}}")).alias("payload"))
    two = t.customer.select(F.col("c_custkey").alias("symbol"), F.lit("score").alias("endpoint"), F.when(F.col("c_custkey") % 3 == 0, '{"data":[]}').otherwise(F.concat(F.lit('{"data":{"score":"'), (F.col("c_nationkey") * 1.5).cast("string"), F.lit('"}}'))).alias("payload"))
    return ld.payload_features(one.unionByName(two), {"balance": ("header", "$.data.summary.bal"), "score": ("score", "$.data.score")})


@query("A17_retention", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01')")
def _(t):
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("d"))
    return ld.retention(parents, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "d", F.to_date(F.lit("2000-06-01")))


@query("A18_field_return_correlation", uses="outcomes", doubles="pearson", sql="""
, f AS (SELECT 'S' || s_suppkey AS symbol, 'acctbal' AS field, s_acctbal AS value FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'nation', s_nationkey FROM supplier),
r AS (SELECT symbol, regime AS target, avg(return_pct) AS ret FROM outcomes WHERE outcome <> 'PENDING' GROUP BY 1, 2) SELECT field, target, count(*) AS n, corr(value, ret) AS pearson FROM f JOIN r ON f.symbol = r.symbol GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    s = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.explode(F.array(F.struct(F.lit("acctbal").alias("field"), F.col("s_acctbal").alias("value")), F.struct(F.lit("nation").alias("field"), F.col("s_nationkey").cast("double").alias("value")))).alias("e")).select("symbol", "e.*")
    returns = t.outcomes.where("outcome <> 'PENDING'").groupBy("symbol", F.col("regime").alias("target")).agg(F.avg("return_pct").alias("ret"))
    return ld.field_return_correlation(s, returns, 20)


@query("C1_freshness", sql="""
, d AS (SELECT 'orders' AS "table", CAST(max(o_orderdate) AS DATE) AS last_date, 3 AS w, 6 AS f FROM orders UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE), 100, 200 FROM lineitem UNION ALL SELECT 'events', CAST(max(ts) AS DATE), 3, NULL FROM events),
s AS (SELECT "table", last_date, w, f, (SELECT count(*) FROM range(1, 3000) r(k) WHERE k <= date_diff('day', last_date, DATE '2001-12-31') AND isodow(last_date + CAST(k AS INTEGER)) < 6) AS stale FROM d)
SELECT "table", last_date, stale, CASE WHEN f IS NOT NULL AND stale > f THEN 'fail' WHEN stale > w THEN 'warn' ELSE 'pass' END AS status FROM s""")
def _(t):
    return q.freshness({"orders": (t.orders, "o_orderdate", 3, 6), "lineitem": (t.lineitem, "l_shipdate", 100, 200), "events": (t.events, "ts", 3, None)}, F.to_date(F.lit("2001-12-31")))


@query("C2_range_bounds", sql="""
SELECT 'discount' AS "check", count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) AS bad, count(*) AS total, 'fail' AS status FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE l_quantity <= 0), count(*), 'pass' FROM lineitem""")
def _(t):
    return q.range_bounds(t.lineitem, {"discount": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.05), "quantity": F.col("l_quantity") <= 0})


@query("C3_stuck_value", uses="outcomes", sql="SELECT symbol, count(*) AS total, count(DISTINCT screener_id) <= 1 AS stuck, CASE WHEN count(DISTINCT screener_id) <= 1 AND count(*) > 1 THEN 'fail' ELSE 'pass' END AS status FROM outcomes GROUP BY 1")
def _(t):
    return q.stuck_value(t.outcomes, ["symbol"], "screener_id")


@query("C4_provenance_monotonic", sql="SELECT count(*) FILTER (WHERE o_orderdate > s + INTERVAL 5 MINUTE) AS bad, count(*) AS total, 'fail' AS status FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("timestamp").alias("s"))
    return q.provenance_monotonic(t.orders.join(ship, "o_orderkey").withColumn("g", F.col("o_orderdate").cast("timestamp")), "g", "s")


@query("C5_key_uniqueness", sql="SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return q.key_uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("C5_case_collisions", sql="""
, l AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END AS label FROM part) SELECT lower(label) AS folded, count(*) AS spellings, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return q.case_collisions(t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name")).alias("label")), "label")


@query("C6_null_decay", uses="bars_s", doubles="null_share past_share", sql="""
, x AS (SELECT date, CASE WHEN n > 5 OR year(date) < 1999 THEN close END AS a, CASE WHEN n % 4 <> 0 THEN volume END AS b FROM bars_s), d AS (SELECT date, 'a' AS "column", avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) AS null_share FROM x GROUP BY 1 UNION ALL SELECT date, 'b', avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0 END) FROM x GROUP BY 1),
t AS (SELECT *, avg(null_share) OVER (PARTITION BY "column" ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS past_share FROM d) SELECT *, coalesce(null_share - past_share > 0.05, false) AS decayed FROM t""")
def _(t):
    rows = t.bars_s.select("date", F.when((F.col("n") > 5) | (F.year("date") < 1999), F.col("close")).alias("a"), F.when(F.col("n") % 4 != 0, F.col("volume")).alias("b"))
    return q.null_decay(rows, ["a", "b"], drop=0.05)


@query("C7_feature_collapse", uses="bars_s", doubles="filled values_seen modal filled_med values_seen_med modal_med", sql="""
, x AS (SELECT date, CASE WHEN date >= DATE '2001-11-01' AND n > 2 THEN 3 WHEN n % 6 <> 0 THEN n END AS v FROM bars_s), c AS (SELECT date, v, count(*) AS c FROM x GROUP BY 1, 2),
d AS (SELECT date, sum(CASE WHEN v IS NOT NULL THEN c ELSE 0 END) / sum(c) AS filled, CAST(count(v) AS DOUBLE) AS values_seen, coalesce(max(CASE WHEN v IS NOT NULL THEN c END) / sum(CASE WHEN v IS NOT NULL THEN c END), 0) AS modal FROM c GROUP BY 1),
m AS (SELECT *, quantile_cont(filled, 0.5) OVER w AS filled_med, quantile_cont(values_seen, 0.5) OVER w AS values_seen_med, quantile_cont(modal, 0.5) OVER w AS modal_med, row_number() OVER (ORDER BY date DESC) AS rn FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT 'v' AS "column", date, filled, values_seen, modal, filled_med, values_seen_med, modal_med, filled < 0.5 * filled_med OR values_seen < 0.5 * values_seen_med OR modal > greatest(0.5, 2 * modal_med) AS collapsed FROM m WHERE rn = 1""")
def _(t):
    return q.feature_collapse(t.bars_s.select("date", F.when((F.col("date") >= "2001-11-01") & (F.col("n") > 2), 3).when(F.col("n") % 6 != 0, F.col("n")).alias("v")), "v")


@query("C8_latest_integrity", sql="SELECT o_orderkey, o_orderkey % 5 <> 0 AS is_object, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS count_matches FROM orders")
def _(t):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "[1,2]").when(k % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"items":["'), "o_orderstatus", F.lit('","b"]}')))
    return q.latest_integrity(t.orders.select("o_orderkey", text.alias("payload"), F.when(k % 3 == 0, 3).otherwise(2).alias("declared")), "o_orderkey", "payload", "declared")


@query("C9_adjustment_gap_check", uses="trades bars_raw", doubles="gap factor", sql=ACTIONS + f"""
, g AS (SELECT symbol, date, close / {prev('close')} - 1 AS gap FROM bars_raw) SELECT g.symbol, g.date, gap, ex_date, factor FROM g JOIN act ON act.symbol = g.symbol AND abs(date_diff('day', ex_date, g.date)) <= 5 WHERE abs(gap) > 0.35 AND g.date >= DATE '2000-01-01'""")
def _(t):
    gaps = t.bars_raw.select("symbol", "date", ind.change().alias("gap")).where("abs(gap) > 0.35 AND date >= '2000-01-01'")
    return band_join(gaps, actions(t), "symbol", "date", "ex_date", 5)


@query("C9_gaps_of_last_years", uses="trades bars_raw", doubles="gap factor", sql=ACTIONS + f"""
, g AS (SELECT symbol, date, close / {prev('close')} - 1 AS gap FROM bars_raw), s AS (SELECT min(date) AS d FROM bars_raw)
SELECT g.symbol, g.date, gap, ex_date, factor FROM g JOIN act ON act.symbol = g.symbol AND abs(date_diff('day', ex_date, g.date)) <= 5, s WHERE abs(gap) > 0.35 AND g.date >= s.d""")
def _(t):
    """The first date that counts is taken from the table: here its first, so no gap is left out."""
    since = t.bars_raw.agg(F.min("date")).scalar()
    gaps = t.bars_raw.select("symbol", "date", ind.change().alias("gap")).where((F.abs("gap") > 0.35) & (F.col("date") >= since))
    return band_join(gaps, actions(t), "symbol", "date", "ex_date", 5)


@query("C10_coverage_check", uses="bars_s", doubles="coverage", sql="""
, e AS (SELECT count(*) AS e FROM supplier) SELECT date, any_value(e) AS expected, count(*) AS present, count(*) / any_value(e) AS coverage, CASE WHEN count(*) < any_value(e) THEN 'warn' ELSE 'pass' END AS status FROM bars_s, e GROUP BY 1""")
def _(t):
    expected = t.supplier.agg(F.count("*")).scalar()
    rows = t.bars_s.groupBy("date").agg(F.count("*").alias("present")).withColumn("expected", expected)
    return rows.select("date", "expected", "present", (F.col("present") / F.col("expected")).alias("coverage"), F.when(F.col("present") < F.col("expected"), "warn").otherwise("pass").alias("status"))


@query("C11_null_sweep", uses="bars_s", sql="""
SELECT 'b' AS "column", count(*) FILTER (WHERE date < DATE '2001-11-01') AS filled, 0 AS filled_latest, 'NEWLY_NULL' AS state FROM bars_s UNION ALL SELECT 'c', 0, 0, 'ENTIRELY_NULL'""")
def _(t):
    rows = t.bars_s.select("date", F.col("close").alias("a"), F.when(F.col("date") < "2001-11-01", F.col("close")).alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("d"))
    return q.null_sweep(rows, ["a", "b", "c", "d"], t.spark.createDataFrame([("d",)], "column string"))


@query("C12_repair_rules", uses="outcomes", doubles="return_pct copy_of_return", sql="""
, x AS (SELECT symbol, date, CASE WHEN prints % 9 = 0 THEN 0.0 ELSE return_pct END AS return_pct, CASE WHEN prints % 4 = 0 THEN CASE WHEN prints % 9 = 0 THEN 0.0 ELSE return_pct END ELSE p END AS cp, outcome FROM outcomes), f AS (SELECT *, return_pct IS NOT NULL AND return_pct IS NOT DISTINCT FROM cp AS dup, coalesce(return_pct = 0, false) AND outcome NOT IN ('NEUTRAL', 'PENDING') AS flat FROM x)
SELECT symbol, date, return_pct, CASE WHEN NOT dup THEN cp END AS copy_of_return, CASE WHEN flat THEN 'NEUTRAL' ELSE outcome END AS outcome, CASE WHEN dup THEN 'DUPLICATED_COLUMN' WHEN flat THEN 'ZERO_RETURN_NOT_NEUTRAL' END AS repair FROM f""")
def _(t):
    ret = F.when(F.col("prints") % 9 == 0, 0.0).otherwise(F.col("return_pct"))
    return q.repair(t.outcomes.select("symbol", "date", ret.alias("return_pct"), F.when(F.col("prints") % 4 == 0, ret).otherwise(F.col("p")).alias("copy_of_return"), "outcome"))


@query("C13_orphan_rows", uses="bars_s", sql="SELECT symbol, date FROM bars_s WHERE n % 5 = 0")
def _(t):
    return q.orphan_rows(t.bars_s.select("symbol", "date"), t.bars_s.where("n % 5 <> 0"))


@query("C14_verdict_report", sql="""
SELECT 'line-discount' AS check_id, 'critical' AS severity, count(*) FILTER (WHERE l_discount > 0.05) AS bad, count(*) AS total, 'fail' AS status FROM lineitem UNION ALL SELECT 'order-price', 'minor', count(*) FILTER (WHERE o_totalprice <= 0), count(*), 'pass' FROM orders""")
def _(t):
    count = lambda table, cond: lambda tables: tables[table].agg(F.count_if(cond).alias("bad"), F.count("*").alias("total"))
    checks = {"line-discount": (count("lineitem", F.col("l_discount") > 0.05), "critical"), "order-price": (count("orders", F.col("o_totalprice") <= 0), "minor")}
    return q.verdict_report({"lineitem": t.lineitem, "orders": t.orders}, checks)


@query("C14_report_history", sql="""
SELECT 1 AS run, 'line-discount' AS check_id, 'critical' AS severity, count(*) FILTER (WHERE l_discount > 0.04) AS bad, count(*) AS total, 'fail' AS status FROM lineitem
UNION ALL SELECT 2, 'line-discount', 'critical', count(*) FILTER (WHERE l_discount > 0.05), count(*), 'fail' FROM lineitem UNION ALL SELECT 2, 'order-price', 'minor', count(*) FILTER (WHERE o_totalprice <= 0), count(*), 'pass' FROM orders""")
def _(t):
    """A run appended to the history of the one before, whose retired check goes."""
    count = lambda table, cond: lambda tables: tables[table].agg(F.count_if(cond).alias("bad"), F.count("*").alias("total"))
    tables = {"lineitem": t.lineitem, "orders": t.orders}
    before = q.verdict_report(tables, {"line-discount": (count("lineitem", F.col("l_discount") > 0.04), "critical"), "retired": (count("lineitem", F.col("l_tax") > 0.07), "minor")})
    now = q.verdict_report(tables, {"line-discount": (count("lineitem", F.col("l_discount") > 0.05), "critical"), "order-price": (count("orders", F.col("o_totalprice") <= 0), "minor")})
    return q.report_history(before.select(F.lit(1).alias("run"), "*"), now.select(F.lit(2).alias("run"), "*"))


@query("C15_flat_copy_share", uses="bars_s", doubles="flat_share", sql="SELECT date, count(*) AS rows, avg(CASE WHEN open = high AND high = low AND low = close THEN 1.0 ELSE 0 END) AS flat_share FROM bars_s GROUP BY 1")
def _(t):
    return q.flat_copy_share(t.bars_s, ["date"])


@query("C16_check_adjustments", uses="trades bars_m", doubles="expected factor", sql=DERIVE + """
, d AS (SELECT symbol, ex_date, factor AS expected FROM decl WHERE EXISTS (SELECT 1 FROM bars_m b WHERE b.symbol = decl.symbol AND b.date = decl.ex_date))
SELECT coalesce(d.symbol, f.symbol) AS symbol, coalesce(d.ex_date, f.ex_date) AS ex_date, expected, factor, CASE WHEN expected IS NULL THEN 'UNEXPLAINED' WHEN factor IS NULL THEN 'MISSING' WHEN abs(factor / expected - 1) > 0.02 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM d FULL JOIN fac f ON f.symbol = d.symbol AND f.ex_date = d.ex_date""")
def _(t):
    declared = t.trades.where("qty = 10").groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("ex_date")).agg(F.max(0.9 + F.col("l_discount")).alias("factor"))
    return q.check_adjustments(derived(t), declared, t.bars_m)
