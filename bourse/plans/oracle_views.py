"""SQL text of the stand-in views, written apart from the Spark code in sources/tables.py."""

TOTAL_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, l_extendedprice"


def _bars(symbol: str, unit: str, price: str = "price") -> str:
    return f"""
    SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', ts) AS DATE) AS date,
           arg_min({price}, row({TOTAL_ORDER})) AS open, max({price}) AS high, min({price}) AS low,
           arg_max({price}, row({TOTAL_ORDER})) AS close, sum(qty) AS volume, count(*) AS n
    FROM trades GROUP BY 1, 2"""


# name -> (views it reads, body)
VIEWS: dict[str, tuple[str, str]] = {
    "trades": ("", """
    SELECT p_brand AS symbol, l_shipdate AS ts, p_retailprice * (1 - l_discount) AS price,
           l_extendedprice / l_quantity AS raw_price, l_quantity AS qty, l_orderkey, l_linenumber,
           l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, l_linestatus, p_type
    FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "bars_w": ("trades", _bars("symbol", "week")),
    "bars_m": ("trades", _bars("symbol", "month")),
    "bars_raw": ("trades", _bars("symbol", "week", "raw_price")),
    "bars_s": ("trades", _bars("'S' || l_suppkey", "month")),
    "sessions_w": ("bars_w", "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bars_w)"),
    "sessions_m": ("bars_m", "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bars_m)"),
    "index_w": ("bars_w", "SELECT date, avg(close) AS close FROM bars_w GROUP BY date"),
    "index_m": ("bars_m", "SELECT date, avg(close) AS close FROM bars_m GROUP BY date"),
    "sectors": ("", """
    SELECT symbol, sector FROM (
      SELECT p_brand AS symbol, p_type AS sector,
             row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn
      FROM part GROUP BY 1, 2) WHERE rn = 1"""),
    "facts": ("", """
    SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS as_of_date, arg_max(o_totalprice, o_orderkey) AS value
    FROM orders GROUP BY 1, 2"""),
    "decisions": ("", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey AS symbol,
           CAST(l_shipdate AS DATE) AS date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "spans": ("", """
    SELECT o_orderkey AS span_id, o_custkey AS symbol, o_orderpriority AS list, CAST(o_orderdate AS DATE) AS start_date,
           CASE WHEN last_ship >= o_orderdate THEN CAST(last_ship AS DATE) END AS end_date
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) s
      ON l_orderkey = o_orderkey"""),
    "chain": ("trades", """
    SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS expiry, qty AS strike,
           coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0.0) AS ce_oi,
           coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 0.0) AS pe_oi,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS ce_vol,
           CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS pe_vol,
           avg(CASE WHEN l_linestatus = 'O' THEN 0.1 + l_discount END) AS ce_iv,
           avg(CASE WHEN l_linestatus = 'F' THEN 0.1 + l_discount END) AS pe_iv
    FROM trades GROUP BY 1, 2, 3"""),
    "spot": ("trades", """
    SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS expiry, avg(qty) AS spot FROM trades GROUP BY 1, 2"""),
    "deals": ("", """
    SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
           CASE l_returnflag WHEN 'N' THEN 'BUY' WHEN 'R' THEN 'SELL' END AS side,
           l_quantity AS qty, l_extendedprice AS value, l_orderkey, l_linenumber, l_partkey
    FROM lineitem"""),
    "preds": ("", """
    SELECT d.doc_id, CAST(l.quality AS INTEGER) AS y, d.n_chars / (d.n_chars + 2000.0) AS p, d.lang AS stratum,
           d.doc_id % 20 AS day
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
    "ticks": ("", """
    SELECT event_id, event_type AS symbol, user_id, ts, value AS price,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events"""),
    "outcomes": ("bars_s", """
    SELECT symbol, date, return_pct, CASE WHEN return_pct IS NULL THEN 'PENDING' WHEN return_pct <= -8 THEN 'STOP_LOSS' WHEN return_pct <= -2 THEN 'LOSS'
             WHEN return_pct >= 2 THEN 'WIN' ELSE 'NEUTRAL' END AS outcome,
           'P' || (n % 3) AS source, CASE WHEN month(date) <= 6 THEN 'BULL' ELSE 'BEAR' END AS regime, CASE WHEN n % 2 = 0 THEN 5 ELSE 15 END AS horizon_days,
           'L' || (substr(symbol, 2)::INTEGER % 10) AS screener_id, n AS prints, 1.0 / (1.0 + exp(-(volume - 250) / 200.0)) AS p, last_day(date) AS resolved_on
    FROM (SELECT *, 100 * (lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1) AS return_pct FROM bars_s)"""),
    "nodes": ("", """
    SELECT 'C' || c_custkey AS key, 'customer' AS kind, coalesce(CAST(first_seen AS DATE), DATE '1995-01-01') AS available_at
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_seen FROM orders GROUP BY 1) f ON o_custkey = c_custkey
    UNION ALL SELECT 'S' || s_suppkey, 'supplier', DATE '1995-01-01' FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'nation', DATE '1995-01-01' FROM nation
    UNION ALL SELECT 'R' || r_regionkey, 'region', DATE '1995-01-01' FROM region"""),
    "edges": ("nodes", """
    SELECT 'C' || c_custkey AS src, 'located_in' AS predicate, 'N' || c_nationkey AS dst, available_at
    FROM customer JOIN nodes ON key = 'C' || c_custkey
    UNION ALL SELECT 'S' || s_suppkey, 'located_in', 'N' || s_nationkey, DATE '1995-01-01' FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey, DATE '1995-01-01' FROM nation"""),
}


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _closure(VIEWS[name][0].split(), seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(uses: str, body: str) -> str:
    """`body` is a SELECT, or further CTEs starting with a comma and then a SELECT."""
    names = _closure(uses.split(), [])
    body = body.strip()
    if not names:
        return "WITH " + body[1:] if body.startswith(",") else body
    head = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in names)
    return f"WITH {head}{' ' if not body.startswith(',') else ''}{body}"
