"""Ordered computations where one value, date or symbol holds most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse.operators import order_statistics, prefix, spans


@pytest.mark.parametrize("descending", [False, True])
def test_one_value_holds_most_rows(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), 7.0 if rng.random() < 0.9 else rng.random() * 14, f"t{k:05d}") for k in range(4000)] + [("a", None, "t9")]
    df = spark.createDataFrame(rows, "g string, x double, tie string").repartition(5)
    got = {(r.g, r.tie): (r.rn, r.n) for r in prefix.numbered(df, ["g"], "x", "tie", descending).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[2]))
        assert all(got[g, r[2]] == (k, len(own)) for k, r in enumerate(own, 1))
    sizes = [r["count"] for r in prefix.split_ranges(df.where("x is not null"), [], "x", "tie", descending).groupBy("_range").count().collect()]
    assert max(sizes) < 4 * np.median(sizes)


def test_one_date_holds_all_rows(spark):
    rng = random.Random(2)
    rows = [("hot", dt.date(2024, 1, 1), k, rng.gauss(0, 0.05)) for k in range(3000)] + [("x", dt.date(2024, 1, 1 + k % 20), k, rng.gauss(0, 0.1)) for k in range(200)] + [("one", dt.date(2024, 1, 1), 1, -0.3)]
    df = spark.createDataFrame(rows, "g string, date date, tie long, growth double").repartition(4)
    got = {r.g: r.max_drawdown_pct for r in prefix.worst_drawdown(df, ["g"], "date", ["tie"], "growth").collect()}
    for g in ("hot", "x", "one"):
        path = np.cumsum([r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))])
        want = (np.exp((path - np.maximum.accumulate(path)).min()) - 1) * 100
        assert got[g] == pytest.approx(want, abs=1e-9)
    cut = prefix.split_ranges(df.where("g = 'hot'"), ["g"], "date", ["tie"]).groupBy("_range").count().collect()
    assert len(cut) > 40


def test_wavelet_matrix_is_sorting():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 5, 300).astype(float), rng.normal(0, 1, 257), np.array([2.0]), np.full(64, 1.5)):
        left = rng.integers(0, len(values), 200)
        right = np.minimum(len(values), left + rng.integers(0, 80, 200))
        got = order_statistics.frame_percentiles(values, left, right, (0.0, 0.33, 0.5, 0.9, 1.0))
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            want = np.percentile(values[a:b], [0, 33, 50, 90, 100]) if b > a else np.full(5, np.nan)
            assert np.allclose(got[i], want, equal_nan=True)


def test_a_symbol_with_many_rows(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("s").alias("symbol"), F.expr("date_add(date'1700-01-01', cast(id as int))").alias("date"), F.when(F.col("id") % 7 == 3, None).otherwise(F.sin(F.col("id") * 1.7) + F.col("id") % 5).alias("x"))
    out = order_statistics.with_percentiles(rows, "symbol", "date", "x", (0.33, 0.9), "cut", "n").select("date", "x", "cut", "n").orderBy("date").toPandas()
    known = out["x"].notna().to_numpy()
    for at in (0, 3, 4, 999, 50_000, n - 1):
        seen = out["x"].to_numpy()[: at + 1][known[: at + 1]]
        assert out["n"][at] == len(seen) and np.allclose(out["cut"][at], np.percentile(seen, [33, 90]))
    some = rows.where("date < date'1720-01-01'")
    frame = "(PARTITION BY symbol ORDER BY datediff(date, date'1970-01-01') RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)"
    some.createOrReplaceTempView("hot_symbol")
    want = spark.sql(f"SELECT date, percentile(x, array(0.25, 0.5)) OVER {frame} AS cut, count(x) OVER {frame} AS n FROM hot_symbol").orderBy("date").collect()
    got = order_statistics.with_percentiles(some, "symbol", "date", "x", (0.25, 0.5), "cut", "n", 300).orderBy("date").collect()
    assert all(a.n == b.n and np.allclose(a.cut, b.cut) for a, b in zip(got, want, strict=True))


def test_membership_counts_are_counts(spark):
    rng = random.Random(6)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = []
    for _ in range(300):
        a = rng.randint(0, 120)
        rows.append((rng.choice("pq"), f"s{rng.randint(0, 9)}", day(a), rng.choice([None, day(a + rng.randint(-2, 40))])))
    dates = [day(k) for k in range(0, 150, 3)]
    got = {(r.list, r.date): (r.open_spans, r.symbols) for r in spans.membership_counts(spark.createDataFrame(rows, "list string, symbol string, start_date date, end_date date"), spark.createDataFrame([(d,) for d in dates], "date date")).collect()}
    want = {}
    for name in "pq":
        for d in dates:
            own = [r for r in rows if r[0] == name and r[2] <= d and (r[3] is None or r[3] > d)]
            if own:
                want[name, d] = (len(own), len({r[1] for r in own}))
    assert got == want
