"""Streams over many batches: state that ends, live twins of batch operators, late rows, a replay."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse.streaming import live, sinks, state

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, symbol string, ts timestamp, price double"


@pytest.fixture
def files(spark, tmp_path):
    """A stream of one file a batch; rows are (seconds, event_id, symbol, price)."""

    def stream(*batches):
        for k, rows in enumerate(batches):
            data = [(i, s, START + dt.timedelta(seconds=at), p) for at, i, s, p in rows]
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    return stream


def _held(query):
    """Rows in the state store after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


DAYS = 86_400


def _days(n, symbols=3):
    """One batch a day of quotes of symbols that trade on that day only."""
    return [[(d * DAYS + 60 * k, 1000 * d + k, f"s{d}-{k % symbols}", 10.0 + 5 * (k % 2)) for k in range(12)] for d in range(n)]


@pytest.mark.parametrize("make", [
    lambda q: state.price_move_alerts(q, 0.02, idle_days=1),
    lambda q: state.trailing_stops(q, 0.1, idle_days=1),
    lambda q: state.daily_alert_cap(q.withColumn("day", F.col("ts").cast("date")), 5),
    lambda q: state.plan_guard(q.withColumns({"plan_id": F.col("symbol"), "day": F.col("ts").cast("date"), "entry_low": F.lit(9.0), "entry_high": F.lit(11.0), "stop": F.lit(5.0), "target": F.lit(14.0)})),
    lambda q: state.signal_expiry(q.withColumns({"signal_id": F.col("symbol"), "up": F.lit(3.0), "down": F.lit(0.9)}), "1 minute", 3600),
])
def test_state_goes_down_again(files, tmp_path, make):
    out = make(files(*_days(5)))
    query = sinks.run_available(out, str(tmp_path / "out"))
    held = _held(query)
    # Five days of new keys pass; without an end the state would hold five days' keys, with it that of the last two or three.
    assert max(held) > 0 and held[-1] <= max(held) / 1.5 + 1 and max(held[-2:]) < 5 * max(1, held[0]) * 0.75


def test_moves_search_in_growing_windows():
    rng = np.random.default_rng(0)
    for threshold in (0.01, 0.2, 5.0):
        prices = np.exp(np.cumsum(rng.normal(0, 0.02, 3000)))
        last, want = None, []
        for k, p in enumerate(prices):
            if last is None:
                last = p
            elif abs(p / last - 1) >= threshold:
                want.append(k)
                last = p
        at, _, end = state.moves(prices, None, threshold)
        assert at == want and end == last


def test_moves_go_on_over_batches(spark, files, tmp_path):
    rows = files([(0, 1, "a", 100.0), (1, 2, "a", 101.0)], [(2, 3, "a", 102.0), (2, 4, "b", 5.0)], [(3, 5, "a", 101.5), (4, 6, "a", 99.0)])
    out = state.price_move_alerts(rows, 0.02)
    sinks.run_available(out, str(tmp_path / "out"))
    got = {(r.symbol, r.event_id, round(r.move, 4)) for r in sinks.read_rows(spark, str(tmp_path / "out"), out.schema).collect()}
    assert got == {("a", 3, 0.02), ("a", 6, round(99 / 102 - 1, 4))}


def test_daily_cap_cuts_before_the_step(spark, files, tmp_path):
    rows = files([(k, k, "x", 1.0) for k in range(40, 0, -1)], [(100 + k, 100 + k, "x", 1.0) for k in range(9)])
    out = state.daily_alert_cap(rows.withColumn("day", F.col("ts").cast("date")), 12)
    query = sinks.run_available(out, str(tmp_path / "out"))
    assert {r.event_id for r in sinks.read_rows(spark, str(tmp_path / "out"), out.schema).collect()} == set(range(1, 13))
    assert all(s["numRowsUpdated"] <= 3 for p in query.recentProgress for s in p["stateOperators"])


def _readings(files):
    """Five files; one row of the first day comes in the last file, long after the day has closed."""
    late = (500, 99, "click", 9.0)
    days = [[(d * DAYS + 3600 * h, 10 * d + h, s, (d + 1) / 10 + h / 100) for h, s in ((22, "click"), (23, "view"), (20, "error"), (5, "other"))] for d in range(4)]
    return days, late, files(*days, [late, (4 * DAYS + 7200, 77, "click", 0.5)])


def test_regime_stream_is_its_batch_twin(spark, files, tmp_path):
    days, late, stream = _readings(files)
    change = START + dt.timedelta(days=2)
    weights = spark.createDataFrame([("click", 0.5, dt.datetime(1970, 1, 1), change), ("click", 0.1, change, None), ("view", 0.3, dt.datetime(1970, 1, 1), None), ("error", 0.2, dt.datetime(1970, 1, 1), None)], "source string, weight double, since timestamp, until timestamp")
    readings = stream.select("event_id", F.col("symbol").alias("source"), F.col("price").alias("value"), "ts")
    out = live.regime_stream(readings, weights, "1 day", "10 minutes", 3 * 3600)
    folder = str(tmp_path / "out")
    sinks.run_available(out, folder)
    got = {r.cycle: (round(r.score, 9), r.sources, r.regime) for r in sinks.read_rows(spark, folder, out.schema).collect()}
    want = {}
    for d, rows in enumerate(days):
        at = START + dt.timedelta(days=d)
        data = [(at, s, p, START + dt.timedelta(seconds=t), at + dt.timedelta(days=1)) for t, _, s, p in rows]
        batch = spark.createDataFrame(data, "day timestamp, source string, value double, ts timestamp, now timestamp")
        row = live.regime_nowcast(batch, ["day"], {"click": 0.5 if d < 2 else 0.1, "view": 0.3, "error": 0.2}, 3 * 3600).first()
        want[at] = (round(row.score, 9), row.sources, row.regime)
    assert got == want
    sinks.run_available(live.regime_stream(readings, weights, "1 day", "10 minutes", 3 * 3600), folder)  # the same checkpoint: nothing is done twice
    assert sinks.read_rows(spark, folder, out.schema).count() == len(want)


def test_capitulation_stream_is_its_batch_twin(spark, files, tmp_path):
    from bourse.operators import indicators as ind
    from bourse.plans.streaming_queries import scan_closed_days

    rng = np.random.default_rng(4)
    days = [[(d * DAYS + 600 * h + k, 1000 * d + 10 * h + k, f"s{k}", float(10 * np.exp(rng.normal(-0.05 if h == 0 else 0.02, 0.08)))) for h in range(3) for k in range(9)] for d in range(5)]
    stream = files(*days, [(6 * DAYS, 9999, "s0", 1.0)]).withColumn("size", F.lit(1.0))
    folder = str(tmp_path / "out")
    scan_closed_days(stream, folder, share=0.5)
    shape = "symbol string, date date, ret double"
    got = sorted((r.symbol, r.date, round(r.ret, 9)) for r in spark.read.schema(shape).parquet(f"{folder}/rows").collect())
    rows = spark.createDataFrame([(i, s, START + dt.timedelta(seconds=t), p) for day in days for t, i, s, p in day], SCHEMA)
    at = F.struct("ts", "event_id")
    bars = rows.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"))
    want = live.capitulation_scan(bars.withColumn("prev_close", ind.prev("close")), share=0.5)
    assert got == sorted((r.symbol, r.date, round(r.ret, 9)) for r in want.collect()) and got
    kept = spark.read.parquet(f"{folder}/rows").count()
    some = spark.createDataFrame([("s1", dt.date(2024, 1, 3), 9.0)], "symbol string, date date, close double")
    see = sinks.with_previous("bars", ["symbol"], "close", "date", spark)
    before = {see(some, folder, b).first().previous_close for b in (2, 2)}
    assert len(before) == 1 and kept == len(got)  # a replayed batch sees earlier batches only
