"""Small hand-made cases: known answers, planted signals, and loops the operators must equal."""

import datetime as dt
import math
import random
from statistics import NormalDist, mean

from pyspark.sql import functions as F

from bourse.functions import normal
from bourse.operators import asof, derivatives, identity, labels, measure, prefix, prep, rank, signals, spans
from bourse.operators.outcomes import auc_by_rank
from bourse.operators.recurrences import recurrences

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_normal_matches_library(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-60, 61)], "x double").withColumn("c", normal.cdf(F.col("x"))).collect()
    assert max(abs(r.c - NormalDist().cdf(r.x)) for r in rows) < 1e-9
    probs = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.99999]
    inv = normal.with_inverse(spark.createDataFrame([(p,) for p in probs], "p double"), "p", "z").collect()
    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in inv) < 1e-7


def test_ranks_over_a_hot_group_and_a_hot_value(spark):
    rng = random.Random(1)
    rows = [("hot", 1.0 if i % 3 == 0 else round(rng.random(), 3), i % 2) for i in range(3000)] + [("cold", float(i), i % 2) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    got = {r.k: r.auc for r in auc_by_rank(df, ["k"], "x", "y").collect()}
    for key in ("hot", "cold"):
        pos, neg = [r[1] for r in rows if r[0] == key and r[2]], [r[1] for r in rows if r[0] == key and not r[2]]
        want = mean((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos[:] for b in neg) if len(pos) < 2000 else None
        assert abs(got[key] - want) < 1e-9
    places = prefix.numbered(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "x", "id").where("k = 'hot'").select("rn").collect()
    assert sorted(r.rn for r in places) == list(range(1, 3001))


def test_asof_strict_tolerance_and_slices(spark):
    left = spark.createDataFrame([("a", day(0)), ("a", day(40)), ("a", day(41)), ("b", day(5))], "k string, t date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(40), 2.0)], "k string, u date, v double")
    run = lambda **kw: {(r.k, r.t): r.v for r in asof.asof_join(left, right, "k", "t", "u", ["v"], **kw).collect()}
    assert run() == {("a", day(0)): None, ("a", day(40)): 2.0, ("a", day(41)): 2.0, ("b", day(5)): None}
    assert run(strict=True)[("a", day(40))] == 1.0
    assert run(strict=True, tolerance_days=10)[("a", day(40))] is None
    assert run(direction="forward")[("a", day(0))] == 1.0


def bars(spark, closes, symbol="X"):
    return spark.createDataFrame([(symbol, day(i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0) for i, c in enumerate(closes)],
                                 "symbol string, date date, open double, high double, low double, close double, volume double")


def test_split_is_found_and_locked_day_is_not(spark):
    rows = [("S", day(1), 100.0, 50.5, 51.0, 49.0, 50.0), ("L", day(1), 100.0, 120.0, 120.0, 120.0, 120.0), ("C", day(1), 100.0, 99.0, 99.0, 70.0, 72.0)]
    got = {r.symbol: (r.factor, r.reason) for r in prep.detect_adjustments(spark.createDataFrame(rows, "symbol string, date date, prev_close double, open double, high double, low double, close double")).collect()}
    assert got == {"S": (0.5, None), "L": (None, "circuit_locked_zero_range"), "C": (None, "range_touches_old_basis")}


def test_stop_goes_before_target_and_half_is_booked(spark):
    path = "array<struct<at:bigint,date:date,open:double,high:double,low:double,close:double>>"
    rows = [("both", 100.0, 95.0, 110.0, None, "long", [(1, day(1), 100.0, 112.0, 94.0, 100.0)]),
            ("half", 100.0, 90.0, 110.0, None, "long", [(1, day(1), 100.0, 111.0, 99.0, 108.0), (2, day(2), 108.0, 109.0, 100.0, 104.0)]),
            ("short", 100.0, 105.0, 90.0, None, "short", [(1, day(1), 100.0, 106.0, 99.0, 104.0)])]
    df = spark.createDataFrame(rows, f"id string, entry double, stop double, target double, atr double, direction string, bars {path}")
    got = {r.id: (r.exit_reason, round(r.gross_pct, 6)) for r in labels.exit_path(df).collect()}
    assert got == {"both": ("STOP_LOSS", -5.0), "half": ("TIME_EXIT_PARTIAL", 7.0), "short": ("STOP_LOSS", -5.0)}


def test_trend_scan_equals_a_loop(spark):
    rng = random.Random(3)
    closes = [100.0]
    for _ in range(80):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.05)))

    def loop(p, least=3, hold=20, adverse=0.10):
        if len(p) < least + 1:
            return 0
        for sign in (1, -1):
            run, ext = 0, p[0]
            for i in range(1, min(len(p), hold + 1)):
                if (p[i] - p[i - 1]) * sign > 0:
                    run, ext = run + 1, max(ext * sign, p[i] * sign) * sign
                    if run >= least:
                        return sign
                else:
                    if (ext - p[i]) * sign / ext > adverse:
                        break
                    run = 0
        return 0

    got = [r.trend_label for r in labels.trend_scan(bars(spark, closes)).orderBy("date").collect()]
    assert got == [loop(closes[i:i + 21]) for i in range(len(closes))]


def test_recursive_indicators(spark):
    closes = [100 + 5 * math.sin(i / 3) + i * 0.2 for i in range(60)]
    rows = recurrences(bars(spark, closes)).orderBy("date").collect()
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = mean(max(m, 0) for m in moves[:14]), mean(max(-m, 0) for m in moves[:14])
    assert rows[13].rsi_wilder is None or math.isnan(rows[13].rsi_wilder)
    assert abs(rows[14].rsi_wilder - (100 - 100 / (1 + gain / loss))) < 1e-9
    for m in moves[14:]:
        gain, loss = (gain * 13 + max(m, 0)) / 14, (loss * 13 + max(-m, 0)) / 14
    assert abs(rows[-1].rsi_wilder - (100 - 100 / (1 + gain / loss))) < 1e-9
    e = closes[0]
    for c in closes[1:]:
        e = c * 2 / 9 + e * 7 / 9
    assert abs(rows[-1].ema_8 - e) < 1e-9


def test_planted_rank_correlation_is_recovered(spark):
    rng = random.Random(5)
    rows = [(day(d), f"s{i}", s := rng.gauss(0, 1), 0.3 * s + rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(40) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, symbol string, score double, fwd double, noise double")
    ic = measure.ic_summary(measure.per_date_ic(df, "score", "fwd"), 1).first()
    assert 0.2 < ic.mean_ic < 0.36 and ic.t_nw > 5 and ic.reliable
    assert abs(measure.ic_summary(measure.per_date_ic(df, "noise", "fwd"), 1).first().mean_ic) < 0.06


def test_hedge_weights_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [("m", d, name, rng.gauss(0.05 if name == "a" else 0, 0.1)) for d in range(30) for name in "abc"]
    got = {r.member: r.weight for r in rank.hedge_weights(spark.createDataFrame(rows, "model string, idx bigint, member string, ic double"), 2.0, 0.05, 5).collect()}
    w = {n: 1 / 3 for n in "abc"}
    for d in range(30):
        w = {n: w[n] * math.exp(2.0 / 5 * next(r[3] for r in rows if r[1] == d and r[2] == n)) for n in w}
        total = sum(w.values())
        w = {n: 0.95 * w[n] / total + 0.05 / 3 for n in w}
    assert all(abs(got[n] - w[n]) < 1e-12 for n in w)


def test_implied_vol_prices_back(spark):
    rows = [(float(derivatives.black76(100.0, k, 0.5, s, c, 0.065)), 100.0, float(k), 0.5, c, s) for k in (80, 100, 130) for s in (0.1, 0.4, 1.2) for c in (True, False)]
    df = spark.createDataFrame([*rows, (0.0001, 100.0, 50.0, 0.5, True, -1.0)], "price double, forward double, strike double, years double, is_call boolean, want double")
    for r in derivatives.implied_vol(df).collect():
        assert r.iv is None if r.want < 0 else abs(r.iv - r.want) < 1e-4


def test_signals_fire_once(spark):
    closes = [100.0] * 30 + [120.0]
    rows = bars(spark, closes).withColumn("volume", F.when(F.col("close") > 110, 500.0).otherwise(100.0))
    last = signals.technical_signals(rows).orderBy(F.desc("date")).first()
    assert "RESISTANCE_BREAKOUT" in [s.type for s in last.signals]


def test_isin_and_clusters(spark):
    codes = spark.createDataFrame([("INE002A01018",), ("INE002A01019",), ("bad",)], "c string")
    assert [r.v for r in codes.select(identity.valid_isin("c").alias("v")).collect()] == ["INE002A01018", None, None]
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(40)]
    rows = [(s, day(i), base[i] + rng.gauss(0, 0.1)) for s in "abc" for i in range(40)] + [("z", day(i), rng.gauss(0, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {r.symbol: r.cluster for r in rank.correlation_clusters(df, df.select("symbol").distinct(), 0.65, 20).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}
    assert spans.pair_correlation(df, df.select("symbol").distinct(), 20).count() == 6


def test_moves_alert_state(spark, tmp_path):
    from bourse.streaming import sinks, state
    prices = [(i, "X", dt.datetime(2024, 1, 1, 0, i), p) for i, p in enumerate([100.0, 101.0, 103.0, 104.0, 100.0, 100.5])]
    schema = "event_id long, symbol string, ts timestamp, price double"
    spark.createDataFrame(prices, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.price_move_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 0.02)
    sinks.run_available(stream, str(tmp_path / "out"))
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/rows")).orderBy("event_id").collect()] == [2, 4]
