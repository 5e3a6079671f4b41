"""Faults of the third round's review that were mended last."""

import statistics
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bourse.operators import evaluation, ml, rank
from bourse.operators.xsection import neutral_percentile
from bourse.streaming import state


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_highs_hold_few_rows():
    rng = np.random.default_rng(3)
    stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(2000), "s")

    def frames(n):
        for k in range(n):
            price = rng.normal(size=2000)
            price[::97] = np.nan
            yield pd.DataFrame({"symbol": "a", "event_id": rng.permutation(2000) + k * 2000, "ts": rng.permutation(stamps), "price": price, "size": 1.0})

    tracemalloc.start()
    state.new_highs(frames(300), 1 << 13)
    assert tracemalloc.get_traced_memory()[1] < 4e6  # all rows of the columns read take 14 MB
    tracemalloc.stop()

    some = list(frames(20))
    best, highs = -np.inf, []
    for r in pd.concat(some).sort_values(["ts", "event_id"]).itertuples():
        if r.price > best:
            best = r.price
            highs.append(r.event_id)
    for least in (1, 5000, 1 << 20):
        got, newest = state.new_highs(iter(some), least)
        assert list(got["event_id"]) == highs and newest == stamps[-1]


def test_returns_above_the_median_come_from_ranks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluation, "auc_by_rank", lambda df, keys, score, y: seen.append(df) or spark.createDataFrame([], "score_name string, horizon int, regime string, n long, auc double"))
    for values in ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 2.0, 2.0], [2.0, 2.0, 2.0, 1.0, 3.0], [5.0], [1.0, 1.0, 3.0, 4.0]):
        panel = spark.createDataFrame([("2024-01-01", f"s{k}", "r", v, float(k)) for k, v in enumerate(values)], "date string, symbol string, regime string, fwd_1 double, s double")
        evaluation.edge_verdict(panel, ["s"], [1])
        got = [(int(r.score), r._y) for r in seen[-1].where("regime = 'ALL'").collect()]
        assert sorted(got) == [(k, int(v > statistics.median(values))) for k, v in enumerate(values)]
    assert "percentile" not in plan_of(seen[-1])


def test_composite_factors_sort_a_session_once(spark):
    names = ["piotroski", "roe", "debt", "ret_12m", "ret_1m", "pe", "pb", "sharpe", "beta"]
    rng = np.random.default_rng(5)
    rows = [(f"d{k % 3}", f"s{k}", *[None if rng.random() < 0.2 else float(rng.integers(-2, 4)) for _ in names]) for k in range(60)] + [("d0", "none", *[None] * len(names))]
    df = spark.createDataFrame(rows, "date string, symbol string, " + ", ".join(f"{n} double" for n in names))
    got = rank.composite_factors(df)
    text = plan_of(got)
    assert text.count("Window [") <= 2 and text.count("Sort [") <= 2
    pct = lambda c, up=True: neutral_percentile(c, ascending=up)
    whole = df.withColumns({"m": F.col("ret_12m") - F.col("ret_1m"), "ey": F.expr("CASE WHEN pe > 0 THEN 1 / pe END"), "pbp": F.expr("CASE WHEN pb > 0 THEN pb END")}).select(
        "date", "symbol", ((pct("piotroski") + pct("roe") + pct("debt", False)) / 3).alias("quality"), pct("m").alias("momentum"),
        F.when(F.expr("pe <= 0 OR pb <= 0"), 0.0).otherwise((pct("ey") + pct("pbp", False)) / 2).alias("value"), ((pct("sharpe") + pct("beta", False)) / 2).alias("risk"))
    assert sorted(map(tuple, got.drop("composite").collect())) == sorted(map(tuple, whole.collect()))


def test_excursions_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = spark.range(200).selectExpr("id", "id * 1.0 AS entry", "id % 7 * 1.0 AS mfe_pct", "-(id % 5) * 1.0 AS mae_pct")
    got = ml.train_excursion_regressors(rows.mapInPandas(counted, rows.schema), ["entry"], F.col("id") < 150)
    assert len(got.collect()) == 50 and read.value == 200


def test_a_fit_reads_its_fold_only(spark):
    rows = spark.range(40).selectExpr("id AS idx", "id * 1.0 AS x", "CAST(id % 2 AS int) AS y")
    folds = spark.createDataFrame([(0, 20, 29, 18), (1, 30, 39, 28)], "fold int, test_from long, test_to long, train_to long")
    plans = []

    def fit(train):
        plans.append((plan_of(train), train.count()))
        return lambda test: test.withColumn("_score", F.col("x"))

    assert ml.out_of_fold(ml.vectors(rows, ["x"]), folds, fit).count() == 20
    assert [n for _, n in plans] == [19, 29]
    assert all("PartitionFilters: [" in p and f"(fold#" in p.split("PartitionFilters: [")[1].split("]")[0] for p, _ in plans)
