"""Queries for model fitting, gates and leak checks on the monthly supplier panel."""

from pyspark.sql import functions as F

from bourse.operators import labels, ml
from bourse.operators.universe import coverage
from bourse.plans.label_queries import trades
from bourse.plans.rank_queries import EV, avg_rank, eval_panel
from bourse.plans.registry import query

FEATURES = ["ret_1", "ret_5", "vol", "vol_ratio", "close_loc"]


def panel(t):
    return eval_panel(t).withColumn("y", (F.col("fwd_1") > 0).cast("int"))


def folds(t):
    return labels.walk_forward_folds(t.sessions_m, 2, 2, 40)


@query("ML1_train_classifier_purged")
def _(t):
    rows = panel(t).select("symbol", "date", "idx", "y", *FEATURES)
    return ml.held_out_auc(ml.train_classifier_purged(rows, FEATURES, "y", folds(t)), "y")


@query("ML2_train_ranker_ensemble")
def _(t):
    return ml.train_ranker_ensemble(panel(t), FEATURES, "fwd_1", folds(t), 24.0).select("fold", "symbol", "date", "score")


@query("ML3_isotonic_calibrate")
def _(t):
    rows = t.preds.withColumn("d", F.date_add(F.lit("2024-01-01"), (F.col("day") * 4).cast("int")))
    return ml.isotonic_calibrate(rows, "p", "y", "d", 10, 2).select("doc_id", "p", "calibrated")


@query("ML4_stack_oof")
def _(t):
    base = ml.train_classifier_purged(panel(t), FEATURES, "y", folds(t)).withColumn("base_2", F.col("ret_5") * F.col("close_loc"))
    return ml.stack_oof(base, ["score", "base_2"], "y", F.col("fold") == 0).select("symbol", "date", "stacked")


@query("ML5_group_ablation")
def _(t):
    return ml.group_ablation(panel(t), {"returns": ["ret_1", "ret_5"], "shape": ["vol", "vol_ratio", "close_loc"]}, "fwd_1", folds(t), 24.0)


@query("ML6_promotion_gate", uses="bars_s sessions_m", sql=EV + f"""
, i AS (SELECT date, corr(a, b) AS x, corr(c, b) AS y FROM (SELECT date, {avg_rank('ret_5')} AS a, {avg_rank('close_loc')} AS c, {avg_rank('fwd_1')} AS b FROM ep WHERE ret_5 IS NOT NULL AND close_loc IS NOT NULL AND fwd_1 IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT avg(x) AS ci, avg(y) AS hi, count(*) AS n FROM i), r AS (SELECT unnest(['ic_positive', 'enough_dates', 'ic_not_worse', 'topk_not_worse']) AS rule, ci, hi, n FROM s),
p AS (SELECT rule, CASE rule WHEN 'ic_positive' THEN ci > 0 WHEN 'enough_dates' THEN n >= 20 WHEN 'ic_not_worse' THEN ci >= hi ELSE ci * 2 >= hi END AS passed FROM r) SELECT *, bool_and(passed) OVER () AS promote FROM p""")
def _(t):
    from bourse.operators.measure import per_date_ic
    rows = panel(t).where("ret_5 IS NOT NULL AND close_loc IS NOT NULL")
    card = lambda c, age, k: per_date_ic(rows, c, "fwd_1").agg(F.avg("ic").alias("mean_ic"), (F.avg("ic") * k).alias("topk_excess"), F.count("*").cast("double").alias("eff_dates"), F.lit(age).alias("age_days"))
    return ml.promotion_gate(card("ret_5", 0, 2), card("close_loc", 10, 1), 20, 90)


@query("ML7_error_segments")
def _(t):
    rows = panel(t).withColumn("residual", F.col("fwd_1") - F.col("ret_1") * 0.1)
    return ml.error_segments(rows, ["ret_5", "vol"], "residual")


@query("ML8_score_drift", uses="bars_s sessions_m", doubles="now base", sql=EV + f"""
, i AS (SELECT date, corr(a, b) AS x FROM (SELECT date, {avg_rank('ret_5')} AS a, {avg_rank('fwd_1')} AS b FROM ep WHERE ret_5 IS NOT NULL AND fwd_1 IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10),
u AS (SELECT 'realised_ic' AS metric, avg(x) AS now, 0.05 AS base FROM i UNION ALL SELECT 'coverage:ret_5', count(ret_5) FILTER (WHERE date >= DATE '2000-01-01') / count(*) FILTER (WHERE date >= DATE '2000-01-01'), count(ret_5) FILTER (WHERE date < DATE '2000-01-01') / count(*) FILTER (WHERE date < DATE '2000-01-01') FROM ep)
SELECT *, base - now > 0.03 AS alert FROM u""")
def _(t):
    p = panel(t)
    return ml.score_drift(p, "ret_5", "fwd_1", 0.05, coverage(p.where("date >= '2000-01-01'"), ["ret_5"], 0.5), coverage(p.where("date < '2000-01-01'"), ["ret_5"], 0.5), 0.03)


@query("ML9_conformal_interval", uses="bars_s sessions_m", doubles="ret_5 lo hi", sql=EV + """
, q AS (SELECT quantile_cont(abs(fwd_1 - ret_1), 0.9) AS q FROM ep WHERE fwd_1 IS NOT NULL AND ret_1 IS NOT NULL) SELECT symbol, date, ret_5, ret_5 - q AS lo, ret_5 + q AS hi FROM ep, q WHERE ret_5 IS NOT NULL""")
def _(t):
    p = panel(t)
    return ml.conformal_interval(p.withColumn("e", F.col("fwd_1") - F.col("ret_1")), p.where("ret_5 IS NOT NULL").select("symbol", "date", "ret_5"), "e", "ret_5", 0.1)


@query("ML10_train_excursion_regressors")
def _(t):
    rows = labels.excursions(trades(t)).where("mfe_pct IS NOT NULL").withColumn("atr0", F.coalesce("atr_pct", F.lit(0.0)))
    return ml.train_excursion_regressors(rows, ["entry", "atr0"], F.col("entry_date") < "2000-01-01").select("symbol", "entry_date", "pred_mfe_pct", "pred_mae_pct", "target", "stop")


@query("ML11_score_and_record")
def _(t):
    scored = ml.train_classifier_purged(panel(t), FEATURES, "y", folds(t)).select("date", "symbol", "score", *FEATURES)
    empty = t.spark.createDataFrame([], "model_id string, date date, symbol string, score double, rank bigint, lo double, hi double, features string")
    return ml.score_and_record(empty, scored, "m1", FEATURES, 0.1)


@query("ML12_combination_tree")
def _(t):
    rows = panel(t).withColumns({"up": F.coalesce(F.col("ret_5") > 0, F.lit(False)), "busy": F.coalesce(F.col("vol_ratio") > 1, F.lit(False)), "firm": F.coalesce(F.col("close_loc") > 0.5, F.lit(False))})
    return ml.combination_tree(rows, ["up", "busy", "firm"], "y")


@query("ML12_filter_ranking", uses="bars_s sessions_m", doubles="win_rate", sql=EV + """
, f AS (SELECT CASE WHEN fwd_1 > 0 THEN 1 ELSE 0 END AS y, unnest(list_filter([CASE WHEN ret_5 > 0 THEN 'up' END, CASE WHEN vol_ratio > 1 THEN 'busy' END], lambda x: x IS NOT NULL)) AS filter FROM ep WHERE fwd_1 IS NOT NULL) SELECT filter, count(*) AS rows, avg(y) AS win_rate FROM f GROUP BY 1""")
def _(t):
    rows = panel(t).withColumns({"up": F.coalesce(F.col("ret_5") > 0, F.lit(False)), "busy": F.coalesce(F.col("vol_ratio") > 1, F.lit(False))})
    return ml.filter_ranking(rows, ["up", "busy"], "y")


@query("L26_leak_canary")
def _(t):
    return ml.leak_canary(panel(t), ["ret_5", "vol"], "y", folds(t))


@query("L27_label_leak_gate", uses="bars_s sessions_m", doubles="mean_ic", sql=EV + f"""
, k AS (SELECT date, symbol, ret_5 AS s, fwd_1 AS l, row_number() OVER (PARTITION BY date ORDER BY symbol) AS p, row_number() OVER (PARTITION BY date ORDER BY md5('7' || symbol || date)) AS q FROM ep WHERE ret_5 IS NOT NULL AND fwd_1 IS NOT NULL),
m AS (SELECT 'label' AS arm, date, s, l FROM k UNION ALL SELECT 'shuffled', a.date, a.s, b.l FROM k a JOIN k b ON a.date = b.date AND a.p = b.q), r AS (SELECT arm, date, {avg_rank('s', 'arm, date')} AS a, {avg_rank('l', 'arm, date')} AS b FROM m),
i AS (SELECT arm, date, corr(a, b) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 3) SELECT arm, avg(ic) AS mean_ic, abs(avg(ic)) >= 0.05 AS leaks FROM i GROUP BY 1""")
def _(t):
    return ml.label_leak_gate(panel(t), "ret_5", "fwd_1", 0.05)


@query("L28_cpcv_splits", uses="sessions_m", sql="""
, z AS (SELECT CAST(ceil(max(idx) / 5.0) AS BIGINT) AS size FROM sessions_m), c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(0, 5) x(a), range(0, 5) y(b) WHERE a < b)
SELECT split, date, idx, CASE WHEN (idx - 1) // size IN (a, b) THEN 'TEST' WHEN (idx > a * size - 3 AND idx <= (a + 1) * size + 2) OR (idx > b * size - 3 AND idx <= (b + 1) * size + 2) THEN 'DROPPED' ELSE 'TRAIN' END AS part FROM sessions_m, z, c""")
def _(t):
    return ml.cpcv_splits(t.sessions_m, 5, 2, 3, 2)
