"""Model fitting on the panel with Spark ML. Folds are session ranges; models see only rows whose
labels were realised before their test block."""

from itertools import combinations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio
from bourse.operators.labels import fold_rows, walk_forward_folds
from bourse.operators.measure import auc, per_date_ic
from bourse.operators.xsection import average_rank, peers, rank_gauss
from bourse.session import written


def vectors(df: DataFrame, features) -> DataFrame:
    """Complete rows with the features as one vector."""
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)


def out_of_fold(df: DataFrame, folds: DataFrame, fit, out: str = "score") -> DataFrame:
    """Scores of each test block from a model fitted on the rows before it; the folds are a handful."""
    numbers = [r.fold for r in folds.select("fold").orderBy("fold").collect()]
    rows = written(fold_rows(df, folds), "folds", by=("fold", "part"))  # a fit reads the files of its fold and part only
    scored = None
    for n in numbers:
        train, test = (rows.where((F.col("fold") == n) & (F.col("part") == p)) for p in ("TRAIN", "TEST"))
        block = fit(train)(test).withColumnRenamed("_score", out)
        scored = block if scored is None else scored.unionByName(block)
    return scored.drop("part", "_x")


def probability(model) -> callable:
    return lambda test: model.transform(test).withColumn("_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def predicted(model) -> callable:
    return lambda test: model.transform(test).withColumnRenamed("prediction", "_score")


def train_classifier_purged(df: DataFrame, features, label: str, folds: DataFrame, depth: int = 3, rounds: int = 8) -> DataFrame:
    """Out-of-fold probabilities of a boosted classifier."""
    def fit(train):
        return probability(GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=rounds, seed=7).fit(train))
    return out_of_fold(vectors(df.where(F.col(label).isNotNull()), features), folds, fit)


def held_out_auc(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """Area under the curve per fold, within sessions, averaged over them."""
    ranked = scored.withColumn("_r", average_rank(score, "fold", "date"))
    daily = ranked.groupBy("fold", "date").agg(auc(F.col("_r"), F.col(label) == 1).alias("_a"), F.count("*").alias("_n"))
    return daily.groupBy("fold").agg(F.avg("_a").alias("auc"), F.sum("_n").alias("rows"))


def train_ranker_ensemble(df: DataFrame, features, target: str, folds: DataFrame, half_life: float) -> DataFrame:
    """Boosted and ridge members weighted towards recent sessions, combined as the mean of rank-gauss scores."""
    rows = vectors(df.where(F.col(target).isNotNull()), features)

    def weighted(train):
        latest = train.agg(F.max("idx")).scalar()  # the rows of one fold
        return train.withColumn("_w", F.pow(F.lit(0.5), (latest - F.col("idx")) / half_life))

    members = {
        "trees": lambda train: predicted(GBTRegressor(featuresCol="_x", labelCol=target, weightCol="_w", maxDepth=3, maxIter=8, seed=7).fit(weighted(train))),
        "ridge": lambda train: predicted(LinearRegression(featuresCol="_x", labelCol=target, weightCol="_w", regParam=0.1).fit(weighted(train))),
    }
    out = None
    for name, fit in members.items():
        one = out_of_fold(rows, folds, fit, "score").select("fold", "symbol", "date", F.col(target).alias("target"), F.lit(name).alias("member"), "score")
        out = one if out is None else out.unionByName(one)
    gauss = rank_gauss(out, "score", out="g", by=("fold", "member", "date"))
    return gauss.groupBy("fold", "symbol", "date").agg(F.first("target").alias("target"), F.avg("g").alias("score"))


def isotonic_calibrate(df: DataFrame, p: str, y: str, days: str, min_days: int, min_episodes: int, gap: int = 5) -> DataFrame:
    """Isotonic map of p per row, or p itself while there are too few distinct days or separate episodes."""
    from bourse.operators.outcomes import episodes
    facts = episodes(df, [], gap, days)
    enough = facts.agg(F.max((F.col("distinct_days") >= min_days) & (F.col("episodes") >= min_episodes))).scalar()
    model = IsotonicRegression(featuresCol=p, labelCol=y).fit(df.withColumn(y, F.col(y).cast("double")))
    return model.transform(df).withColumn("calibrated", F.when(enough, F.col("prediction")).otherwise(F.col(p))).drop("prediction")


def stack_oof(scored: DataFrame, columns, label: str, split: Column) -> DataFrame:
    """Logistic regression on out-of-fold base scores, fitted before the split and applied after it."""
    rows = vectors(scored.where(F.col(label).isNotNull()), columns)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01).fit(rows.where(split))
    return probability(model)(rows.where(~split)).withColumnRenamed("_score", "stacked").drop("_x")


def group_ablation(df: DataFrame, groups: dict, target: str, folds: DataFrame, half_life: float) -> DataFrame:
    """Mean rank correlation with all features and with each group left out."""
    every = [c for g in groups.values() for c in g]
    arms = {"all": every} | {f"without_{g}": [c for c in every if c not in cols] for g, cols in groups.items()}
    out = None
    for name, cols in arms.items():
        ic = per_date_ic(train_ranker_ensemble(df, cols, target, folds, half_life), "score", "target").agg(F.lit(name).alias("arm"), F.avg("ic").alias("mean_ic"), F.count("*").alias("dates"))
        out = ic if out is None else out.unionByName(ic)
    return out


def promotion_gate(candidate: DataFrame, champion: DataFrame, min_dates: float, stale_days: int) -> DataFrame:
    """Rules a candidate must pass, as rows of (rule, passed), with the verdict; an unknown never promotes.

    Both are one-row frames with mean_ic, topk_excess, eff_dates, age_days.
    """
    a = candidate.select(*[F.col(c).alias(f"c_{c}") for c in ("mean_ic", "topk_excess", "eff_dates")])
    b = champion.agg(F.struct(*[F.first(c).alias(c) for c in ("mean_ic", "topk_excess", "age_days")])).scalar()
    rows = a.withColumn("_b", b)
    stale = F.col("_b.age_days") > stale_days
    rules = {"ic_positive": F.col("c_mean_ic") > 0, "enough_dates": F.col("c_eff_dates") >= min_dates, "ic_not_worse": (F.col("c_mean_ic") >= F.col("_b.mean_ic")) | stale, "topk_not_worse": (F.col("c_topk_excess") >= F.col("_b.topk_excess")) | stale}
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()])
    out = rows.select(each.alias("_e")).withColumn("promote", F.forall("_e", lambda e: e["passed"]))
    return out.select(F.explode("_e").alias("_r"), "promote").select("_r.rule", "_r.passed", "promote")


def error_segments(df: DataFrame, features, residual: str, depth: int = 3) -> DataFrame:
    """Leaves of a shallow tree on the residuals: size, mean error and the feature ranges inside each."""
    rows = vectors(df.where(F.col(residual).isNotNull()), features)
    model = DecisionTreeRegressor(featuresCol="_x", labelCol=residual, maxDepth=depth, minInstancesPerNode=50, leafCol="leaf", seed=7).fit(rows)
    spans = [e.alias(f"{n}_{c}") for c in features for n, e in (("min", F.min(c)), ("max", F.max(c)))]
    return model.transform(rows).groupBy(F.col("leaf").cast("int").alias("leaf")).agg(F.count("*").alias("rows"), F.avg(residual).alias("mean_residual"), *spans)


def score_drift(served: DataFrame, score: str, fwd: str, baseline_ic: float, coverage_now: DataFrame, coverage_base: DataFrame, drop: float) -> DataFrame:
    """Realised edge of served scores against the baseline, and features whose coverage fell."""
    ic = per_date_ic(served, score, fwd).agg(F.lit("realised_ic").alias("metric"), F.avg("ic").alias("now"), F.lit(baseline_ic).alias("base"))
    both = coverage_now.select("column", F.col("coverage").alias("now")).join(coverage_base.select("column", F.col("coverage").alias("base")), "column")
    cover = both.select(F.concat(F.lit("coverage:"), "column").alias("metric"), "now", "base")
    return ic.unionByName(cover).withColumn("alert", F.coalesce(F.col("base") - F.col("now") > drop, F.lit(True)))


def conformal_interval(residuals: DataFrame, preds: DataFrame, residual: str, pred: str, alpha: float) -> DataFrame:
    """Prediction plus and minus the (1 - alpha) quantile of absolute residuals."""
    q = residuals.agg(F.percentile(F.abs(residual), F.lit(1 - alpha))).scalar()
    return preds.withColumns({"lo": F.col(pred) - q, "hi": F.col(pred) + q})


def train_excursion_regressors(df: DataFrame, features, split: Column) -> DataFrame:
    """Predicted favourable and adverse moves for rows after a time split, and the levels they imply."""
    rows = written(vectors(df, features), "excursions")  # a fit reads its rows several times
    test = rows.where(~split)
    for side in ("mfe_pct", "mae_pct"):
        model = GBTRegressor(featuresCol="_x", labelCol=side, predictionCol=f"pred_{side}", maxDepth=3, maxIter=6, seed=7).fit(rows.where(split))
        test = model.transform(test)
    return test.drop("_x").withColumns({"target": F.col("entry") * (1 + F.greatest(F.col("pred_mfe_pct"), F.lit(0.0)) / 100), "stop": F.col("entry") * (1 + F.least(F.col("pred_mae_pct"), F.lit(0.0)) / 100)})


def score_and_record(ledger: DataFrame, scored: DataFrame, model_id: str, features, width: float) -> DataFrame:
    """Ledger rows with rank, interval and the features used; a decision once written is never changed."""
    from bourse.sources.landing import merge_upsert
    place = F.row_number().over(peers("date").orderBy(F.desc("score"), F.asc("symbol")))
    rows = scored.select(F.lit(model_id).alias("model_id"), "date", "symbol", "score", place.cast("bigint").alias("rank"), (F.col("score") - width).alias("lo"), (F.col("score") + width).alias("hi"), F.to_json(F.struct(*features)).alias("features"))
    return merge_upsert(ledger, rows.withColumn("_o", F.lit(1)), ["model_id", "date", "symbol"], "_o", "ignore")


def combination_tree(df: DataFrame, filters, label: str, depth: int = 3) -> DataFrame:
    """Leaves of a tree over binary filter matches, with the filters every row of a leaf shares, and win rates."""
    rows = vectors(df.where(F.col(label).isNotNull()).withColumns({f: F.col(f).cast("double") for f in filters}), filters)
    model = DecisionTreeClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=30, leafCol="leaf", seed=7).fit(rows)
    leaves = model.transform(rows).groupBy(F.col("leaf").cast("int").alias("leaf")).agg(F.count("*").alias("rows"), F.avg(label).alias("win_rate"), *[F.avg(f).alias(f"_{f}") for f in filters])
    path = F.array_join(F.filter(F.array(*[F.when(F.col(f"_{f}") == 1, f).when(F.col(f"_{f}") == 0, f"not {f}") for f in filters]), lambda x: x.isNotNull()), " and ")
    return leaves.select("leaf", "rows", "win_rate", path.alias("path"))


def filter_ranking(df: DataFrame, filters, label: str) -> DataFrame:
    """Win rate of each single filter, best first."""
    each = F.array(*[F.when(F.col(f), F.lit(f)) for f in filters])
    rows = df.where(F.col(label).isNotNull()).select(label, F.explode(F.filter(each, lambda f: f.isNotNull())).alias("filter"))
    return rows.groupBy("filter").agg(F.count("*").alias("rows"), F.avg(label).alias("win_rate"))


def leak_canary(df: DataFrame, features, label: str, folds: DataFrame) -> DataFrame:
    """Held-out area with the features as given and lagged one row: a large fall points to a leak."""
    w = Window.partitionBy("symbol").orderBy("date")
    arms = {"as_given": df, "lagged": df.withColumns({c: F.lag(c).over(w) for c in features})}
    out = None
    for name, rows in arms.items():
        one = held_out_auc(train_classifier_purged(rows, features, label, folds), label).agg(F.lit(name).alias("arm"), F.avg("auc").alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


def label_leak_gate(df: DataFrame, score: str, label: str, limit: float, seed: int = 7) -> DataFrame:
    """Mean per-date rank correlation of a score with the label it is graded on, beside a control whose
    labels are shuffled within the date by a seeded hash; `leaks` at or beyond the limit."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    shuffled = F.row_number().over(peers("date").orderBy(F.md5(F.concat(F.lit(str(seed)), "symbol", F.col("date").cast("string")))))
    plain = F.row_number().over(peers("date").orderBy("symbol"))
    moved = rows.select("date", plain.alias("_k"), F.col(score).alias("s")).join(rows.select("date", shuffled.alias("_k"), F.col(label).alias("l")), ["date", "_k"])
    one = per_date_ic(rows, score, label, 3).agg(F.lit("label").alias("arm"), F.avg("ic").alias("mean_ic"))
    two = per_date_ic(moved, "s", "l", 3).agg(F.lit("shuffled").alias("arm"), F.avg("ic").alias("mean_ic"))
    return one.unionByName(two).withColumn("leaks", F.abs("mean_ic") >= limit)


def cpcv_splits(sessions: DataFrame, groups: int, test_groups: int, purge: int, embargo: int) -> DataFrame:
    """Every choice of test groups over consecutive session groups; training sessions within the purge before
    or the embargo after a test group drop out. The table has sessions x splits rows."""
    size = F.ceil(sessions.agg(F.max("idx")).scalar() / groups)
    rows = sessions.withColumn("_size", size).withColumn("_g", F.floor((F.col("idx") - 1) / F.col("_size")))
    choices = list(combinations(range(groups), test_groups))
    rows = rows.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(g) for g in c]).alias("test")) for i, c in enumerate(choices)]))).select("date", "idx", "_g", "_size", "_c.split", "_c.test")
    inside = F.array_contains("test", F.col("_g").cast("int"))
    near = F.exists("test", lambda g: (F.col("idx") > g * F.col("_size") - purge) & (F.col("idx") <= (g + 1) * F.col("_size") + embargo))
    return rows.select("split", "date", "idx", F.when(inside, "TEST").when(near, "DROPPED").otherwise("TRAIN").alias("part"))
