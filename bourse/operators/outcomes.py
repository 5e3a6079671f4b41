"""Aggregates over graded outcomes: rates, calibration, discrimination, drift, lifts.

Where a definition needs an order over a group of any size (ranks, running curves, drawdowns) the
group is folded and cut into ranges by `prefix`, so no single task sees all of it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, col, ratio
from bourse.operators.prefix import ntiles, running_totals, worst_drawdown
from bourse.session import written

DECIDED = ("WIN", "LOSS", "STOP_LOSS")


def is_(*kinds: str) -> Column:
    return F.col("outcome").isin(*kinds)


def conditional_counts() -> list[Column]:
    """Wins, losses, stops, neutrals; win rate over decided outcomes; resolution rates; mean return."""
    return [
        F.count("*").alias("total"), F.count_if(is_("WIN")).alias("wins"), F.count_if(is_("LOSS")).alias("losses"),
        F.count_if(is_("NEUTRAL")).alias("neutrals"), F.count_if(is_("STOP_LOSS")).alias("stops"),
        (100 * ratio(F.count_if(is_("WIN")), F.count_if(is_(*DECIDED)))).alias("win_rate"),
        (100 * ratio(F.count_if(~is_("NEUTRAL")), F.count("*"))).alias("decisive_rate"),
        F.avg("return_pct").alias("avg_return"), F.max("horizon_days").alias("max_horizon"),
    ]


def outcome_counts(df: DataFrame, by) -> DataFrame:
    return df.where(is_(*DECIDED, "NEUTRAL")).groupBy(*by).agg(*conditional_counts())


def outcome_grouping_sets(df: DataFrame, min_n: int) -> DataFrame:
    """One pass for the overall, by-source, by-regime and by-horizon tables and their full grid."""
    sets = [[], ["source"], ["regime"], ["horizon_days"], ["source", "regime", "horizon_days"]]
    rows = df.where(is_(*DECIDED, "NEUTRAL")).withColumn("_h", F.col("horizon_days"))
    counts = [c for c in conditional_counts()]
    counts[-1] = F.max("_h").alias("max_horizon")
    out = rows.groupingSets(sets, "source", "regime", "horizon_days").agg(F.grouping_id("source", "regime", "horizon_days").alias("level"), *counts)
    return out.where((F.col("level") != 0) | (F.col("total") >= min_n))


def trade_metrics(df: DataFrame, keys, horizon: int, tie) -> DataFrame:
    """Win rate, averages, profit factor, annualised Sharpe, drawdown of the dated path, false positives."""
    win, loss = is_("WIN"), is_("LOSS", "STOP_LOSS")
    mean_if = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("return_pct"))), F.lit(0.0))
    sum_if = lambda cond: F.sum(F.when(cond, F.col("return_pct")))
    sd = F.coalesce(F.stddev_samp("return_pct"), F.lit(0.0))
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(is_("NEUTRAL")).alias("neutrals"),
        F.avg(win.cast("double")).alias("win_rate"), F.avg("return_pct").alias("avg_return"), F.percentile("return_pct", F.lit(0.5)).alias("median_return"),
        mean_if(win).alias("avg_win"), mean_if(loss).alias("avg_loss"),
        ratio(F.coalesce(sum_if(win), F.lit(0.0)), F.abs(sum_if(loss))).alias("profit_factor"),
        F.when(sd > 0, F.avg("return_pct") / sd * (252 / max(horizon, 1)) ** 0.5).otherwise(0.0).alias("sharpe"),
        F.coalesce(ratio(F.count_if(loss), F.count_if(win | loss)), F.lit(0.0)).alias("false_positive_rate"),
    )
    growth = F.log1p(clamp("return_pct", -95.0, 95.0) / 100)
    fall = worst_drawdown(df.withColumn("_g", growth), keys, "date", tie, "_g")
    return stats.join(fall, list(keys))


def segment_metrics(df: DataFrame, segment: Column, horizon: int, tie, min_n: int = 5) -> DataFrame:
    """trade_metrics per segment value, thin segments dropped, with the most common regime (ties by name)."""
    rows = df.withColumn("segment", segment).where(F.col("segment").isNotNull())
    common = rows.groupBy("segment", "regime").agg(F.count("*").alias("_n")).groupBy("segment").agg(
        F.min_by("regime", F.struct(-F.col("_n"), "regime")).alias("modal_regime"))
    return trade_metrics(rows, ["segment"], horizon, tie).where(F.col("total") >= min_n).join(common, "segment")


def wilson(wins, n, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval in percent; NULL without trials."""
    wins, n = col(wins), col(n)
    p, z2 = ratio(wins, n), z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return 100 * F.greatest(F.lit(0.0), centre - half), 100 * F.least(F.lit(1.0), centre + half)


def with_uncertainty(df: DataFrame, min_windows: float = 20.0) -> DataFrame:
    """Interval after shrinking the sample to independent windows: dates over the longest horizon."""
    eff = F.when(F.col("dates") > 0, F.col("dates") / F.greatest(F.coalesce("max_horizon", F.lit(1)), F.lit(1)))
    shrink = F.least(F.lit(1.0), eff / F.col("dates"))
    lo, hi = wilson(F.col("wins") * shrink, F.col("decided") * shrink)
    return df.withColumns({"eff_windows": eff, "low_data": F.coalesce(eff < min_windows, F.lit(True)), "win_ci_lo": lo, "win_ci_hi": hi})


def bayes_shrunk_rate(df: DataFrame, key: str, k: float, bearish: Column, min_qualified: int = 10, min_tier: int = 5) -> DataFrame:
    """Win rate shrunk towards the mean of well-tested keys, and a composite of rate, alpha, Sharpe and
    drawdown with tiers. The sign of a bearish key's returns is flipped: it is right when prices fall."""
    resolved = df.where(is_("WIN", "LOSS", "NEUTRAL") & F.col("return_pct").isNotNull())
    raw = resolved.groupBy(key).agg(F.count("*").alias("_n"), F.avg(is_("WIN").cast("double")).alias("_wr"))
    overall = F.coalesce(raw.where(F.col("_n") >= min_qualified).agg(F.avg("_wr")).scalar(), F.lit(0.52))
    signed = resolved.withColumn("_x", F.when(bearish, -F.col("return_pct")).otherwise(F.col("return_pct")))
    stats = signed.groupBy(key).agg(
        F.count("*").alias("n"), F.avg((F.col("_x") > 0).cast("double")).alias("win_rate"),
        F.avg(F.col("_x") - F.col("benchmark_pct")).alias("alpha"),
        F.coalesce(ratio(F.avg("_x"), F.stddev_samp("_x")), F.lit(0.0)).alias("sharpe"), F.min("_x").alias("worst"),
    )
    shrunk = (F.col("n") * F.col("win_rate") + k * overall) / (F.col("n") + k)
    parts = (0.40 * shrunk + 0.30 * clamp((F.coalesce("alpha", F.lit(0.0)) + 5) / 15, 0.0, 1.0)
             + 0.20 * clamp(F.col("sharpe") / 3.0, 0.0, 1.0) + 0.10 * (1 - F.least(F.abs("worst") / 20.0, F.lit(1.0))))
    out = stats.withColumns({"shrunk_rate": shrunk, "composite": parts})
    tier = (F.when(F.col("n") < min_tier, "Unranked").when(F.col("composite") >= 0.70, "A").when(F.col("composite") >= 0.55, "B")
            .when(F.col("composite") >= 0.40, "C").otherwise("D"))
    return out.withColumn("tier", tier)


def bayes_shrunk_rate_pit(df: DataFrame, key: str, snapshots: DataFrame, k: float, prior: float = 0.52) -> DataFrame:
    """Shrunk win rate of each key at each snapshot from outcomes resolved before it.

    Outcomes are folded to one row per key and resolution date, and running sums are read as of the
    snapshot dates: no pairing of outcomes with snapshots.
    """
    daily = df.where(is_("WIN", "LOSS", "NEUTRAL")).groupBy(key, F.col("resolved_on").alias("_d")).agg(
        F.count("*").alias("_n"), F.count_if(is_("WIN")).alias("_w"))
    asked = daily.select(key).distinct().withColumn("_d", F.explode(snapshots.agg(F.array_sort(F.collect_set("as_of"))).scalar()))
    both = daily.unionByName(asked.withColumns({"_n": F.lit(None).cast("bigint"), "_w": F.lit(None).cast("bigint"), "_ask": F.lit(True)}), allowMissingColumns=True)
    # Snapshot rows sort first on their date, so only earlier resolutions are counted.
    w = Window.partitionBy(key).orderBy("_d", F.col("_ask").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"n": F.coalesce(F.sum("_n").over(w), F.lit(0)), "wins": F.coalesce(F.sum("_w").over(w), F.lit(0))}).where("_ask AND n > 0")
    day = Window.partitionBy("_d")
    seen = seen.withColumn("_mean", F.avg(F.when(F.col("n") >= 10, F.col("wins") / F.col("n"))).over(day))
    rate = (F.col("wins") + k * F.coalesce("_mean", F.lit(prior))) / (F.col("n") + k)
    return seen.select(key, F.col("_d").alias("as_of"), "n", "wins", rate.alias("shrunk_rate"))


def beta_priors(df: DataFrame, json_col: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Posterior mean win rate per signal type listed in a JSON array; malformed JSON counts for nothing."""
    types = F.from_json(json_col, "array<struct<type:string>>")
    rows = df.select("outcome", F.explode(types).alias("_s")).where(F.coalesce(F.col("_s.type"), F.lit("")) != "")
    out = rows.groupBy(F.col("_s.type").alias("signal_type")).agg(F.count_if(is_("WIN")).alias("wins"), F.count("*").alias("n"))
    return out.withColumn("posterior", (alpha + F.col("wins")) / (alpha + beta + F.col("n")))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Reliability table in equal-width bins with the Brier score against the base rate's."""
    base = df.agg(F.avg(y)).scalar()
    bucket = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    square = lambda e: e * e
    out = df.groupBy(bucket.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("realised"),
        F.sum(square(F.col(p) - F.col(y))).alias("_b"))
    total, brier = df.agg(F.count("*")).scalar(), df.agg(F.avg(square(F.col(p) - F.col(y)))).scalar()
    return out.select("bin", (F.col("bin") / bins).alias("lo"), "n", "predicted", "realised", brier.alias("brier"), (base * (1 - base)).alias("brier_base"), total.alias("total"))


def decile_table(df: DataFrame, score: str, value: str, tie: str, n: int = 10) -> DataFrame:
    return ntiles(df, [], score, tie, n).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(value).alias("realised"))


def weighted_roc(df: DataFrame, keys, p: str, max_points: int, min_n: int = 1) -> DataFrame:
    """Tie-aware area and curve from outcomes folded to one row per probability, thinned to max_points."""
    # One folded row per probability, so the third sum counts distinct probabilities. The fold and its running sums are
    # read several times, so each is written once.
    folded = written(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count_if(is_("WIN")).alias("w"), F.count_if(is_("LOSS")).alias("l")), "roc-fold")
    rows = written(running_totals(folded, keys, p, {"w": F.sum("w"), "l": F.sum("l"), "v": F.max(F.lit(1))}), "roc-sums")
    keep = (F.col("w_total") > 0) & (F.col("l_total") > 0) & (F.col("w_total") + F.col("l_total") >= min_n)
    rows = rows.where(keep).withColumns({"n": F.col("w_total") + F.col("l_total"), "_points": F.col("v_total"), "_i": F.col("v_total") - F.col("v_before")})
    rank = F.col("w_before") + F.col("l_before") + (F.col("w") + F.col("l") + 1) / 2
    area = (F.sum(F.col("w") * rank) - F.max("w_total") * (F.max("w_total") + 1) / 2) / (F.max("w_total") * F.max("l_total"))
    areas = rows.groupBy(*keys).agg(area.alias("auc"))
    curve = rows.join(areas, list(keys)) if keys else rows.withColumn("auc", areas.scalar())
    step = F.col("_points") / (max_points - 1)
    nearest = F.round(F.round(F.col("_i") / step) * step)
    kept = curve.where((F.col("_points") + 1 <= max_points) | (nearest == F.col("_i")))
    return kept.select(*keys, "auc", "n", ((F.col("l_total") - F.col("l_before")) / F.col("l_total")).alias("fpr"), ((F.col("w_total") - F.col("w_before")) / F.col("w_total")).alias("tpr"))


def auc_by_rank(df: DataFrame, keys, score: str, y: str) -> DataFrame:
    """Mann-Whitney area with average ranks per group of any size."""
    placed = running_totals(df, keys, score, {"_pos": F.sum(F.col(y).cast("bigint")), "_all": F.count("*")})
    rank = F.col("_all_before") + (F.col("_all") + 1) / 2
    n1, n = F.max("_pos_total"), F.max("_all_total")
    return placed.groupBy(*keys).agg(n.alias("n"), ratio(F.sum(F.col("_pos") * rank) - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))


def stratified_auc(df: DataFrame, stratum: str, p: str, y: str, min_stratum: int, min_n: int) -> DataFrame:
    """Size-weighted mean of per-stratum areas; one-class strata drop, thin ones only if there are several."""
    per = auc_by_rank(df, [stratum], p, y)
    strata = per.agg(F.count("*")).scalar()
    kept = per.where(F.col("auc").isNotNull() & ((F.col("n") >= min_stratum) | (strata == 1)))
    return kept.agg(F.sum("n").alias("n"), ratio(F.sum(F.col("n") * F.col("auc")), F.sum("n")).alias("auc"), F.count("*").alias("strata")).where(F.col("n") >= min_n)


def stratified_calibration_slope(df: DataFrame, stratum: str, p: str, y: str, min_stratum: int, min_n: int) -> DataFrame:
    """Brier-optimal shrink of p around one half per stratum, averaged by size."""
    d = F.col(p) - 0.5
    per = df.groupBy(stratum).agg(F.count("*").alias("n"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
                                  F.sum(d * (F.col(y) - 0.5)).alias("_num"), F.sum(d * d).alias("_den"))
    strata = per.agg(F.count("*")).scalar()
    kept = per.where((F.col("_lo") != F.col("_hi")) & (F.col("_den") > 0) & ((F.col("n") >= min_stratum) | (strata == 1)))
    return kept.agg(F.sum("n").alias("n"), ratio(F.sum(F.col("n") * F.col("_num") / F.col("_den")), F.sum("n")).alias("slope"), F.count("*").alias("strata")).where(F.col("n") >= min_n)


def psi(baseline: DataFrame, recent: DataFrame, cols, bins: int = 10) -> DataFrame:
    """Population stability index per column on the baseline's quantile bins.

    Both sides are unpivoted once; the exact cut points come from one aggregate per column.
    """
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_e")).select("_e.*").where("x IS NOT NULL").withColumn("side", F.lit(side))
    base = long(baseline, "b")
    cuts = base.groupBy("column").agg(F.percentile("x", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    rows = base.unionByName(long(recent, "r")).join(cuts, "column")
    counts = rows.groupBy("column", F.size(F.filter("_cuts", lambda c: c <= F.col("x"))).alias("bin")).agg(
        F.count_if(F.col("side") == "b").alias("b"), F.count_if(F.col("side") == "r").alias("r"))
    every = cuts.select("column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["column", "bin"], "left").na.fill(0, ["b", "r"])
    whole = Window.partitionBy("column")
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(1e-6))
    parts = every.select("column", share("b").alias("e"), share("r").alias("a"))
    return parts.groupBy("column").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def drift_status(scores: DataFrame, crit: float, share: float, warn: float) -> DataFrame:
    hot = F.avg((F.col("psi") > crit).cast("double"))
    return scores.agg(F.count("*").alias("columns"), hot.alias("crit_share"), F.max("psi").alias("max_psi"), F.avg("psi").alias("avg_psi")).withColumn(
        "status", F.when(F.col("crit_share") > share, "EMERGENCY_RETRAIN").when((F.col("crit_share") > share / 2) | (F.col("avg_psi") > warn), "WARNING").otherwise("OK"))


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key as an aggregate, so it is partially combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_last(df: DataFrame, keys, order, price: str) -> DataFrame:
    """Session open, high, low and last non-NULL price."""
    seen = df.where(F.col(price).isNotNull())
    at = F.struct(*order)
    return seen.groupBy(*keys).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"))


def top_holders_pivot(df: DataFrame, keys, field: str, fields, value: str, order: str) -> DataFrame:
    """Entity-attribute-value rows to one column per listed field, last value winning."""
    return df.groupBy(*keys).pivot(field, list(fields)).agg(F.max_by(value, order))


def episodes(days: DataFrame, keys, gap: int, date: str = "date") -> DataFrame:
    """Distinct days and separate runs per key: a gap of more than `gap` days starts a new run."""
    unique = days.select(*keys, date).distinct()
    last = F.lag(date).over(Window.partitionBy(*keys).orderBy(date))
    return unique.withColumn("_new", (last.isNull() | (F.datediff(date, last) > gap)).cast("bigint")).groupBy(*keys).agg(
        F.count("*").alias("distinct_days"), F.sum("_new").alias("episodes"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))


def episode_coverage(rows: DataFrame, key: str, gap: int, min_days: int, min_episodes: int) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = episodes(rows, [key], gap).join(sizes, key)
    return out.withColumn("ready", (F.col("distinct_days") >= min_days) & (F.col("episodes") >= min_episodes))


def turnover(selection: DataFrame) -> DataFrame:
    """Mean share of a session's selection that is new against the session before. Needs (idx, symbol)."""
    before = selection.select((F.col("idx") + 1).alias("idx"), "symbol", F.lit(True).alias("_held"))
    sessions = selection.select("idx").distinct()
    counted = sessions.join(sessions.select((F.col("idx") + 1).alias("idx")), "idx", "left_semi")
    daily = selection.join(counted, "idx", "left_semi").join(before, ["idx", "symbol"], "left").groupBy("idx").agg((1 - F.count("_held") / F.count("*")).alias("_new"))
    return daily.agg(F.avg("_new").alias("turnover"), F.count("*").alias("sessions"))


def lift_table(df: DataFrame, flags, up: str = "flyer", down: str = "diver", min_dates: int = 5) -> DataFrame:
    """Per flag: geometric mean over dates of P(flag | up) / P(flag | down) with half-count smoothing, its
    t over dates, and support in both tails."""
    each = F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("on")) for f in flags])
    daily = df.select("date", up, down, F.explode(each).alias("_e")).groupBy("date", F.col("_e.flag").alias("flag")).agg(
        F.count_if(up).alias("nf"), F.count_if(down).alias("nd"), F.count("*").alias("nu"),
        F.count_if(F.col(up) & F.col("_e.on")).alias("pf"), F.count_if(F.col(down) & F.col("_e.on")).alias("pd"), F.count_if("_e.on").alias("pu"))
    both = (F.col("nf") > 0) & (F.col("nd") > 0)
    daily = daily.withColumns({
        "_diff": F.when(both, F.col("pf") / F.col("nf") - F.col("pd") / F.col("nd")),
        "_log": F.when(both, F.log((F.col("pf") + 0.5) / (F.col("nf") + 1.0)) - F.log((F.col("pd") + 0.5) / (F.col("nd") + 1.0))),
    })
    out = daily.groupBy("flag").agg(
        F.exp(F.avg("_log")).alias("lift"), (F.sum("pf") + F.sum("pd")).alias("support"), F.count("_diff").alias("dates"),
        F.avg("_diff").alias("_m"), F.stddev_samp("_diff").alias("_s"), F.sum("pu").alias("_pu"),
        ratio(F.sum("pf") / F.sum("nf"), F.sum("pu") / F.sum("nu")).alias("flyer_lift"),
        ratio((F.sum("pf") + F.sum("pd")) / (F.sum("nf") + F.sum("nd")), F.sum("pu") / F.sum("nu")).alias("movement_lift"))
    t = F.when(F.col("dates") >= min_dates, F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("dates"))).when(F.col("_m") > 0, 99.0).otherwise(0.0)).otherwise(0.0)
    return out.where("_pu > 0").select("flag", "lift", "support", t.alias("direction_t"), "dates", (100 * F.col("_m")).alias("mean_diff_pp"), "flyer_lift", "movement_lift")


def percentile_summary(df: DataFrame, by, value: str, points=(0.5, 0.95)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in points])


def persistence_streak(appearances: DataFrame) -> DataFrame:
    """Distinct screeners times cumulative reliability per symbol, folded per (symbol, screener) first."""
    folded = appearances.groupBy("symbol", "screener_id").agg(F.count("*").alias("_c"), F.sum("reliability").alias("_r"))
    out = folded.groupBy("symbol").agg(F.count("*").alias("screeners"), F.sum("_c").alias("appearances"), F.sum("_r").alias("reliability"))
    return out.withColumn("streak_score", F.col("screeners") * F.col("reliability"))


def membership_features(members: DataFrame, meta: DataFrame) -> DataFrame:
    """Bull and bear counts, category breadth, tier-one count, summed score and mean alpha per symbol."""
    rows = members.join(meta, ["source", "screener_id"])
    bull = F.col("sentiment") == "bullish"
    stats = rows.groupBy("symbol").agg(
        F.count_if(bull).alias("bull_count"), F.count_if(F.col("sentiment") == "bearish").alias("bear_count"),
        F.count_if(F.col("tier").isin("A", "B")).alias("tier1_count"), F.coalesce(F.sum(F.when(bull, F.col("score"))), F.lit(0.0)).alias("momentum_score"),
        F.avg(F.when(bull, F.col("alpha"))).alias("alpha_score"))
    breadth = rows.select("symbol", "category").distinct().groupBy("symbol").agg(F.count("*").alias("category_breadth"))
    return stats.join(breadth, "symbol")


def rank_vote_reliability(sources, outcomes: DataFrame, min_n: int) -> DataFrame:
    """Win rate of each screener over the union of its membership sources."""
    members = sources[0]
    for s in sources[1:]:
        members = members.unionByName(s)
    rows = members.distinct().join(outcomes, ["symbol", "date"])
    out = rows.groupBy("screener_id").agg(F.count_if(is_(*DECIDED)).alias("n"), F.count_if(is_("WIN")).alias("wins"), F.avg("return_pct").alias("avg_return"))
    return out.where(F.col("n") >= min_n).withColumn("win_rate", ratio("wins", "n"))


def bucket_lifts(df: DataFrame, dimensions: dict) -> DataFrame:
    """Win rate and mean result per bucket of every dimension against the base rate."""
    base = df.agg(F.avg(is_("WIN").cast("double"))).scalar()
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), b.cast("string").alias("bucket")) for d, b in dimensions.items()])
    out = df.select("outcome", "return_pct", F.explode(each).alias("_e")).groupBy("_e.dimension", "_e.bucket").agg(
        F.count("*").alias("n"), F.count_if(is_("WIN")).alias("wins"), F.avg("return_pct").alias("avg_pnl"))
    return out.withColumns({"win_rate": ratio("wins", "n"), "lift": ratio(ratio("wins", "n"), base)})


def chance_adjusted_recall(df: DataFrame) -> DataFrame:
    """Movers found inside each rated bucket against what the base rate alone would have put there."""
    out = df.groupBy("date").agg(F.count("*").alias("universe"), F.count_if("mover").alias("movers"), F.count_if("rated").alias("rated"), F.count_if(F.col("mover") & F.col("rated")).alias("hits"))
    return out.withColumns({"expected": F.col("rated") * ratio("movers", "universe"), "recall": ratio("hits", "movers")}).withColumn("over_chance", F.col("hits") - F.col("expected"))


def reward_weights(df: DataFrame, keys, prior: DataFrame, min_n: int, loss: float = 1.5, stop: float = 2.0, neutral: float = -0.05,
                   alpha: float = 0.15, lo: float = 0.3, hi: float = 2.0) -> DataFrame:
    """One moving-average step of each key's weight towards the mean reward of its outcomes, clamped."""
    base = F.col("return_pct") / F.greatest("horizon_days", F.lit(1)) * 10
    reward = F.when(is_("WIN"), base).when(is_("LOSS"), base * loss).when(is_("STOP_LOSS"), base * stop).otherwise(neutral)
    seen = df.where(is_(*DECIDED, "NEUTRAL") & F.col("return_pct").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(reward).alias("mean_reward")).where(F.col("_n") >= min_n)
    out = seen.join(prior, list(keys), "left")
    weight = clamp(F.coalesce("weight", F.lit(1.0)) * (1 - alpha) + F.col("mean_reward") * alpha, lo, hi)
    return out.select(*keys, "mean_reward", weight.alias("weight"), (F.coalesce("sample_count", F.lit(0)) + F.col("_n")).alias("sample_count"))


def pick_audit(picks: DataFrame, last: DataFrame, index_return: Column) -> DataFrame:
    """Hit rate, profit factor, best and worst pick and alpha of each list of picks at the latest prices."""
    rows = picks.join(last, "symbol", "left").withColumn("ret", 100 * (ratio("price", "entry") - 1))
    outcome = F.when(F.col("ret").isNull(), "OPEN").when(F.col("price") <= F.col("stop"), "MISS").when(F.col("price") >= F.col("target"), "HIT").otherwise("OPEN")
    rows = rows.withColumn("_o", outcome)
    gain = lambda cond: F.coalesce(F.nullif(F.sum(F.when(cond, F.abs("ret"))), F.lit(0.0)), F.lit(0.001))
    hits, misses = F.count_if(F.col("_o") == "HIT"), F.count_if(F.col("_o") == "MISS")
    out = rows.groupBy("list").agg(
        F.count("*").alias("picks"), hits.alias("hits"), misses.alias("misses"), F.coalesce(100 * ratio(hits, hits + misses), F.lit(0.0)).alias("hit_rate"),
        F.avg("ret").alias("avg_return"), (gain(F.col("ret") > 0) / gain(F.col("ret") < 0)).alias("profit_factor"),
        F.max_by("symbol", F.struct("ret", "symbol")).alias("best"), F.min_by("symbol", F.struct("ret", "symbol")).alias("worst"))
    return out.withColumn("alpha", F.col("avg_return") - index_return)
