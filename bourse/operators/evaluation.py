"""Comparisons built on the per-session measurements: verdicts, movers, attribution, rules, studies."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import finite, ratio
from bourse.operators.backtest import t_stat
from bourse.operators.measure import per_date_ic, topk_excess
from bourse.operators.outcomes import auc_by_rank
from bourse.operators.xsection import average_rank, peers, percentile_rank, winsorize


def to_long(df: DataFrame, ids, columns, name: str, value: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*ids, F.explode(each).alias("_e")).select(*ids, "_e.*")


def edge_verdict(panel: DataFrame, scores, horizons, min_names: int = 10, min_symbols: int = 50, min_dates: float = 20.0) -> DataFrame:
    """USABLE or not for every (score, horizon, regime) in one pass; columns fwd_<h> hold the returns."""
    rows = to_long(panel, ["date", "symbol", "regime", *[f"fwd_{h}" for h in horizons]], scores, "score_name", "score")
    rows = rows.select("date", "symbol", "regime", "score_name", "score", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])).alias("_h")).select("*", "_h.*").drop("_h")
    rows = rows.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    rows = rows.withColumn("regime", F.explode(F.array(F.col("regime"), F.lit("ALL"))))
    keys = ["score_name", "horizon", "regime"]
    ic = per_date_ic(rows, "score", "fwd", min_names, 3, keys).groupBy(*keys).agg(F.avg("ic").alias("rank_ic"))
    # A return is above its session's median if at least half of the returns are smaller.
    day = peers(*keys, "date")
    beat = rows.select(*keys, "score", (2 * (F.rank().over(day.orderBy("fwd")) - 1) >= F.count("*").over(day)).cast("int").alias("_y"))
    auc = auc_by_rank(beat, keys, "score", "_y").select(*keys, "n", F.col("auc").alias("hit_auc"))
    dates = rows.select(*keys, "date").distinct().groupBy(*keys).agg(F.count("*").alias("dates"))
    names = rows.select(*keys, "symbol").distinct().groupBy(*keys).agg(F.count("*").alias("symbols"))
    out = auc.join(dates, keys).join(names, keys).join(ic, keys, "left").withColumn("eff_dates", F.col("dates") / F.col("horizon"))
    verdict = (F.when(F.col("symbols") < min_symbols, "DEGENERATE-XS").when(F.col("eff_dates") < min_dates, "LOW-DATA")
               .when(F.col("rank_ic").isNull() | F.col("hit_auc").isNull(), "n/a")
               .when((F.abs("rank_ic") >= 0.03) & (F.col("hit_auc") >= 0.55), "USABLE").otherwise("no edge"))
    return out.withColumn("verdict", verdict)


def mover_separation(features: DataFrame, columns, excess: str, k: int, every: int, min_dates: int) -> DataFrame:
    """Percentile rank of each feature among the k best and worst movers on every h-th session."""
    rows = features.where((F.col("idx") % every == 0) & F.col(excess).isNotNull())
    w = peers("date")
    rows = rows.withColumns({
        "_n": F.count("*").over(w), "_up": F.row_number().over(w.orderBy(F.desc(excess), F.asc("symbol"))),
        "_down": F.row_number().over(w.orderBy(F.asc(excess), F.asc("symbol"))),
    } | {f"p_{c}": percentile_rank(c, "date") for c in columns}).where(F.col("_n") >= 5 * k)
    long = to_long(rows, ["date", "_up", "_down"], [f"p_{c}" for c in columns], "feature", "p")
    daily = long.groupBy("date", "feature").agg(F.avg(F.when(F.col("_up") <= k, F.col("p"))).alias("w"), F.avg(F.when(F.col("_down") <= k, F.col("p"))).alias("l"))
    daily = daily.where("w IS NOT NULL AND l IS NOT NULL").withColumn("s", F.col("w") - F.col("l"))
    out = daily.groupBy(F.substring("feature", 3, 100).alias("feature")).agg(
        F.count("*").alias("n_dates"), F.avg("w").alias("win_rank"), F.avg("l").alias("los_rank"), F.avg("s").alias("separation"),
        t_stat("s").alias("t_separation"), t_stat(F.col("w") - 0.5).alias("t_winners_only"))
    return out.where(F.col("n_dates") >= min_dates)


def compare_rankings(a: DataFrame, b: DataFrame, fwd: DataFrame, k: int) -> DataFrame:
    """Two rankings on their common sessions: mean IC and top-k excess of each, and paired differences."""
    common = a.select("date").distinct().join(b.select("date").distinct(), "date")
    both = a.withColumn("arm", F.lit("a")).unionByName(b.withColumn("arm", F.lit("b"))).join(common, "date").join(fwd, ["date", "symbol"])
    daily = per_date_ic(both, "score", "fwd", 10, 0, ["arm"]).join(topk_excess(both, "score", "fwd", k, ["arm"]).select("arm", "date", "exc_mean"), ["arm", "date"])
    wide = daily.groupBy("date").agg(*[F.max(F.when(F.col("arm") == x, F.col(c))).alias(f"{c}_{x}") for x in "ab" for c in ("ic", "exc_mean")])
    wide = wide.where("ic_a IS NOT NULL AND ic_b IS NOT NULL").withColumns({"_di": F.col("ic_b") - F.col("ic_a"), "_dt": F.col("exc_mean_b") - F.col("exc_mean_a")})
    return wide.agg(F.count("*").alias("dates"), F.avg("ic_a").alias("ic_a"), F.avg("ic_b").alias("ic_b"), F.avg("exc_mean_a").alias("topk_a"), F.avg("exc_mean_b").alias("topk_b"),
                    t_stat("_di").alias("t_ic_diff"), t_stat("_dt").alias("t_topk_diff"))


def selective_accuracy(panel: DataFrame, score: str, fwd: str, tiers, cost: float, horizon: int) -> DataFrame:
    """Hit rate and net excess of the top share of each session, pooled with effective sessions."""
    w = peers("date")
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull()).withColumns({
        "_rn": F.row_number().over(w.orderBy(F.desc(score), F.asc("symbol"))), "_n": F.count("*").over(w), "_x": F.col(fwd) - F.avg(fwd).over(w) - cost})
    rows = rows.withColumn("tier", F.explode(F.array(*[F.lit(float(x)) for x in tiers]))).where(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("tier") * F.col("_n"))))
    daily = rows.groupBy("tier", "date").agg(F.avg((F.col("_x") > 0).cast("double")).alias("hit"), F.avg("_x").alias("x"))
    eff = F.greatest(F.count("*") / F.lit(float(horizon)), F.lit(1.0))
    return daily.groupBy("tier").agg(F.count("*").alias("dates"), F.avg("hit").alias("hit_rate"), F.avg("x").alias("net_excess"),
                                     F.when(F.stddev_samp("x") > 0, F.avg("x") / (F.stddev_samp("x") / F.sqrt(eff))).alias("t_eff"))


def trailing_days(df: DataFrame, p: str, y: str, horizon: int, window: int = 20, least: int = 10) -> DataFrame:
    """(date, _n, _a, _c): rows of a date and summed squared errors of p and of the win rate of the last `window`
    dates whose outcomes had closed; dates without such a rate are left out."""
    daily = df.groupBy("date").agg(F.sum(y).alias("_s"), F.count("*").alias("_n"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_a"))
    w = Window.orderBy("date").rowsBetween(-(window - 1) - horizon, -horizon)
    daily = daily.withColumn("_base", F.when(F.count("*").over(w) >= least, F.sum("_s").over(w) / F.sum("_n").over(w))).where("_base IS NOT NULL")
    c = F.col("_s") * F.pow(1 - F.col("_base"), 2) + (F.col("_n") - F.col("_s")) * F.pow("_base", 2)
    return daily.select("date", "_n", "_a", c.alias("_c"))


def trailing_base(df: DataFrame, p: str, y: str, horizon: int, window: int = 20, least: int = 10) -> DataFrame:
    """Brier of p against the win rate of the last `window` dates whose outcomes had closed, on the same rows."""
    return trailing_days(df, p, y, horizon, window, least).agg(
        F.count("*").alias("dates"), F.sum("_n").alias("n"), (F.sum("_a") / F.sum("_n")).alias("brier"), (F.sum("_c") / F.sum("_n")).alias("brier_trailing_base"),
        ((F.sum("_a") - F.sum("_c")) / F.sum("_n")).alias("diff"))


def trailing_base_interval(df: DataFrame, p: str, y: str, horizon: int, block: int = 5, repeats: int = 200, share: float = 0.95) -> DataFrame:
    """The difference of `trailing_base` with a moving-block bootstrap interval (lo, hi).

    A repetition draws blocks of `block` neighbouring dates until it has as many dates as there are. Draws come from a
    congruential generator over (repetition, block), so reruns agree; at most dates x repetitions rows are joined,
    however many rows lie behind a date.
    """
    days = trailing_days(df, p, y, horizon).withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    n = days.agg(F.count("*").cast("bigint")).scalar()
    size = F.least(F.lit(block).cast("bigint"), n)
    draws = df.sparkSession.range(repeats).select(F.col("id").alias("_r"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / F.lit(block)) - 1)).alias("_j"))
    # Multiplier, increment and modulus of a common congruential generator, applied twice.
    step = lambda x: (x * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)
    drawn = F.floor(step(step(F.col("_r") * 1000003 + F.col("_j"))) / 65536).cast("bigint")
    places = draws.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1))).where(F.col("_j") * block + F.col("_k") < n)
    places = places.select("_r", (drawn % (n - size + 1) + F.col("_k")).alias("_i"))
    each = places.join(days, "_i").groupBy("_r").agg(((F.sum("_a") - F.sum("_c")) / F.sum("_n")).alias("_d"))
    edge = (1 - share) / 2
    interval = each.agg(F.struct(F.percentile("_d", F.lit(edge)).alias("lo"), F.percentile("_d", F.lit(1 - edge)).alias("hi"))).scalar()
    return days.agg(((F.sum("_a") - F.sum("_c")) / F.sum("_n")).alias("diff")).withColumn("_e", interval).select("diff", "_e.lo", "_e.hi")


def classify_causes(calls: DataFrame) -> DataFrame:
    """Why each call hit or missed, first reason that applies."""
    x = F.col
    cause = (F.when(~(x("excess") < 0), "HIT").when(x("unfillable"), "UNFILLABLE").when(x("has_exdate"), "EVENT")
             .when(x("stop_hit") & (x("target_after_stop") | (x("gross_excess") >= 0)), "STOP_TOO_TIGHT").when(x("gross_excess") >= 0, "COST")
             .when(x("excess_2h") > 0, "TOO_SLOW").when((x("idio") >= 0) & (x("sector_rel") < 0), "SECTOR_DRAG").otherwise("WRONG_PICK"))
    return calls.withColumn("cause", cause)


def attribute_calls(calls: DataFrame, bars: DataFrame, horizon: int, cost: float, min_sector: int = 5) -> DataFrame:
    """Attribute calls of a panel that carries fwd, fwd2, sector, stop, target, is_buy and has_exdate.

    The path facts come from the entry's holding window, an array of `horizon` bars.
    """
    from bourse.operators.labels import holding_windows
    day, sector = peers("date"), peers("date", "sector")
    mean = F.when(F.count("fwd").over(sector) >= min_sector, F.avg("fwd").over(sector)).otherwise(F.avg("fwd").over(day))
    rows = calls.withColumns({"_u": F.avg("fwd").over(day), "_u2": F.avg("fwd2").over(day), "_s": mean}).where("is_buy AND fwd IS NOT NULL")
    rows = holding_windows(rows, bars, horizon)
    b = F.col("bars")
    stop_at = F.array_min(F.transform(F.filter(b, lambda x: x["low"] <= F.col("stop")), lambda x: x["at"]))
    later = F.exists(b, lambda x: (x["at"] >= F.col("_stop_at")) & (x["high"] >= F.col("target")))
    first = F.get(b, F.lit(0))
    locked = (first["open"] == first["high"]) & (first["high"] == first["low"]) & (first["low"] == first["close"]) & (first["open"] > F.col("close"))
    rows = rows.withColumn("_stop_at", stop_at).withColumns({
        "excess": F.col("fwd") - cost - F.col("_u"), "gross_excess": F.col("fwd") - F.col("_u"), "excess_2h": F.col("fwd2") - cost - F.col("_u2"),
        "sector_rel": F.col("_s") - F.col("_u"), "idio": F.col("fwd") - F.col("_s"), "unfillable": F.coalesce(locked, F.lit(False)),
        "stop_hit": F.col("_stop_at").isNotNull(), "target_after_stop": F.coalesce(later, F.lit(False))})
    return classify_causes(rows).drop("_u", "_u2", "_s", "_stop_at", "bars")


def cause_mix(attributed: DataFrame, by, horizon: int, min_calls: int = 10) -> DataFrame:
    """Hit rate, mean excess per session and effective t per bucket."""
    daily = attributed.groupBy(*by, "date").agg(F.avg("excess").alias("_x"), F.count("*").alias("_c"), F.count_if(F.col("cause") == "HIT").alias("_h"))
    eff = F.greatest(F.count("*") / F.lit(float(horizon)), F.lit(1.0))
    out = daily.groupBy(*by).agg(F.sum("_c").alias("calls"), F.count("*").alias("dates"), (F.sum("_h") / F.sum("_c")).alias("hit_rate"), F.avg("_x").alias("mean_excess"),
                                 F.when(F.stddev_samp("_x") > 1e-12, F.avg("_x") / (F.stddev_samp("_x") / F.sqrt(eff))).alias("t_eff"))
    return out.where(F.col("calls") >= min_calls)


def engine_hit_rate(movers: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """Share of each session's movers that a ranking held in its top n one session earlier, and false calls."""
    top = ranks.where(F.col("rank") <= n).select("engine", "symbol", (F.col("idx") + 1).alias("idx"), F.lit(True).alias("_called"))
    graded = ranks.select("engine", (F.col("idx") + 1).alias("idx")).distinct()
    asked = movers.join(graded, "idx").join(top, ["engine", "idx", "symbol"], "left")
    daily = asked.groupBy("engine", "idx").agg(F.count("*").alias("movers"), F.count("_called").alias("held"))
    calls = top.groupBy("engine", "idx").agg(F.count("*").alias("calls"))
    out = daily.join(calls, ["engine", "idx"])
    return out.withColumns({"hit_rate": ratio("held", "movers"), "missed": F.col("movers") - F.col("held"), "false_calls": F.col("calls") - F.col("held")})


def day_level_rule(rows: DataFrame, selected: Column, ret: str, cost: float, horizon: int = 1, turnover: str | None = None) -> DataFrame:
    """Basket minus cost minus universe per day, its t, and how much money the median basket could take."""
    daily = rows.where(F.col(ret).isNotNull()).groupBy("date").agg(
        F.avg(F.when(selected, F.col(ret))).alias("_b"), F.avg(ret).alias("_u"), F.count_if(selected).alias("_n"),
        F.sum(F.when(selected, F.col(turnover) if turnover else F.lit(0.0))).alias("_cap")).where("_n > 0")
    x = F.col("_b") - cost - F.col("_u")
    return daily.withColumn("_x", x).agg(F.count("*").alias("days"), F.avg("_n").alias("avg_names"), F.avg("_x").alias("net_excess"), t_stat("_x").alias("t"),
                                         F.avg((F.col("_x") > 0).cast("double")).alias("win_share"), F.percentile("_cap", F.lit(0.5)).alias("capacity"))


def combo_search(rows: DataFrame, flags, max_size: int, ret: str, cost: float, min_days: int) -> DataFrame:
    """Day-level result of every AND of up to max_size flags; a row enters only the sets of its own true flags."""
    sets = [c for size in range(1, max_size + 1) for c in combinations(flags, size)]
    universe = rows.where(F.col(ret).isNotNull()).groupBy("date").agg(F.avg(ret).alias("_u"))
    member = F.array(*[F.when(reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in c]), F.lit("+".join(c))) for c in sets])
    hits = rows.where(F.col(ret).isNotNull()).select("date", ret, F.explode(F.filter(member, lambda m: m.isNotNull())).alias("combo"))
    daily = hits.groupBy("combo", "date").agg(F.avg(ret).alias("_b"), F.count("*").alias("_n")).join(universe, "date").withColumn("_x", F.col("_b") - cost - F.col("_u"))
    return daily.groupBy("combo").agg(F.count("*").alias("days"), F.sum("_n").alias("picks"), F.avg("_x").alias("net_excess"), t_stat("_x").alias("t")).where(F.col("days") >= min_days)


def provider_consistency(scores: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Rank correlation, agreement and divergence of every two providers' scores (a few providers)."""
    ranked = scores.withColumn("_p", percentile_rank("score", "provider", "date")).where("date IS NOT NULL AND symbol IS NOT NULL")
    given = ranked.groupBy("date", "symbol").agg(F.collect_list(F.struct("provider", "_p")).alias("_g"))
    pairs = given.withColumn("_a", F.explode("_g")).withColumn("_b", F.explode("_g")).where("_a.provider < _b.provider")
    pairs = pairs.select(F.col("_a.provider").alias("a"), F.col("_b.provider").alias("b"), F.col("_a._p").alias("x"), F.col("_b._p").alias("y"))
    same = ((F.col("x") >= high) & (F.col("y") >= high)) | ((F.col("x") <= low) & (F.col("y") <= low))
    apart = ((F.col("x") >= high) & (F.col("y") <= low)) | ((F.col("x") <= low) & (F.col("y") >= high))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), finite(F.corr("x", "y")).alias("rank_corr"), F.avg(same.cast("double")).alias("agreement"), F.avg(apart.cast("double")).alias("divergence"))


def event_study(events: DataFrame, bars: DataFrame, hold: int, cost: float, min_cohort: int) -> DataFrame:
    """Events in cohorts: quintiles by growth rank, next-open entry, exit `hold` sessions later, net of cost.

    Events need (symbol, idx, growth); consecutive weeks merge until a cohort is large enough.
    """
    w = Window.partitionBy("symbol").orderBy("idx")
    path = bars.select("symbol", "idx", (F.first("open").over(w.rangeBetween(1 + hold, 1 + hold)) / F.first("open").over(w.rangeBetween(1, 1)) - 1).alias("ret"))
    rows = events.join(path, ["symbol", "idx"]).where("ret IS NOT NULL AND growth IS NOT NULL")
    # One row per session before the ordered window: the calendar bounds it.
    sizes = rows.groupBy("idx").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sizes.select("idx", F.floor(F.col("_before") / min_cohort).alias("cohort")), "idx")
    c = peers("cohort")
    rows = rows.withColumns({"_rn": F.row_number().over(c.orderBy("growth", "symbol", "idx")), "_n": F.count("*").over(c)}).withColumn("_q", F.ceil(F.col("_rn") * 5 / F.col("_n")))
    per = rows.where("_n >= 5").groupBy("cohort").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("_q") == 5, F.col("ret"))).alias("_top"), F.avg(F.when(F.col("_q") == 1, F.col("ret"))).alias("_bot"), F.avg("ret").alias("_all"))
    return per.select("cohort", "n", (F.col("_top") - cost).alias("long_net"), (F.col("_top") - cost - F.col("_all")).alias("excess_net"), (F.col("_top") - F.col("_bot") - 2 * cost).alias("spread_net"))


def pooled(cohorts: DataFrame, value: str, least: int, bar: float = 1.65) -> DataFrame:
    out = cohorts.agg(F.count(value).alias("cohorts"), F.avg(value).alias("mean"), t_stat(value).alias("t"))
    return out.withColumn("verdict", F.when(F.col("cohorts") < least, "LOW-DATA").when(F.col("t") >= bar, "t >= bar").otherwise("t < bar"))


def journal_grading(trades: DataFrame, bars: DataFrame, cost: float, pct: float = 0.01) -> DataFrame:
    """Fill to close minus cost minus the winsorised universe mean, averaged per date, then t and win rate."""
    day = winsorize(bars.withColumn("_r", ratio("close", "open") - 1), "_r", pct, "_w").groupBy("date").agg(F.avg("_w").alias("_u"))
    rows = trades.join(bars.select("symbol", "date", "close"), ["symbol", "date"]).join(day, "date")
    daily = rows.groupBy("date").agg(F.avg(F.col("close") / F.col("fill") - 1 - cost - F.col("_u")).alias("_x"), F.count("*").alias("_n"))
    se = F.stddev_samp("_x") / F.sqrt(F.count("*"))
    return daily.agg(F.count("*").alias("dates"), F.sum("_n").alias("trades"), F.avg("_x").alias("mean"), (F.avg("_x") / se).alias("t"), (F.avg("_x") - 1.96 * se).alias("ci_lo"), (F.avg("_x") + 1.96 * se).alias("ci_hi"),
                     F.avg((F.col("_x") > 0).cast("double")).alias("win_rate"))


def admission_screen(panel: DataFrame, columns, fwd: str, cutoff: Column, min_ic: float, min_t: float) -> DataFrame:
    """Columns whose rank correlation before the first test block is strong enough to admit."""
    rows = to_long(panel.where(F.col("date") < cutoff), ["date", "symbol", fwd], columns, "column", "x")
    ic = per_date_ic(rows, "x", fwd, 10, 3, ["column"]).groupBy("column").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), t_stat("ic").alias("t"))
    return ic.withColumn("admitted", (F.abs("mean_ic") >= min_ic) & (F.abs("t") >= min_t))


def tenure_mover_study(state: DataFrame, moves: DataFrame, metrics, n: int) -> DataFrame:
    """State of the day before of each session's top-n gainers against the universe, per metric with t over dates."""
    w = peers("idx")
    rows = moves.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("ret"), F.asc("symbol"))))
    before = state.withColumn("idx", F.col("idx") + 1)
    both = rows.join(before, ["symbol", "idx"])
    daily = to_long(both, ["idx", "_rn"], metrics, "metric", "v").groupBy("metric", "idx").agg(F.avg(F.when(F.col("_rn") <= n, F.col("v"))).alias("_top"), F.avg("v").alias("_all"))
    daily = daily.withColumn("_d", F.col("_top") - F.col("_all"))
    return daily.groupBy("metric").agg(F.count("_d").alias("dates"), F.avg("_top").alias("gainers"), F.avg("_all").alias("universe"), t_stat("_d").alias("t"))


def tier_grading(panel: DataFrame, score: str, fwd: str, tiers: dict, horizon: int) -> DataFrame:
    """Per tier: mean IC with effective t, and top decile against the mean and the median."""
    rows = panel.withColumn("tier", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tiers.items()]), lambda x: x.isNotNull())))
    rows = rows.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    ic = per_date_ic(rows, score, fwd, 10, 0, ["tier"])
    eff = F.greatest(F.count("*") / F.lit(float(horizon)), F.lit(1.0))
    graded = ic.groupBy("tier").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), F.when(F.stddev_samp("ic") > 0, F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(eff))).alias("t_eff"))
    w = peers("tier", "date")
    top = rows.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc(score), F.asc("symbol"))), "_n": F.count("*").over(w)})
    daily = top.groupBy("tier", "date").agg(F.avg(F.when(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), F.col(fwd))).alias("_t"), F.avg(fwd).alias("_m"), F.percentile(fwd, F.lit(0.5)).alias("_d"))
    return graded.join(daily.groupBy("tier").agg(F.avg(F.col("_t") - F.col("_m")).alias("top_vs_mean"), F.avg(F.col("_t") - F.col("_d")).alias("top_vs_median")), "tier")


def layer_ablation(panel: DataFrame, layers: dict, fwd: str) -> DataFrame:
    """Mean IC after each cumulative layer; `layers` maps names to score columns in order."""
    rows = to_long(panel, ["date", "symbol", fwd], list(layers.values()), "layer", "score").where("score IS NOT NULL")
    ic = per_date_ic(rows, "score", fwd, 10, 0, ["layer"])
    order = F.coalesce(*[F.when(F.col("layer") == c, i) for i, c in enumerate(layers.values())])
    out = ic.groupBy("layer").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic")).withColumn("step", order)
    return out.withColumn("gain", F.col("mean_ic") - F.lag("mean_ic").over(Window.orderBy("step")))


def portfolio_alignment(signal: DataFrame, holdings: DataFrame, direction: int, min_rows: int = 30) -> DataFrame:
    """Price correlation and co-movement of a signal's symbol with each holding, with hedge and alignment flags."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = holdings.join(signal.select("date", F.col("close").alias("_s")), "date").withColumns({"_dh": F.col("close") - F.lag("close").over(w), "_ds": F.col("_s") - F.lag("_s").over(w)})
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), finite(F.corr("close", "_s")).alias("correlation"), (100 * F.avg((F.signum("_dh") == F.signum("_ds")).cast("double"))).alias("co_movement_pct"),
                                     F.max_by("_dh", "date").alias("_last")).where(F.col("n") >= min_rows)
    return out.withColumns({"hedge": F.col("correlation") < -0.3, "aligned": F.signum("_last") == direction}).drop("_last")


def alignment_score(pairs: DataFrame) -> DataFrame:
    """50 plus up to 30 for alignment plus up to 20 for diversification."""
    raw = 50 + F.avg(F.col("aligned").cast("double")) * 30 + F.greatest(F.lit(0.0), 20 - F.avg(F.abs("correlation")) * 100)
    return pairs.agg(F.count("*").alias("holdings"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).alias("alignment"))
