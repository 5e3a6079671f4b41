"""Blending engine scores into a ranking, gating it, and sizing positions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions import normal
from bourse.functions.frames import clamp, ratio
from bourse.operators.evaluation import to_long
from bourse.operators.indicators import W_START
from bourse.operators.spans import pair_correlation
from bourse.operators.xsection import average_rank, peers, winsorize


def lookup(key, table: dict, default: float) -> Column:
    """A small fixed table of weights as one expression."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(*[F.when(key == k, F.lit(float(v))) for k, v in table.items()], F.lit(float(default)))


def live_engines(engines: DataFrame, min_symbols: int = 50, min_sd: float = 5.0, eps: float = 1e-9) -> DataFrame:
    """Scores of engines that still spread names apart; flat ones carry no ranking information."""
    spread = engines.groupBy("date", "engine").agg(F.count("*").alias("_n"), (F.max("score") - F.min("score")).alias("_r"), F.stddev_pop("score").alias("_s"))
    flat = spread.where((F.col("_n") >= min_symbols) & ((F.col("_r") <= eps) | (F.col("_s") < min_sd)))
    return engines.join(flat, ["date", "engine"], "left_anti")


def blend_scores(engines: DataFrame, weights: DataFrame, keys=("date", "symbol")) -> DataFrame:
    """Weighted mean over the engines present for a symbol, weights renormalised; `coverage` counts them."""
    rows = engines.join(weights.where("weight > 0"), [c for c in ("arm", "date", "engine") if c in weights.columns])
    by = [*(["arm"] if "arm" in rows.columns else []), *keys]
    return rows.groupBy(*by).agg(ratio(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("score"), F.count("*").alias("coverage"))


def screener_score(members: DataFrame, category: dict, subcategory: dict, horizon: dict, fundamentals: DataFrame) -> DataFrame:
    """Sum of bias x category x subcategory x horizon x confidence, scaled by a fundamental multiplier, as a mid-rank."""
    bias = lookup("signal_bias", {"bullish": 1, "bearish": -1}, 0)
    part = bias * lookup("category", category, 0) * lookup("subcategory", subcategory, 1) * lookup("horizon", horizon, 0.95) * F.col("confidence")
    raw = members.groupBy("date", "symbol").agg(F.sum(part).alias("_raw"), F.count_if(F.col("signal_bias") == "bullish").alias("bullish"), F.count_if(F.col("signal_bias") == "bearish").alias("bearish"))
    out = raw.join(fundamentals, "symbol", "left").withColumn("raw", F.col("_raw") * F.coalesce("fund_mult", F.lit(1.0)))
    n = F.count("raw").over(peers("date"))
    return out.withColumn("score", F.when(n == 1, 50.0).otherwise(100 * (average_rank("raw", "date") - 0.5) / n)).drop("_raw", "fund_mult")


def quality_multiplier(piotroski, roe, floor: float = 0.5) -> Column:
    f = F.when(piotroski <= 2, 0.6).when(piotroski <= 4, 0.85).otherwise(1.0)
    return F.greatest(F.lit(floor), f * F.when(roe < 0, 0.8).otherwise(1.0))


def crowding_multiplier(factors: dict, threshold: float = 0.70, discount: float = 0.90) -> Column:
    """Mild discount where one factor explains most of the weighted distance from neutral."""
    parts = [F.coalesce(w * F.abs(F.col(c) - 50.0), F.lit(0.0)) for c, w in factors.items()]
    total = reduce(lambda a, b: a + b, parts)
    return F.when((total > 0) & (F.greatest(*parts) / total > threshold), discount).otherwise(1.0)


def vol_cutoff(df: DataFrame, vol: str, pctile: float = 0.80, least: int = 50) -> DataFrame:
    """(date, _cut): each session's order statistic of volatility, sorted once per session; NULL in a thin one."""
    clean = F.array_sort(F.collect_list(F.when(F.col(vol) > 0, F.col(vol))))
    sessions = df.groupBy("date").agg(clean.alias("_all"))
    at = F.least(F.size("_all") - 1, F.floor(F.size("_all") * F.lit(pctile)).cast("int"))
    return sessions.select("date", F.when(F.size("_all") >= least, F.get("_all", at)).alias("_cut"))


def classify_and_gate(df: DataFrame, factors: dict, least: int = 50, veto_mult: float = 0.7) -> DataFrame:
    """Multipliers, volatility and red-flag vetoes, five labels that need screener coverage, conviction tiers."""
    rows = df.join(vol_cutoff(df, "vol", least=least), "date", "left")
    veto = F.coalesce(F.col("vol") > F.col("_cut"), F.lit(False))
    gated = F.col("score") * quality_multiplier(F.col("piotroski"), F.col("roe")) * crowding_multiplier(factors) * F.when(veto, veto_mult).otherwise(1.0)
    rows = rows.withColumns({"gated": gated, "vol_veto": veto})
    s = F.col("gated")
    label = (F.when(F.col("red_flag"), "Sell").when(F.col("bullish") + F.col("bearish") == 0, "Hold").when(s >= 80, "Strong Buy").when(s >= 70, "Buy")
             .when(s <= 20, "Strong Sell").when(s <= 30, "Sell").otherwise("Hold"))
    rows = rows.withColumn("label", F.when(veto & label.isin("Strong Buy", "Buy"), "Hold").otherwise(label))
    strength = F.when(F.col("label").isin("Strong Buy", "Buy"), s).when(F.col("label").isin("Strong Sell", "Sell"), 100 - s).otherwise(0.0)
    tier = F.when(strength >= 80, "S_ELITE").when(strength >= 65, "A_HIGH").when(strength >= 45, "B_MEDIUM").otherwise("D_MARGINAL")
    return rows.withColumn("conviction", tier).drop("_cut")


def bet_size(p: Column) -> Column:
    z = (p - 0.5) / F.sqrt(p * (1 - p))
    return F.when(p > 0.5, F.when(p >= 1, 1.0).otherwise(clamp(2 * normal.cdf(z) - 1, 0.0, 1.0))).otherwise(0.0)


def position_sizes(df: DataFrame, edge_pct: float = 5.0, gross: float = 1.0, cap: float = 0.10, sector_cap: float = 0.30,
                   cluster_cap: float = 0.35, vol_floor: float = 10.0) -> DataFrame:
    """Bet size over volatility, a cost penalty, then gross, per-name, sector and cluster caps per session."""
    burden = F.col("cost_pct") * 100 / edge_pct
    penalty = (F.when(burden.isNull() | (burden <= 0), 1.0).when(burden >= 1, 0.0).when(burden >= 0.5, 1 - (burden - 0.5) / 0.5).otherwise(1 - 0.3 * burden))
    rows = df.withColumn("raw", F.col("bet") / F.greatest(F.coalesce("vol_pct", F.lit(30.0)), F.lit(vol_floor)) * penalty)
    w = ratio(gross * F.col("raw"), F.sum("raw").over(peers("date")))
    rows = rows.withColumn("weight", F.least(F.lit(cap), F.coalesce(w, F.lit(0.0))))
    for group, top in (("sector", sector_cap), ("cluster", cluster_cap)):
        total = F.sum("weight").over(peers("date", group))
        scale = F.when(F.col(group).isNotNull() & (total > top), top / total).otherwise(1.0)
        rows = rows.withColumn("weight", F.col("weight") * scale)
    return rows


def correlation_clusters(returns: DataFrame, book: DataFrame, threshold: float, min_overlap: int) -> DataFrame:
    """Connected components of a book's names whose correlation reaches the threshold, labelled by their
    first member, however long the chains are."""
    from bourse.operators.graph import component_labels
    pairs = pair_correlation(returns, book, min_overlap).where(F.col("corr") >= threshold).select("a", "b")
    return component_labels(pairs).select(F.col("node").alias("symbol"), F.col("label").alias("cluster"))


def composite_factors(df: DataFrame) -> DataFrame:
    """Quality, momentum, value and risk percentiles per session and their weighted composite, per date and symbol of a panel.

    The factors are ranked as rows of (factor, session), one sort for all of them: a sort for each would hold a session's
    rows in one task as often as there are factors. A row without any factor keeps its place by `_loss`.
    """
    pct = lambda c: F.coalesce(F.max(F.when(F.col("factor") == c, F.col("_p"))), F.lit(50.0))
    falling = ("debt", "_pb", "beta")  # lower is better
    rows = df.withColumns({
        "_mom": F.col("ret_12m") - F.col("ret_1m"), "_ey": F.when(F.col("pe") > 0, 1 / F.col("pe")), "_pb": F.when(F.col("pb") > 0, F.col("pb")),
        "_loss": F.coalesce((F.col("pe") <= 0) | (F.col("pb") <= 0), F.lit(False)),
    })
    long = to_long(rows, ["date", "symbol"], ["piotroski", "roe", "debt", "_mom", "_ey", "_pb", "sharpe", "beta", "_loss"], "factor", "x").where("x IS NOT NULL")
    n, place = F.count("*").over(peers("factor", "date")), average_rank("x", "factor", "date")
    long = long.withColumn("_p", F.when(F.col("factor") == "_loss", F.col("x")).otherwise(100 * (F.when(F.col("factor").isin(*falling), n + 1 - place).otherwise(place) / n)))
    # Dealt first: a task of the ranking meets nearly each date and symbol once, so its own grouping would hold all of its rows again.
    out = long.select("date", "symbol", "factor", "_p").repartition("date", "symbol").groupBy("date", "symbol").agg(
        ((pct("piotroski") + pct("roe") + pct("debt")) / 3).alias("quality"), pct("_mom").alias("momentum"),
        F.when(pct("_loss") > 0, 0.0).otherwise((pct("_ey") + pct("_pb")) / 2).alias("value"), ((pct("sharpe") + pct("beta")) / 2).alias("risk"),
    )
    # Weights of the composite; the macro part is neutral where no macro score exists.
    return out.withColumn("composite", 0.25 * F.col("quality") + 0.30 * F.col("momentum") + 0.20 * F.col("value") + 0.15 * F.col("risk") + 0.10 * 50.0)


def grouped_composite(df: DataFrame, groups: dict, signs: dict | None = None, pct: float = 0.01) -> DataFrame:
    """Mean of group means of signed, winsorised z-scores per session; a row scored on one group counts."""
    rows = df
    for c in [c for g in groups.values() for c in g]:
        rows = winsorize(rows, c, pct, f"_w_{c}", min_n=1)
        mean, sd = F.avg(f"_w_{c}").over(peers("date")), F.stddev_samp(f"_w_{c}").over(peers("date"))
        rows = rows.withColumn(f"_z_{c}", (signs or {}).get(c, 1) * ratio(F.col(f"_w_{c}") - mean, sd))
    def mean_of(cols):
        known = F.filter(F.array(*cols), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    rows = rows.withColumns({f"_g_{g}": mean_of([F.col(f"_z_{c}") for c in cols]) for g, cols in groups.items()})
    rows = rows.withColumn("composite", mean_of([F.col(f"_g_{g}") for g in groups]))
    return rows.select(*df.columns, "composite")


def ic_tilted_weights(base: DataFrame, ics: DataFrame, min_dates: int = 20, cap: float = 0.75) -> DataFrame:
    """Each engine's share times 1 + its past IC (capped, floored at zero), renormalised to the base total."""
    rows = base.join(ics, "engine", "left")
    known = F.coalesce(F.col("dates") >= min_dates, F.lit(False)) & F.col("ic").isNotNull()
    tilted = F.col("weight") * F.when(known, clamp(1 + F.col("ic"), 0.0, 1 + cap)).otherwise(1.0)
    whole = Window.partitionBy()
    return rows.select("engine", (tilted / F.sum(tilted).over(whole) * F.sum("weight").over(whole)).alias("weight"), known.alias("tilted"))


def edge_adjusted_weights(base: DataFrame, verdicts: DataFrame, shrink: float = 0.5) -> DataFrame:
    """Shares of engines graded 'no edge' shrink; missing evidence changes nothing."""
    rows = base.join(verdicts, "engine", "left")
    adjusted = F.col("weight") * F.when(F.col("verdict") == "no edge", shrink).otherwise(1.0)
    whole = Window.partitionBy()
    return rows.select("engine", (adjusted / F.sum(adjusted).over(whole) * F.sum("weight").over(whole)).alias("weight"))


def learned_weights(ic: DataFrame, horizon: int, min_dates: int) -> DataFrame:
    """Per session, engine weights from the mean of ICs whose windows had closed before it. (engine, idx, ic)"""
    w = Window.partitionBy("engine").orderBy("idx").rangeBetween(W_START, -(horizon + 1))
    rows = ic.withColumns({"_m": F.avg("ic").over(w), "_c": F.count("ic").over(w)})
    share = F.when(F.col("_c") >= min_dates, F.greatest(F.col("_m"), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("_w", share)
    total = F.sum("_w").over(peers("idx"))
    return rows.select("engine", "idx", F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count("*").over(peers("idx"))).alias("weight"))


def shadow_arms(engines: DataFrame, weights: dict) -> DataFrame:
    """Re-blend history once per arm: as published, and with each engine dropped."""
    arms = [("published", None)] + [(f"without_{e}", e) for e in weights]
    keep = F.array(*[F.when(F.lit(drop).isNull() | (F.col("engine") != F.lit(drop)), F.lit(name)) if drop else F.lit(name) for name, drop in arms])
    rows = engines.withColumn("weight", lookup("engine", weights, 0)).withColumn("arm", F.explode(F.filter(keep, lambda a: a.isNotNull()))).where("weight > 0")
    return rows.groupBy("arm", "date", "symbol").agg(ratio(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("score"), F.count("*").alias("coverage"))


def control_arms(scores: DataFrame, vol: DataFrame, share: float = 0.2, factor: float = 0.7, seed: int = 0) -> DataFrame:
    """(arm, date, symbol, score) of two controls to (date, symbol, score): `volatility_veto` and `random_control`.

    The veto multiplies the scores of a session's most volatile names, those whose percent rank of `vol` (average over
    ties) is above 1 - share, by `factor`; names without a volatility keep theirs. The control deals a session's scores
    out again to its names, in the order of a hash of seed, date and name, so that only the choice of names is lost.
    """
    day = Window.partitionBy("date")
    rows = scores.join(vol, ["date", "symbol"], "left")
    known = F.count("vol").over(day)
    place = F.rank().over(day.orderBy(F.asc_nulls_last("vol"))) + (F.count("*").over(Window.partitionBy("date", "vol")) - 1) / 2
    veto = rows.select(F.lit("volatility_veto").alias("arm"), "date", "symbol", F.when(F.col("vol").isNotNull() & (place / known > 1 - share), F.col("score") * factor).otherwise(F.col("score")).alias("score"))
    dealt = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("date").cast("string"), "symbol"))
    drawn = scores.select("date", F.row_number().over(day.orderBy(dealt, "symbol")).alias("_n"), "score")
    names = scores.select("date", "symbol", F.row_number().over(day.orderBy("symbol")).alias("_n"))
    control = names.join(drawn, ["date", "_n"]).select(F.lit("random_control").alias("arm"), "date", "symbol", "score")
    return veto.unionByName(control)


def confluence_score(df: DataFrame) -> DataFrame:
    """Screener weight times a presence multiplier, trend, volume, own momentum and fundamentals.

    Fundamental points count over the inputs that exist; a missing input is not a bad one.
    """
    n = F.col("bullish")
    presence = F.when(n >= 7, 2.5).when(n >= 5, 2.0).when(n >= 3, 1.5).otherwise(1.0)
    screen = clamp(F.col("screener_raw") * presence * 1.2, 0.0, 60.0)
    points = lambda cond, x: F.when(cond, x).otherwise(0.0)
    above = F.col("above_sma")
    trend = F.least(F.lit(15.0), points(above, 8.0) + points(F.col("sma_dist_pct") > 5, 2.0) + points(F.col("momentum") > 70, 4.0) + points(F.col("rank_composite") > 60, 4.0))
    v = F.col("volume_ratio")
    volume = F.when(v > 3, 10.0).when(v > 2, 7.0).when(v > 1.5, 5.0).when(v > 1.2, 2.0).otherwise(0.0)
    own = clamp(F.coalesce("momentum", F.lit(50.0)) / 100 * 8, 0.0, 8.0)
    pio, roe, debt, growth = (F.col(c) for c in ("piotroski", "roe", "debt_pct", "revenue_growth"))
    most = points(pio.isNotNull(), 4.0) + points(roe.isNotNull(), 3.0) + points(debt.isNotNull(), 2.0) + points(growth.isNotNull(), 3.0)
    got = (F.when(pio >= 7, 4.0).when(pio >= 5, 2.0).otherwise(0.0) + F.when(roe > 0.20, 3.0).when(roe > 0.12, 1.0).otherwise(0.0)
           + points(debt < 50, 2.0) + F.when(growth > 0.15, 3.0).when(growth > 0.05, 1.0).otherwise(0.0))
    fund = F.when(most > 0, F.least(F.lit(12.0), 12 * got / most))
    total = screen + trend + volume + own + F.coalesce(fund, F.lit(0.0))
    rows = df.withColumns({"screen_part": screen, "trend_part": trend, "volume_part": volume, "fund_part": fund, "confluence": F.least(F.lit(100.0), total / 105 * 100)})
    c = F.col("confluence")
    return rows.withColumns({"tier": F.when(c >= 80, "ELITE").when(c >= 60, "STRONG").when(c >= 40, "MODERATE").otherwise("WEAK"), "net_bearish": F.col("screener_raw") < 0})


def trade_setup(price, atr, score, sessions: int) -> list[Column]:
    """Entry zone, stop and three targets from ATR, scaled by root time, with reward by score."""
    risk = atr * 1.5 * (sessions / 5) ** 0.5
    reward = F.when(score >= 80, 4).when(score >= 60, 3).otherwise(2)
    return [(price - atr * 0.25).alias("entry_low"), (price + atr * 0.25).alias("entry_high"), (price - risk).alias("stop_loss"),
            (price + risk * reward * 0.5).alias("target_1"), (price + risk * reward).alias("target_2"), (price + risk * reward * 1.6).alias("target_3"), (reward * 0.5).alias("reward_risk")]


def piotroski() -> Column:
    """Points from the fundamental columns that exist; an unknown input scores nothing."""
    tests = [F.col("roe") > 0, F.col("op_margin") > 0, (F.col("roe") > 0) & (F.col("op_margin") > 0), F.col("debt_to_equity") < 1.0,
             F.col("current_ratio") >= 1.5, F.col("revenue_growth") > 0, F.col("eps_forward") > F.col("eps_ttm")]
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])


def pead_score() -> Column:
    """Post-announcement drift from -1 to 1; NULL without growth or right before results."""
    yoy, qoq, acc, vol, rs = (F.col(c) for c in ("eps_yoy", "eps_qoq", "eps_acc", "volume_ratio", "rs_rank"))
    a = F.when(yoy > 20, 0.40).when(yoy > 10, 0.25).when(yoy > 0, 0.10).when(yoy > -10, -0.10).when(yoy.isNotNull(), -0.35).otherwise(0.0)
    b = F.when(qoq > 10, 0.20).when(qoq > 0, 0.10).when(qoq < 0, -0.15).otherwise(0.0)
    c = F.coalesce(clamp(acc / 100.0, -0.15, 0.15), F.lit(0.0))
    boost = F.when(vol > 2, 1.30).when(vol > 1.5, 1.15).when(vol < 0.7, 0.80).otherwise(1.0) * (0.7 + F.coalesce(rs, F.lit(50.0)) / 100.0 * 0.6)
    skip = (yoy.isNull() & qoq.isNull()) | F.coalesce(F.col("days_to_results") < 5, F.lit(False))
    return F.when(~skip, clamp((a + b + c) * boost, -1.0, 1.0))


def round_trip_cost(slippage: Column, participation: Column | None = None, intraday: bool = False) -> Column:
    """Statutory charges of a buy and a sell, plus slippage a side that grows with the share of volume taken."""
    # The tariff.
    stt, stamp, exchange, sebi, gst = (0.000125, 0.00003, 0.0000297, 0.000001, 0.18) if intraday else (0.001, 0.00015, 0.0000297, 0.000001, 0.18)
    fees = (exchange + sebi) * (1 + gst)
    impact = slippage * (1 + F.sqrt(participation)) if participation is not None else slippage
    return F.lit(2 * stt + stamp + 2 * fees) + 2 * impact


def book_risk(book: DataFrame, bars: DataFrame, index: DataFrame, sectors: DataFrame) -> DataFrame:
    """Equal-weight book against an index: beta, annual volatility, worst fall, mean pair correlation, largest sector."""
    w = Window.partitionBy("symbol").orderBy("date")
    held = bars.join(book.select("symbol"), "symbol", "left_semi").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    one = Window.orderBy("date")
    market = index.select("date", (F.col("close") / F.lag("close").over(one) - 1).alias("_m"))
    daily = held.groupBy("date").agg(F.avg("ret").alias("_b")).where("_b IS NOT NULL").join(market, "date")
    nav = F.sum(F.log1p("_b")).over(one.rowsBetween(W_START, 0))
    daily = daily.withColumn("_nav", nav).withColumn("_dd", F.exp(F.col("_nav") - F.greatest(F.max("_nav").over(one.rowsBetween(W_START, 0)), F.lit(0.0))) - 1)
    pairs = pair_correlation(held, book, 20).agg(F.avg("corr")).scalar()
    names = book.join(sectors, "symbol").groupBy("sector").agg(F.count("*").alias("_c"))
    return daily.agg(F.count("*").alias("sessions"), (F.covar_samp("_b", "_m") / F.var_samp("_m")).alias("beta"), (100 * F.stddev_samp("_b") * 252**0.5).alias("annual_vol_pct"),
                     (100 * F.min("_dd")).alias("max_drawdown_pct")).withColumns({"avg_pair_corr": pairs, "largest_sector_pct": names.agg(100 * F.max("_c") / F.sum("_c")).scalar()})


def hedge_weights(ic: DataFrame, eta: float, shrink: float, horizon: int) -> DataFrame:
    """Multiplicative expert weights after every session, shrunk to equal; rows (model, idx, member, ic).

    One fold per model over its sessions: the array holds one small struct per session of the calendar.
    """
    per = ic.groupBy("model", "idx").agg(F.array_sort(F.collect_list(F.struct("member", F.coalesce("ic", F.lit(0.0)).alias("ic")))).alias("_g"))
    path = per.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("idx", "_g"))).alias("_path"))
    members = ic.groupBy("model").agg(F.array_sort(F.collect_set("member")).alias("_members"))
    rows = path.join(members, "model")
    n = F.size("_members")
    start = F.transform("_members", lambda m: 1.0 / n)

    def step(w, day):
        grown = F.zip_with(w, F.col("_members"), lambda x, m: x * F.exp(eta / max(horizon, 1) * F.coalesce(F.try_element_at(F.map_from_entries(day["_g"]), m), F.lit(0.0))))
        total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
        return F.transform(grown, lambda x: (1 - shrink) * x / total + shrink / n)

    out = rows.withColumn("_w", F.aggregate("_path", start, step))
    return out.select("model", F.explode(F.arrays_zip("_members", "_w")).alias("_e")).select("model", F.col("_e._members").alias("member"), F.col("_e._w").alias("weight"))


def aci_alpha(covered: DataFrame, target: float, gamma: float) -> DataFrame:
    """Adaptive conformal level per model after its sessions in order; rows (model, idx, miss share)."""
    path = covered.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("idx", "miss"))).alias("_p"))
    level = F.aggregate("_p", F.lit(target), lambda a, d: F.least(F.greatest(a + gamma * (target - d["miss"]), F.lit(0.01)), F.lit(0.5)))
    return path.select("model", level.alias("alpha"), F.size("_p").alias("sessions"))


def cross_source_convergence(views: DataFrame, scores: DataFrame, sources, min_score: float) -> DataFrame:
    """Symbols every source calls bullish and whose score is high enough."""
    agree = views.where(F.col("is_bullish") & F.col("source").isin(list(sources))).select("date", "symbol", "source").distinct()
    agree = agree.groupBy("date", "symbol").agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(sources))).drop("_n")
    return agree.join(scores.where(F.col("score") >= min_score), ["date", "symbol"])


def liquidity_sized(df: DataFrame, participation: float = 0.05, band: float = 0.20, near: float = 0.75, cost_multiple: float = 2.0) -> DataFrame:
    """Quantity after the participation cap, circuit proximity, cost hurdle and lot rounding, with the reason."""
    wanted = F.floor(F.col("target_value") / F.col("price"))
    most = F.floor(F.col("adt_value") * participation / F.col("price"))
    capped = (most > 0) & (wanted > most)
    qty = F.when(capped, most).otherwise(wanted)
    move = F.abs(F.col("move"))
    locked, close = move >= band * 0.95, move >= band * near
    qty = F.when(locked, 0).when(close, F.floor(qty / 2)).otherwise(qty)
    dear = F.col("expected_pct") < cost_multiple * F.col("cost_pct")
    qty = F.when(dear, 0).otherwise(qty)
    reason = F.when(locked, "circuit_locked").when(dear, "cost_hurdle").when(close, "near_circuit").when(capped, "liquidity_capped").otherwise("ok")
    return df.withColumns({"quantity": (F.floor(qty / F.col("lot")) * F.col("lot")).cast("bigint"), "reason": reason})


def inverse_sigma_weights(held: DataFrame, sigma: str, k: int) -> DataFrame:
    """Weights in proportion to 1/sigma scaled to the equal-weight book's gross; unusable sigmas take the median."""
    w = peers("date")
    ok = F.when(F.col(sigma) > 0, F.col(sigma))
    rows = held.withColumn("_s", ok).withColumn("_s", F.coalesce("_s", F.percentile("_s", F.lit(0.5)).over(w), F.lit(1.0)))
    return rows.withColumn("weight", (1 / F.col("_s")) / F.sum(1 / F.col("_s")).over(w) * F.count("*").over(w) / k).drop("_s")
