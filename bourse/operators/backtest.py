"""Factor library and the cost-aware rebalancing backtest, for any number of factors in one job."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, ratio, roll
from bourse.operators.asof import asof_join
from bourse.operators.indicators import change, log_change, per_symbol, prev
from bourse.operators.prefix import worst_drawdown
from bourse.operators.xsection import sector_zscore, zscore

YEAR = 252

# Factor name to an expression over a panel row; more come in through `register_factor`.
FACTORS: dict[str, Callable[[], Column]] = {
    "momentum": lambda: F.col("ret_5"),
    "reversal": lambda: -F.col("ret_1"),
    "low_vol": lambda: -F.col("vol"),
    "high_volume": lambda: F.col("vol_ratio"),
    "near_high": lambda: F.col("pct_of_high"),
    "far_from_high": lambda: -F.col("pct_of_high"),
    "illiquid": lambda: -F.col("turnover"),
    "gap_down": lambda: -F.col("gap"),
    "close_location": lambda: F.col("close_loc"),
    "momentum_low_vol": lambda: zscore("ret_5") - zscore("vol"),
    "momentum_sector_neutral": lambda: sector_zscore("ret_5", min_n=3),
    "reversal_volume": lambda: zscore("vol_ratio") - zscore("ret_1"),
}


def register_factor(name: str, expression: Callable[[], Column]) -> None:
    """Add a score to the library: a function returning a Column over the panel."""
    if name in FACTORS:
        raise ValueError(f"factor {name} is already registered")
    FACTORS[name] = expression


def feature_factors(columns) -> dict[str, Callable[[], Column]]:
    """A plain and an inverted score for each listed feature column."""
    plain = {f"feature_{c}": (lambda c=c: F.col(c)) for c in columns}
    return plain | {f"feature_{c}_inverted": (lambda c=c: -F.col(c)) for c in columns}


# The literature and platform factors over a wide panel. Which column each reads, and with which sign.
AS_IT_IS = {
    "momentum_21d": "r21", "momentum_63d": "r63", "momentum_12_1": "r12_1", "high_vol": "vol21", "delivery_pct": "deliv_pct", "near_52w_high": "pct_of_52w_high", "value_earnings_yield": "earnings_yield",
    "value_book_to_price": "book_to_price", "insider_net": "insider_net", "earnings_beat_yoy": "earnings_category_yoy", "earnings_beat_qoq": "earnings_category_qoq", "win_probability": "win_probability",
    "screener_overbought": "rsi14", "screener_near_52w_low": "prox_52w_low", "gap_up": "gap_pct", "delivery_spike": "deliv_spike", "delivery_trend": "deliv_trend", "ticket_size": "ticket_ratio",
    "vendor_composite": "vendor_composite", "screener_breadth": "screener_breadth", "external_score": "external_score",
}
INVERTED = {
    "reversal_5d": "r5", "reversal_21d": "r21", "low_vol": "vol21", "low_idio_vol": "idio_vol", "low_beta": "beta", "low_max_ret": "max_ret_21d", "screener_oversold": "rsi14",
    "screener_below_lower_bb": "bb_pos", "gap_down": "gap_pct",
}
SUMS_OF_Z = {
    "reversal_x_delivery": ("deliv_pct", "-r5", "-vol21"), "momentum_ex_lottery": ("r12_1", "-max_ret_21d", "-vol21"), "value_composite": ("earnings_yield", "book_to_price"),
    "value_x_momentum": ("earnings_yield", "book_to_price", "r12_1"),
    "mean_reversion_14": ("-stoch_d", "-williams_r", "-stoch_k", "-cci", "-di_plus", "-dist_sma20_pct", "-vwap_dist_pct", "-volume_ratio_20d", "-obv_slope", "-atr_pct", "-volume_ratio_5d", "-macd_hist", "-mtf_alignment_score", "-bb_width"),
}
WITHIN_SECTOR = {"value_book_to_price_sn": ("book_to_price",), "value_earnings_yield_sn": ("earnings_yield",), "value_composite_sn": ("earnings_yield", "book_to_price"), "momentum_12_1_sn": ("r12_1",)}
SECTOR_MAPPED = {"value_book_to_price_secmapped": "book_to_price"}


def wide_factors(columns, min_sector: int = 5) -> dict[str, Callable[[], Column]]:
    """The library's factors that a panel with these columns can score, by name; higher is more attractive to hold.

    Sums add standard scores over the date; within a sector a standard score needs `min_sector` names, and names without
    a sector have none.
    """
    held = set(columns)

    def summed(parts, score) -> Callable[[], Column]:
        return lambda: sum((-score(c[1:]) if c.startswith("-") else score(c) for c in parts), F.lit(0.0))

    every: dict[str, tuple[set, Callable[[], Column]]] = {n: ({c}, lambda c=c: F.col(c)) for n, c in AS_IT_IS.items()}
    every |= {n: ({c}, lambda c=c: -F.col(c)) for n, c in INVERTED.items()}
    every |= {n: ({c.lstrip("-") for c in parts}, summed(parts, zscore)) for n, parts in SUMS_OF_Z.items()}
    every |= {n: ({*parts, "sector"}, summed(parts, lambda c: F.when(F.col("sector").isNotNull(), sector_zscore(c, min_n=min_sector)))) for n, parts in WITHIN_SECTOR.items()}
    every |= {n: ({c, "sector"}, lambda c=c: F.when(F.col("sector").isNotNull(), F.col(c))) for n, c in SECTOR_MAPPED.items()}
    return {n: score for n, (needs, score) in every.items() if needs <= held}


def factor_panel(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """The columns the library reads, with the next open and eligibility."""
    w = per_symbol()
    return bars.join(sectors, "symbol", "left").withColumns({
        "ret_1": change(), "ret_5": change("close", 5), "_lr": log_change(), "vol_ratio": ratio("volume", roll(F.avg, "volume", w, 12, 6, skip=1)),
        "pct_of_high": ratio("close", roll(F.max, "close", w, 12, 6)), "turnover": roll(F.avg, F.col("close") * F.col("volume"), w, 6, 3),
        "gap": ratio("open", prev("close")) - 1, "close_loc": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "next_open": F.lead("open").over(w),
    }).withColumn("vol", roll(F.stddev_samp, "_lr", w, 12, 8)).drop("_lr")


def factor_scores(panel: DataFrame, names=None, factors: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Every factor's score per row in long form: (date, symbol, factor, score)."""
    factors = FACTORS if factors is None else factors
    chosen = list(names or factors)
    scored = panel.select("date", "symbol", "next_open", *[factors[f]().alias(f"f_{f}") for f in chosen])
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"f_{f}").alias("score")) for f in chosen])
    return scored.select("date", "symbol", "next_open", F.explode(each).alias("_e")).select("date", "symbol", "next_open", "_e.factor", "_e.score").where("score IS NOT NULL")


def factor_backtest(scores: DataFrame, panel: DataFrame, sessions: DataFrame, every: int, k: int, cost_bps: float = 25.0,
                    long_short: bool = False, missing_exit_pct: float = -100.0, cap: float = 50.0, veto: DataFrame | None = None) -> DataFrame:
    """Equal-weight top-k books rebalanced every `every` sessions, one row per factor and holding period.

    Turnover follows from each name's weights in the order of the formed books. A name without an exit
    price is written off if it never trades again, else left out of the period and the rest scaled up.
    The universe takes the same rule.
    """
    eligible = sessions.join(panel.where("eligible").select("date").distinct(), "date", "left_semi")
    no = F.row_number().over(Window.orderBy("date")) - 1
    grid = eligible.withColumn("_no", no).where(F.col("_no") % every == 0).select("date", (F.col("_no") / every).cast("bigint").alias("period"))
    grid = grid.withColumn("exit_date", F.lead("date").over(Window.orderBy("period"))).where("exit_date IS NOT NULL")

    priced = panel.where(F.col("next_open") > 0)
    alive = priced.groupBy("symbol").agg(F.max("date").alias("_alive"))
    exits = priced.select("symbol", F.col("date").alias("exit_date"), F.col("next_open").alias("_exit"))
    held = panel.where("eligible").select("date", "symbol", "next_open").join(grid, "date")
    held = held.join(exits, ["symbol", "exit_date"], "left").join(alive, "symbol", "left")
    gone = F.col("_exit").isNull() & F.coalesce(F.col("_alive") < F.col("exit_date"), F.lit(True))
    move = clamp((F.col("_exit") / F.col("next_open") - 1) * 100, -cap, cap)
    held = held.where(F.col("next_open") > 0).withColumn("ret", F.when(gone, missing_exit_pct).otherwise(move)).withColumn("_gone", gone)
    universe = held.groupBy("period").agg(F.avg("ret").alias("universe_pct"))

    picks = scores.join(grid.select("date", "period"), "date").join(panel.where("eligible").select("date", "symbol"), ["date", "symbol"], "left_semi").where("next_open IS NOT NULL")
    if veto is not None:
        picks = picks.join(veto.select("date", "symbol"), ["date", "symbol"], "left_anti")
    w = Window.partitionBy("factor", "period")
    picks = picks.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("score"), F.asc("symbol"))), "_n": F.count("*").over(w)}).where(F.col("_n") >= 2 * k)
    side = F.when(F.col("_rn") <= k, 1.0).otherwise(0.0)
    if long_short:
        side = side - F.when(F.col("_rn") > F.col("_n") - k, 1.0).otherwise(0.0)
    book = picks.withColumn("weight", side / k).where("weight <> 0").select("factor", "period", "symbol", "weight")
    # Skipped periods do not reset the book: number the ones that were formed.
    formed = book.select("factor", "period").distinct().withColumn("_seq", F.row_number().over(Window.partitionBy("factor").orderBy("period")))
    book = book.join(formed, ["factor", "period"])
    # A name trades what its weight moves by since the formed book before, and leaves in the next one that lacks it.
    own = Window.partitionBy("factor", "symbol").orderBy("_seq")
    was = F.when(F.lag("_seq").over(own) == F.col("_seq") - 1, F.lag("weight").over(own))
    left = F.coalesce(F.lead("_seq").over(own) != F.col("_seq") + 1, F.lit(True))
    steps = book.select("factor", "_seq", F.abs(F.col("weight") - F.coalesce(was, F.lit(0.0))).alias("_in"), F.when(left, F.abs("weight")).alias("_out"))
    moved = steps.select("factor", F.explode(F.array(F.struct("_seq", F.col("_in").alias("x")), F.struct((F.col("_seq") + 1).alias("_seq"), F.col("_out").alias("x")))).alias("_m"))
    traded = moved.groupBy("factor", "_m._seq").agg(F.coalesce(F.sum("_m.x"), F.lit(0.0)).alias("_traded"))

    result = book.join(held.select("period", "symbol", "ret", "_gone"), ["period", "symbol"], "left").groupBy("factor", "period", "_seq").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("_gross"), F.sum(F.abs("weight")).alias("_all"),
        F.sum(F.when(F.col("ret").isNotNull(), F.abs("weight"))).alias("_used"), F.count("*").alias("n_names"), F.count_if(F.coalesce("_gone", F.lit(False))).alias("missing_exits"))
    out = result.join(traded, ["factor", "_seq"]).join(universe, "period").join(grid, "period")
    gross = F.coalesce(F.col("_gross") * F.col("_all") / F.col("_used"), F.lit(0.0))
    cost = F.col("_traded") * cost_bps / 100
    return out.select("factor", "period", "date", "exit_date", gross.alias("gross_pct"), cost.alias("cost_pct"), (gross - cost).alias("net_pct"), "universe_pct",
                      (F.col("_traded") / 2).alias("turnover"), "n_names", "missing_exits")


def t_stat(c) -> Column:
    return F.when(F.stddev_samp(c) > 0, F.avg(c) / (F.stddev_samp(c) / F.sqrt(F.count(c))))


def summarize_backtest(periods: DataFrame, every: int) -> DataFrame:
    """Per factor: mean results, excess t, growth, Sharpe, drawdown, and years in which it beat the universe."""
    per_year = YEAR / every
    rows = periods.withColumns({"_x": F.col("net_pct") - F.col("universe_pct"), "_g": F.log1p(F.greatest(F.col("net_pct"), F.lit(-99.9)) / 100)})
    yearly = rows.groupBy("factor", F.year("date").alias("_y")).agg(F.avg("_x").alias("_m")).groupBy("factor").agg(
        F.count_if(F.col("_m") > 0).alias("years_positive"), F.count("*").alias("years"))
    stats = rows.groupBy("factor").agg(
        F.count("*").alias("periods"), F.avg("gross_pct").alias("gross_pct"), F.avg("cost_pct").alias("cost_pct"), F.avg("net_pct").alias("net_pct"),
        F.avg("universe_pct").alias("universe_pct"), F.avg("_x").alias("excess_pct"), t_stat(F.col("_x")).alias("excess_t"),
        F.avg((F.col("_x") > 0).cast("double")).alias("share_beating"), F.avg("turnover").alias("turnover"),
        (100 * (F.exp(F.sum("_g") * per_year / F.count("*")) - 1)).alias("cagr_pct"),
        F.when(F.stddev_samp("net_pct") > 0, F.avg("net_pct") / F.stddev_samp("net_pct") * per_year**0.5).alias("sharpe"), F.sum("missing_exits").alias("missing_exits"))
    fall = worst_drawdown(rows, ["factor"], "date", ["period"], "_g")
    return stats.join(yearly, "factor").join(fall, "factor")


def survivorship_fill(panel: DataFrame, official: DataFrame) -> DataFrame:
    """Panel plus the official bars of symbols it lacks altogether, tagged."""
    missing = official.join(panel.select("symbol").distinct(), "symbol", "left_anti")
    return panel.withColumn("filled", F.lit(False)).unionByName(missing.withColumn("filled", F.lit(True)), allowMissingColumns=True)


def pit_regime(index: DataFrame, mean_n: int = 200, vol_n: int = 20, median_n: int = 252, least: int = 120) -> DataFrame:
    """Trend against the long mean and volatility against its own trailing median; NULL while warming up.
    One index series: a row per session."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    mean = roll(F.avg, "close", w, mean_n)
    rows = index.withColumns({"_mean": mean, "_r": F.col("close") / F.lag("close").over(w) - 1})
    rows = rows.withColumn("_rv", roll(F.stddev_samp, "_r", w, vol_n) * YEAR**0.5)
    rows = rows.withColumn("_med", roll(lambda c: F.percentile(c, F.lit(0.5)), "_rv", w, median_n, least))
    label = F.concat(F.when(F.col("close") > F.col("_mean"), "UP").otherwise("DOWN"), F.lit("-"), F.when(F.col("_rv") > F.col("_med"), "HV").otherwise("LV"))
    ready = F.col("_mean").isNotNull() & F.col("_rv").isNotNull() & F.col("_med").isNotNull()
    return rows.select("date", F.when(ready, label).alias("regime"))


def index_benchmark(periods: DataFrame, index: DataFrame) -> DataFrame:
    """The same book against a buyable index: closes as of the entry and exit dates."""
    one = index.select(F.lit(1).alias("_k"), F.col("date").alias("_d"), "close")
    # The index is one series; slices of a year keep its as-of windows apart.
    rows = periods.withColumn("_k", F.lit(1))
    a = asof_join(rows, one.withColumnRenamed("close", "_a"), "_k", "date", "_d", ["_a"], slice_unit="year").drop("matched")
    b = asof_join(a, one.withColumnRenamed("close", "_b"), "_k", "exit_date", "_d", ["_b"], slice_unit="year").drop("matched")
    rows = b.withColumn("_ix", 100 * (ratio("_b", "_a") - 1)).where("_ix IS NOT NULL")
    return rows.groupBy("factor").agg(F.count("*").alias("index_periods"), F.avg("_ix").alias("index_pct"), F.avg(F.col("net_pct") - F.col("_ix")).alias("excess_vs_index"),
                                      t_stat(F.col("net_pct") - F.col("_ix")).alias("excess_t"), F.avg((F.col("net_pct") > F.col("_ix")).cast("double")).alias("share_beating"))


def regime_breakdown(periods: DataFrame, labels: DataFrame, min_periods: int = 12) -> DataFrame:
    """Excess by the regime in force at each rebalance; unlabelled periods are shown, not dropped."""
    rows = asof_join(periods.withColumn("_k", F.lit(1)), labels.withColumn("_k", F.lit(1)).withColumnRenamed("date", "_d"), "_k", "date", "_d", ["regime"], slice_unit="year")
    rows = rows.withColumns({"regime": F.coalesce("regime", F.lit("(unlabelled)")), "_x": F.col("net_pct") - F.col("universe_pct")})
    out = rows.groupBy("factor", "regime").agg(F.count("_x").alias("periods"), F.avg("_x").alias("mean_excess"), t_stat(F.col("_x")).alias("t"), F.avg((F.col("_x") > 0).cast("double")).alias("share_beating"))
    verdict = (F.when(F.col("regime") == "(unlabelled)", "n/a").when(F.col("periods") < min_periods, "LOW-DATA")
               .when(F.col("t") >= 2, "edge").when(F.col("t") <= -2, "negative").otherwise("no edge"))
    return out.withColumn("verdict", verdict)


def result_drift(base: DataFrame, current: DataFrame, bonferroni: float, drift: float = 1.0) -> DataFrame:
    """Two runs side by side: dropped and new factors, verdict flips, drift of t."""
    def verdict(c):
        t = F.col(c)
        return (F.when(t.isNull(), "NO_VERDICT").when(t >= bonferroni, "BONFERRONI_POS").when(t <= -bonferroni, "BONFERRONI_NEG")
                .when(t >= 2, "SIGNIFICANT_POS").when(t <= -2, "SIGNIFICANT_NEG").otherwise("NOT_SIGNIFICANT"))
    a = base.select("factor", F.col("excess_t").alias("t_base"), F.lit(True).alias("_b"))
    b = current.select("factor", F.col("excess_t").alias("t_now"), F.lit(True).alias("_c"))
    rows = a.join(b, "factor", "full").withColumns({"was": verdict("t_base"), "now": verdict("t_now")})
    kind = (F.when(F.col("_c").isNull(), "DROPPED").when(F.col("_b").isNull(), "NEW").when(F.col("was") != F.col("now"), "VERDICT_CHANGE")
            .when(F.abs(F.col("t_now") - F.col("t_base")) > drift, "DRIFT").otherwise("SAME"))
    return rows.select("factor", "t_base", "t_now", "was", "now", kind.alias("kind"))
