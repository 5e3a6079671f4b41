"""Price preparation: suspect bars, corporate-action factors, back-adjustment, bad prints."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.operators.asof import band_join

IMPLAUSIBLE = 0.60  # largest believable daily move against the previous close


def flag_suspect(bars: DataFrame, max_move: float = IMPLAUSIBLE) -> DataFrame:
    """Reason code of a bar that cannot be right, NULL for a good one. `prev_close` is optional."""
    close, open_, high, low = (F.col(c) for c in ("close", "open", "high", "low"))
    reason = (
        F.when(close.isNull() | (close <= 0) | open_.isNull() | (open_ <= 0), "nonpositive_or_missing_price")
        .when(high < low, "high_below_low")
        .when((close > high * 1.0005) | (close < low * 0.9995), "close_outside_range")
        .when((open_ > high * 1.0005) | (open_ < low * 0.9995), "open_outside_range")
    )
    if "prev_close" in bars.columns:
        before = F.col("prev_close")
        reason = reason.when((before > 0) & (F.abs(close / before - 1) > max_move), "implausible_move")
    return bars.withColumn("suspect_reason", reason)


# Fixed values of the detector: dead band around no change, snap tolerance, price floor.
DEADBAND, SNAP, FLOOR = 0.15, 0.025, 5.0


def clean_ratios() -> list[float]:
    """Ratios a corporate action can have: p/q with both up to ten, and deep splits 1/k and k."""
    small, deep = range(1, 11), (20, 25, 50, 100, 1000)
    ratios = {p / q for p in small for q in small} | {x for k in deep for x in (1 / k, float(k))}
    return sorted(r for r in ratios if abs(r - 1) > DEADBAND)


def detect_adjustments(bars: DataFrame) -> DataFrame:
    """Corporate-action factors seen in single rows (prev_close, open, high, low, close), with a reason
    for every large move that is not one. The factor is snapped to the nearest clean ratio."""
    before = F.col("prev_close")
    rows = bars.where((before > 0) & (F.col("close") > 0)).withColumn("raw", F.col("close") / before)
    rows = rows.where(F.abs(F.col("raw") - 1) > DEADBAND)
    basis = F.when(F.col("open") > 0, F.col("open") / before).otherwise(F.col("raw"))
    rows = rows.withColumn("basis", basis)
    table = F.array(*[F.lit(r) for r in clean_ratios()])
    nearest = F.array_min(F.transform(table, lambda r: F.struct((F.abs(F.col("basis") - r) / r).alias("err"), r.alias("ratio"))))
    rows = rows.withColumn("_near", nearest)
    touches = F.when(F.col("raw") < 1, F.col("high").isNull() | (F.col("high") / before > 1 - DEADBAND)).otherwise(
        F.col("low").isNull() | (F.col("low") / before < 1 + DEADBAND))
    reason = (
        F.when((before < FLOOR) | (F.col("close") < FLOOR), "below_price_floor")
        .when(F.col("high") <= F.col("low"), "circuit_locked_zero_range")
        .when(touches, "range_touches_old_basis")
        .when(F.col("_near")["err"] > SNAP, "not_a_clean_ratio")
    )
    return rows.select("symbol", "date", "raw", "basis", F.when(reason.isNull(), F.col("_near")["ratio"]).alias("factor"), reason.alias("reason"))


def derive_adjustments(bars: DataFrame, declared: DataFrame, abs_tol: float = 0.051, rel_tol: float = 0.002, gap_tol: float = 0.20) -> DataFrame:
    """Factor = prev_close over the preceding session's close where both bars are trusted and they differ;
    a declared factor is taken only where the raw gap agrees with it and no inferred one exists."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.withColumns({"_last": F.lag("close").over(w), "_bad": F.lag("is_suspect").over(w)})
    trusted = rows.where(~F.col("is_suspect") & (F.col("_bad") == F.lit(False)) & (F.col("_last") > 0))
    moved = (F.abs(F.col("prev_close") - F.col("_last")) > abs_tol) & (F.abs(F.col("prev_close") / F.col("_last") - 1) > rel_tol)
    inferred = trusted.where((F.col("prev_close") > 0) & moved).select(
        "symbol", F.col("date").alias("ex_date"), (F.col("prev_close") / F.col("_last")).alias("factor"), F.lit("prev_close").alias("source"))
    seen = trusted.join(declared, (trusted["symbol"] == declared["symbol"]) & (trusted["date"] == declared["ex_date"])).where(
        (F.col("close") > 0) & (F.abs(F.col("close") / F.col("_last") / declared["factor"] - 1) <= gap_tol))
    observed = seen.select(trusted["symbol"], declared["ex_date"], declared["factor"], F.lit("declared_gap").alias("source"))
    return inferred.unionByName(observed.join(inferred, ["symbol", "ex_date"], "left_anti"))


def back_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Multiply prices by the product of all later factors, so the newest bars never change."""
    later = Window.partitionBy("symbol").orderBy(F.desc("date"), F.asc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    # On one date the bar (side 0) precedes the factor (side 1): a bar takes only factors after it.
    events = factors.groupBy("symbol", F.col("ex_date").alias("date")).agg(F.sum(F.log("factor")).alias("_log"))
    both = bars.withColumn("_side", F.lit(0)).unionByName(events.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    out = both.withColumn("multiplier", F.exp(F.coalesce(F.sum("_log").over(later), F.lit(0.0)))).where("_side = 0")
    prices = {c: F.col(c) * F.col("multiplier") for c in ("open", "high", "low", "close") if c in bars.columns}
    return out.withColumns(prices | {"volume": F.col("volume") / F.col("multiplier")}).drop("_side", "_log")


def promote_declared(rejected: DataFrame, bars: DataFrame, declared: DataFrame, days: int = 3, band: float = 0.30,
                     least_move: float = 0.25, persist: int = 3) -> DataFrame:
    """An unclean-ratio rejection becomes a factor when an action is declared near the date and the next
    closes stay near the new level."""
    w = Window.partitionBy("symbol").orderBy("date")
    ahead = F.array(*[F.lead("close", i).over(w) for i in range(1, persist + 1)])
    levels = bars.select("symbol", "date", "close", F.filter(ahead, lambda c: c.isNotNull()).alias("_next"))
    asked = rejected.where((F.col("reason") == "not_a_clean_ratio") & (F.abs(F.col("basis") - 1) > least_move))
    near = band_join(asked, declared.select("symbol", "ex_date").distinct(), "symbol", "date", "ex_date", days, "left_semi")
    kept = near.join(levels, ["symbol", "date"])
    steady = (F.size("_next") >= 2) & F.forall("_next", lambda c: F.abs(c / F.col("close") - 1) <= band)
    return kept.where(steady).select("symbol", "date", F.col("basis").alias("factor"))


def cross_validate_actions(detected: DataFrame, declared: DataFrame, days: int = 5, tol: float = SNAP) -> DataFrame:
    """CONFIRMED, DISAGREEMENT or FILLED for each declared action against detected factors nearby."""
    near = band_join(declared, detected.select("symbol", F.col("ex_date").alias("_d"), F.col("factor").alias("_f")), "symbol", "ex_date", "_d", days)
    agrees = F.abs(F.col("_f") - F.col("factor")) / F.col("factor") <= tol
    found = near.groupBy("symbol", "ex_date").agg(F.max(agrees).alias("_ok"), F.count("*").alias("nearby"))
    status = F.when(F.col("_ok"), "CONFIRMED").when(F.col("nearby") > 0, "DISAGREEMENT").otherwise("FILLED")
    return declared.join(found, ["symbol", "ex_date"], "left").select(*declared.columns, F.coalesce("nearby", F.lit(0)).alias("nearby"), status.alias("status"))


def flag_bad_prints(bars: DataFrame, actions: DataFrame, threshold: float = 0.35, days: int = 3) -> DataFrame:
    """Bars that jump away from both neighbours and are not near a declared action."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.withColumns({"prev_close": F.lag("close").over(w), "next_close": F.lead("close").over(w)})
    off = lambda c: (F.col(c) > 0) & (F.abs(F.col("close") - F.col(c)) / F.col(c) > threshold)
    return band_join(rows.where(off("prev_close") & off("next_close")), actions, "symbol", "date", "ex_date", days, "left_anti")


def flag_level_shifts(bars: DataFrame, actions: DataFrame, threshold: float = 0.75, days: int = 3) -> DataFrame:
    """Single moves too large to be a trade, whether or not they revert, not near a declared action."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.withColumn("prev_close", F.lag("close").over(w))
    wild = (F.col("prev_close") > 0) & (F.col("close") >= 0) & (F.abs(F.col("close") - F.col("prev_close")) / F.col("prev_close") > threshold)
    return band_join(rows.where(wild), actions, "symbol", "date", "ex_date", days, "left_anti")


def fabricated_sessions(bars: DataFrame, share: float = 0.95, min_bars: int = 50) -> DataFrame:
    """Dates on which nearly every bar is flat with no volume, or repeats the symbol's last bar."""
    w = Window.partitionBy("symbol").orderBy("date")
    cols = ("open", "high", "low", "close", "volume")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.lag(c).over(w) for c in cols])
    flat = (F.coalesce("volume", F.lit(0.0)) == 0) & (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    rows = bars.withColumns({"_copy": F.coalesce(same, F.lit(False)), "_flat": F.coalesce(flat, F.lit(False))})
    daily = rows.groupBy("date").agg(F.count("*").alias("bars"), F.avg(F.col("_flat").cast("double")).alias("flat_share"), F.avg(F.col("_copy").cast("double")).alias("copy_share"))
    daily = daily.where(F.col("bars") > min_bars)
    return daily.withColumn("reason", F.when(F.col("flat_share") >= share, "FLAT").when(F.col("copy_share") >= share, "COPY"))
