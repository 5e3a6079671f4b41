"""Point-in-time joins.

A join on "latest row at or before" is not an equi-join, so it is written as a union of both sides
and a running last value. Keys are cut into time slices: a slice's window sees only its own rows,
and the last value before the slice comes from a small table of slice ends. A key holding a third
of all rows is spread over its slices, and the big side is shuffled once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.operators.calendar import roll_forward


def _edge(backward: bool):
    return (lambda c: F.asc(c)) if backward else (lambda c: F.desc(c))


def asof_join(left: DataFrame, right: DataFrame, by, left_time: str, right_time: str, values, lag_days: int = 0,
              tolerance_days: int | None = None, direction: str = "backward", strict: bool = False,
              prefix: str = "", slice_unit: str = "month", tie=()) -> DataFrame:
    """Attach to each left row the latest right row with `right_time + lag <= left_time` (or the
    earliest at or after it, going forward). `strict` excludes equal times. All left rows are kept;
    the matched time comes back as `<prefix>matched`. Of right rows of one time the last by the columns
    `tie` counts going backward, the first going forward; without `tie` by the values themselves."""
    by = [by] if isinstance(by, str) else list(by)
    if direction == "nearest":
        return _nearest(left, right, by, left_time, right_time, values, lag_days, tolerance_days, prefix, slice_unit, tie)
    back = direction == "backward"
    toward = _edge(back)
    available = F.date_add(right_time, lag_days) if lag_days else F.col(right_time)
    # On equal times the right row must come first to match, or last to be left out.
    right_first = not strict
    fact = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)], available.alias("t"))
    ties = [c for c in (tie or values) if right.schema[c].dataType.typeName() not in ("map", "variant")]
    place = F.struct(available.alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(ties)])
    rights = right.where(available.isNotNull()).select(*by, available.alias("_t"), fact.alias("_v"), place.alias("_p"))
    rights = rights.withColumn("_slice", F.date_trunc(slice_unit, "_t"))
    kept = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lefts = left.select(*by, F.col(left_time).alias("_t"), kept.alias("_l")).withColumn("_slice", F.date_trunc(slice_unit, "_t"))

    ends = rights.groupBy(*by, "_slice").agg((F.max_by if back else F.min_by)("_v", "_p").alias("_end"))
    order = Window.partitionBy(*by).orderBy(toward("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = lefts.select(*by, "_slice").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    carry = ends.unionByName(slices).groupBy(*by, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carry = carry.select(*by, "_slice", F.last("_end", ignorenulls=True).over(order).alias("_carry"))

    both = lefts.select(*by, "_slice", "_t", "_l", F.lit(1 if right_first else 0).alias("_side")).unionByName(
        rights.select(*by, "_slice", "_t", "_v", "_p", F.lit(0 if right_first else 1).alias("_side")), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_slice").orderBy(toward("_t"), F.asc("_side"), toward("_p"))
    found = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where(F.col("_l").isNotNull()).join(carry, [*by, "_slice"], "left")
    found = found.withColumn("_hit", F.coalesce("_in", "_carry"))
    if tolerance_days is not None:
        gap = F.datediff(F.col("_l")[left_time], F.col("_hit")["t"])
        found = found.withColumn("_hit", F.when(F.abs(gap) <= tolerance_days, F.col("_hit")))
    return found.select("_l.*", *[F.col("_hit")[f"v{i}"].alias(f"{prefix}{v}") for i, v in enumerate(values)],
                        F.col("_hit")["t"].alias(f"{prefix}matched"))


def _nearest(left, right, by, left_time, right_time, values, lag_days, tolerance, prefix, unit, tie) -> DataFrame:
    """The closer of the two neighbours; on a tie the earlier one."""
    one = asof_join(left, right, by, left_time, right_time, values, lag_days, tolerance, "backward", False, "_b_", unit, tie)
    two = asof_join(one, right, by, left_time, right_time, values, lag_days, tolerance, "forward", False, "_f_", unit, tie)
    before = F.datediff(left_time, "_b_matched")
    after = F.datediff("_f_matched", left_time)
    earlier = F.col("_b_matched").isNotNull() & (F.col("_f_matched").isNull() | (before <= after))
    pick = lambda c: F.when(earlier, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}"))
    return two.select(*left.columns, *[pick(c).alias(f"{prefix}{c}") for c in [*values, "matched"]])


def window_aggregate(base: DataFrame, events: DataFrame, by: str, base_date: str, event_date: str, value: str, days: int) -> DataFrame:
    """Mean and count of events in [date - days, date) per base row.

    Events and base rows are folded to one row per key and day before the range frame runs, so the
    frame sees at most one row per day; the result is joined back to the base rows on (key, day).
    """
    daily = events.groupBy(by, F.col(event_date).alias("_d")).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    asked = base.select(by, F.col(base_date).alias("_d")).distinct().withColumn("_ask", F.lit(True))
    both = daily.join(asked, [by, "_d"], "full").withColumn("_no", F.datediff("_d", F.lit("1970-01-01")))
    w = Window.partitionBy(by).orderBy("_no").rangeBetween(-days, -1)
    seen = both.select(by, F.col("_d").alias(base_date), "_ask", F.sum("_s").over(w).alias("_sum"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("window_n"))
    seen = seen.where("_ask").select(by, base_date, F.try_divide("_sum", "window_n").alias("window_mean"), "window_n")
    return base.join(seen, [by, base_date], "left")


def trailing_bars(pairs: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """The last n bars at or before each (symbol, as_of), newest first as k = 1."""
    numbered = bars.withColumn("_no", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    at = asof_join(pairs, numbered, "symbol", "as_of", "date", ["_no"])
    steps = at.drop("matched").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_no", F.col("_no") - F.col("k") + 1)
    return steps.join(numbered, ["symbol", "_no"]).drop("_no")


def next_bar(anchors: DataFrame, bars: DataFrame, mode: str) -> DataFrame:
    """AFTER_OPEN: open of the first bar strictly after the anchor; GEQ_CLOSE: close of the first at or after it."""
    value = "open" if mode == "AFTER_OPEN" else "close"
    out = asof_join(anchors, bars.select("symbol", "date", F.col(value).alias("price")), "symbol", "anchor", "date",
                    ["price"], direction="forward", strict=mode == "AFTER_OPEN")
    return out.withColumnRenamed("matched", "bar_date")


def limited_ffill(panel: DataFrame, facts: DataFrame, sessions: DataFrame, by: str, fact_date: str, value: str, limit: int) -> DataFrame:
    """Latest known fact on each session of the panel, NULL once it is more than `limit` sessions old."""
    days = roll_forward(facts.select(fact_date).distinct(), sessions, fact_date).join(sessions.select(F.col("date").alias("session"), "idx"), "session").drop("session")
    placed = facts.join(days.withColumnRenamed("idx", "_from"), fact_date)
    out = asof_join(panel, placed, by, "date", fact_date, [value, "_from"])
    fresh = F.col("idx") - F.col("_from") <= limit
    return out.withColumns({value: F.when(fresh, F.col(value)), "age": F.when(fresh, F.col("idx") - F.col("_from"))}).drop("_from", "matched")


def band_join(left: DataFrame, right: DataFrame, by: str, left_date: str, right_date: str, days: int, how: str = "inner") -> DataFrame:
    """Rows of the same key whose dates differ by at most `days`.

    Dates fall into slots as wide as the band; a right row enters its own slot and both neighbours,
    which makes the band an equi-join on (key, slot) with a residual filter.
    """
    width = 2 * days + 1
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    lefts = left.withColumn("_slot", slot(left_date))
    around = F.sequence(slot(F.date_sub(right_date, days)), slot(F.date_add(right_date, days)))
    rights = right.withColumn("_slot", F.explode(around)).withColumnRenamed(by, "_by")
    on = (lefts[by] == rights["_by"]) & (lefts["_slot"] == rights["_slot"]) & (F.abs(F.datediff(left_date, right_date)) <= days)
    out = lefts.join(rights, on, how)
    return out.select(*[lefts[c] for c in left.columns], *([] if how in ("left_semi", "left_anti") else [rights[c] for c in right.columns if c != by]))


def prefer_source(df: DataFrame, keys, priority: dict, source: str = "source") -> DataFrame:
    """One row per key, from the source of highest precedence."""
    rank = reduce(lambda c, kv: c.when(F.col(source) == kv[0], kv[1]), priority.items(), F.when(F.lit(False), 0)).otherwise(len(priority))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, source)).alias("_r")).select(*keys, "_r.*")


def prior_year_growth(fin: DataFrame, band=(0.05, 11.0)) -> DataFrame:
    """Growth of each symbol's latest period over the row exactly a year earlier on the same basis;
    a ratio outside the band is a pair whose units disagree."""
    before = fin.select("symbol", "basis", F.add_months("period_end", 12).alias("period_end"), F.col("value").alias("prior"))
    both = fin.join(before, ["symbol", "basis", "period_end"]).where((F.col("value") > 0) & (F.col("prior") > 0))
    grown = both.withColumn("growth", F.col("value") / F.col("prior") - 1).where((F.col("growth") + 1).between(*band))
    cols = [c for c in grown.columns if c != "symbol"]
    return grown.groupBy("symbol").agg(F.max_by(F.struct(*cols), F.struct("period_end", "basis")).alias("_r")).select("symbol", "_r.*")


def with_optional(df: DataFrame, columns: dict) -> DataFrame:
    """Declared optional columns that are absent become NULL columns of their type."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})
