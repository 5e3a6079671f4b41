"""Ordered computations over groups of any size.

A window ordered over a whole group puts that group into one task. The helpers here cut a group
into ranges of its order column first: a small table of range totals gives each range its starting
offset, and the window then runs inside a range. Where a group's order values repeat, the rows are
folded to one per value before any window; where rows have to be told apart within a value, the ranges
are cut by the pair of value and tie. So neither a hot group nor a hot value lands in one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
STEP = 8  # cut points are searched in two steps of about the square root of their number
SAMPLE = 32  # rows a cut point is picked from, about


def ranges_of(folded: DataFrame, keys, order: str, ranges: int = RANGES) -> DataFrame:
    """Add `_range`, the number of the slice of `order` a row falls into within its group.

    The cut points come from an approximate quantile sketch; they steer only where work runs, not
    the result. The sketch table has one row per group, and AQE broadcasts it when it is small.
    """
    cuts = folded.groupBy(*keys).agg(
        F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 1000).alias("_cuts")
    )
    joined = folded.join(cuts, list(keys)) if keys else folded.withColumn("_cuts", cuts.scalar())
    coarse = F.array(*[F.get("_cuts", F.lit(i - 1)) for i in range(STEP, ranges, STEP)])
    joined = joined.withColumn("_at", F.size(F.filter(coarse, lambda c: c < F.col(order))) * STEP)
    place = F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(STEP)), lambda c: c < F.col(order)))
    return joined.withColumn("_range", place).drop("_cuts", "_at")


def running_totals(df: DataFrame, keys, order: str, sums: dict, ranges: int = RANGES) -> DataFrame:
    """One row per (keys, order value) with each sum, `<name>_before` over all smaller values, and
    `<name>_total` over the group. `keys` must be non-NULL columns."""
    keys = list(keys)
    folded = df.where(F.col(order).isNotNull()).groupBy(*keys, order).agg(*[e.alias(n) for n, e in sums.items()])
    cut = ranges_of(folded, keys, order, ranges)
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_off") for n in sums],
        *[F.sum(f"_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, [*keys, "_range"])
    return joined.withColumns(
        {f"{n}_before": F.col(f"_{n}_off") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}
    ).drop("_range", *[f"_{n}_off" for n in sums])


def average_ranks(df: DataFrame, keys, value: str, out: str = "rank") -> DataFrame:
    """Average-tie ranks of every row within its group, and the group's size `n`."""
    places = running_totals(df, keys, value, {"_c": F.count("*")})
    table = places.select(*keys, value, (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(out), F.col("_c_total").alias("n"))
    return df.join(table, [*keys, value])


def split_ranges(df: DataFrame, keys, order: str, tie, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Add `_range`: the number, in order of (order, tie), of the slice of its group a row falls into.

    As a distributed sort does, cut points are taken from a sample of about ranges * SAMPLE rows per group, picked by a
    hash; they are pairs of order and tie, so rows of one value are cut as well. The sample is bounded and steers only
    where work runs.
    """
    keys, ties = list(keys), [tie] if isinstance(tie, str) else list(tie)
    pair = lambda: F.struct(F.col(order).alias("v"), F.struct(*[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)]).alias("t"))
    want = ranges * SAMPLE
    picked = F.pmod(F.xxhash64(order, *ties), F.greatest(F.col("_size"), F.lit(1))) < want
    if keys:
        sample = df.join(df.groupBy(*keys).agg(F.count("*").alias("_size")), keys).where(picked)
    else:
        sample = df.withColumn("_size", df.agg(F.count("*")).scalar()).where(picked)
    first = (lambda a, b: a > b) if descending else (lambda a, b: a < b)
    before = lambda a, b: first(a["v"], b["v"]) | ((a["v"] == b["v"]) & (a["t"] < b["t"]))
    held = F.array_sort(F.collect_list(pair()), lambda a, b: F.when(before(a, b), F.lit(-1)).when(before(b, a), F.lit(1)).otherwise(F.lit(0)))
    cuts = sample.groupBy(*keys).agg(held.alias("_s"))
    places = F.array(*[F.floor(F.lit(i) * F.size("_s") / F.lit(ranges)).cast("int") for i in range(1, ranges)])
    cuts = cuts.select(*keys, F.transform(places, lambda i: F.get("_s", i)).alias("_cuts"))
    joined = (df.join(cuts, keys) if keys else df.withColumn("_cuts", cuts.scalar())).withColumn("_own", pair())
    coarse = F.array(*[F.get("_cuts", F.lit(i - 1)) for i in range(STEP, ranges, STEP)])
    below = lambda c: before(c, F.col("_own"))
    joined = joined.withColumn("_at", F.size(F.filter(coarse, below)) * STEP)
    place = F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(STEP)), below))
    return joined.withColumn("_range", place).drop("_cuts", "_at", "_own")


def numbered(df: DataFrame, keys, order: str, tie: str, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Add `rn`, the row's place in its group by (order, tie), and `n`, the group's size."""
    keys = list(keys)
    cut = split_ranges(df.where(F.col(order).isNotNull()), keys, order, tie, descending, ranges)
    group = Window.partitionBy(*keys)
    totals = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_c")).select(
        *keys, "_range",
        F.coalesce(F.sum("_c").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(group).alias("n"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(order) if descending else F.asc(order), F.asc(tie))
    joined = cut.join(totals, [*keys, "_range"])
    return joined.withColumn("rn", F.col("_off") + F.row_number().over(inside)).drop("_range", "_off")


def ntiles(df: DataFrame, keys, order: str, tie: str, n: int, out: str = "bucket") -> DataFrame:
    """NTILE(n) by (order, tie) from row numbers: the first (size mod n) buckets get one more row."""
    placed = numbered(df, keys, order, tie)
    small, extra = F.floor(F.col("n") / n), F.col("n") % n
    head = extra * (small + 1)
    bucket = F.when(F.col("rn") <= head, F.ceil(F.col("rn") / (small + 1))).otherwise(
        extra + F.ceil((F.col("rn") - head) / F.greatest(small, F.lit(1)))
    )
    return placed.withColumn(out, bucket.cast("bigint")).drop("rn", "n")


def worst_drawdown(df: DataFrame, keys, date: str, tie, growth) -> DataFrame:
    """Largest fall, in percent, of the compounded path of `growth` (log growth per row) by (date, tie).

    Ranges of rows are folded to their total, lowest prefix, highest prefix and own fall; such summaries combine in
    order whatever the ranges are, so a group, or a single date of it, may hold any number of rows.
    """
    keys = list(keys)
    part = Window.partitionBy(*keys, "_range").orderBy(date, *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = split_ranges(df, keys, date, tie).withColumn("_p", F.sum(growth).over(part)).withColumn("_m", F.max("_p").over(part))
    chunks = rows.groupBy(*keys, "_range").agg(
        F.sum(growth).alias("_total"), F.min("_p").alias("_low"), F.max("_p").alias("_high"),
        F.min(F.col("_p") - F.col("_m")).alias("_own"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    chunks = chunks.withColumn("_peak", F.max(F.col("_base") + F.col("_high")).over(earlier))
    fall = F.least(F.col("_own"), F.col("_base") + F.col("_low") - F.col("_peak"))
    return chunks.groupBy(*keys).agg(((F.exp(F.min(fall)) - 1) * 100).alias("max_drawdown_pct"))
