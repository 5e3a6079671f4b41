"""Data-quality verdicts, coverage and repair rules."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import ratio


def coverage_reconcile(expected: DataFrame, actual: DataFrame, keys) -> DataFrame:
    """MISSING where an expected key has no row, GHOST where a row has no official key."""
    e, a = expected.select(*keys).withColumn("_e", F.lit(True)), actual.select(*keys).withColumn("_a", F.lit(True))
    status = F.when(F.col("_a").isNull(), "MISSING").when(F.col("_e").isNull(), "GHOST").otherwise("OK")
    return e.join(a, list(keys), "full").select(*keys, status.alias("status"))


def reconcile_overwrite(bars: DataFrame, official: DataFrame, keys=("symbol", "date"), cols=("open", "high", "low", "close")) -> DataFrame:
    """The official bar replaces the vendor's where it is complete; vendor bars without one are ghosts."""
    off = official.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_has"))
    both = bars.join(off, list(keys), "full")
    whole = reduce(lambda x, y: x & y, [F.col(f"_{c}").isNotNull() for c in cols])
    reason = F.when(F.col("_has").isNull(), "GHOST").when(whole, "OFFICIAL").otherwise("OFFICIAL_INCOMPLETE")
    return both.select(*keys, *[F.when(whole, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols], reason.alias("reason"))


def freshness(tables: dict, today, weekdays_only: bool = True) -> DataFrame:
    """Newest date of each table as pass, warn or fail; sparse tables only warn, an empty one fails.
    `tables` maps a name to (frame, date column, warn days, fail days or None)."""
    from bourse.operators.calendar import weekdays_between
    parts = []
    for name, (df, date, warn, fail) in tables.items():
        last = df.agg(F.max(F.col(date).cast("date")).alias("last_date"))
        stale = weekdays_between(F.col("last_date"), today) if weekdays_only else F.datediff(today, "last_date").cast("bigint")
        status = F.when(F.col("last_date").isNull(), "warn" if fail is None else "fail")
        if fail is not None:
            status = status.when(F.col("stale") > fail, "fail")
        parts.append(last.withColumn("stale", stale).select(F.lit(name).alias("table"), "last_date", "stale", status.when(F.col("stale") > warn, "warn").otherwise("pass").alias("status")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def range_bounds(df: DataFrame, rules: dict) -> DataFrame:
    """Rows that break each bound, all in one pass; rules map a name to the condition of a bad row."""
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.count_if(c).alias("bad"), F.count("*").alias("total")) for n, c in rules.items()])
    return df.agg(each.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*").withColumn("status", F.when(F.col("bad") > 0, "fail").otherwise("pass"))


def stuck_value(df: DataFrame, by, value: str) -> DataFrame:
    """Groups in which a column has a single value, from its extremes."""
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("stuck"))
    return out.withColumn("status", F.when(F.col("stuck") & (F.col("total") > 1), "fail").otherwise("pass"))


def provenance_monotonic(df: DataFrame, generated: str, created: str, slack_minutes: int = 5) -> DataFrame:
    late = F.unix_timestamp(generated) > F.unix_timestamp(created) + 60 * slack_minutes
    out = df.where(F.col(generated).isNotNull() & F.col(created).isNotNull()).agg(F.count_if(late).alias("bad"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("total") == 0, "warn").when(F.col("bad") > 0, "fail").otherwise("pass"))


def key_uniqueness(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def case_collisions(df: DataFrame, label: str) -> DataFrame:
    """Labels that differ only in case."""
    seen = df.select(label).distinct().groupBy(F.lower(label).alias("folded")).agg(F.count("*").alias("spellings"), F.array_join(F.array_sort(F.collect_list(label)), ",").alias("labels"))
    return seen.where("spellings > 1")


def null_decay(df: DataFrame, cols, date: str = "date", trailing: int = 6, drop: float = 0.2) -> DataFrame:
    """NULL share of each column per date against its trailing mean; a jump is flagged."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_share")) for c in cols])
    daily = df.groupBy(date).agg(each.alias("_e")).select(date, F.explode("_e").alias("_e")).select(date, "_e.*")
    past = F.avg("null_share").over(Window.partitionBy("column").orderBy(date).rowsBetween(-trailing, -1))
    return daily.withColumn("past_share", past).withColumn("decayed", F.coalesce(F.col("null_share") - F.col("past_share") > drop, F.lit(False)))


def feature_collapse(df: DataFrame, col: str, date: str = "date", trailing: int = 20, ratio_floor: float = 0.5, modal_floor: float = 0.5, modal_ratio: float = 2.0) -> DataFrame:
    """Latest date against trailing medians of filled share, distinct values and share of the commonest value."""
    values = df.groupBy(date, col).agg(F.count("*").alias("_c"))
    daily = values.groupBy(date).agg(
        (F.sum(F.when(F.col(col).isNotNull(), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("filled"), F.count_if(F.col(col).isNotNull()).cast("double").alias("values_seen"),
        F.coalesce(F.max(F.when(F.col(col).isNotNull(), F.col("_c"))) / F.sum(F.when(F.col(col).isNotNull(), F.col("_c"))), F.lit(0.0)).alias("modal"))
    # One row per date: the calendar bounds the ordered window.
    past = Window.orderBy(date).rowsBetween(-trailing, -1)
    med = {f"{c}_med": F.percentile(c, F.lit(0.5)).over(past) for c in ("filled", "values_seen", "modal")}
    rows = daily.withColumns(med | {"_no": F.row_number().over(Window.orderBy(F.desc(date))), "_past": F.count("*").over(past)})
    low = lambda c: (F.col(f"{c}_med") > 0) & (F.col(c) < ratio_floor * F.col(f"{c}_med"))
    trip = (F.col("_past") >= 5) & (low("filled") | low("values_seen") | (F.col("modal") > F.greatest(F.lit(modal_floor), modal_ratio * F.col("modal_med"))))
    return rows.where("_no = 1").select(F.lit(col).alias("column"), date, "filled", "values_seen", "modal", *med, F.coalesce(trip, F.lit(False)).alias("collapsed"))


def latest_integrity(df: DataFrame, key: str, payload: str, declared: str) -> DataFrame:
    """Payload is an object and its declared count equals the array's length."""
    items = F.from_json(F.get_json_object(payload, "$.items"), "array<string>")
    is_object = F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")
    rows = df.select(key, F.coalesce(is_object, F.lit(False)).alias("is_object"), F.size(items).alias("_n"), F.col(declared).alias("_d"))
    return rows.select(key, "is_object", F.coalesce(F.col("_n") == F.col("_d"), F.lit(False)).alias("count_matches"))


def null_sweep(df: DataFrame, cols, exceptions: DataFrame, date: str = "date") -> DataFrame:
    """Columns that are NULL on the whole latest date, entirely or newly, without the documented exceptions."""
    latest = df.agg(F.max(date)).scalar()
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.count_if((F.col(date) == latest) & F.col(c).isNotNull()).alias("filled_latest")) for c in cols])
    out = df.withColumn("_l", latest).agg(each.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    state = F.when(F.col("filled") == 0, "ENTIRELY_NULL").when(F.col("filled_latest") == 0, "NEWLY_NULL")
    return out.withColumn("state", state).where("state IS NOT NULL").join(exceptions.select("column"), "column", "left_anti")


def repair(df: DataFrame) -> DataFrame:
    """Corrected outcome rows with the reason: copied columns nulled, zero returns graded neutral."""
    copied = F.col("return_pct").isNotNull() & F.col("return_pct").eqNullSafe(F.col("copy_of_return"))
    flat = (F.col("return_pct") == 0) & ~F.col("outcome").isin("NEUTRAL", "PENDING")
    reason = F.when(copied, "DUPLICATED_COLUMN").when(flat, "ZERO_RETURN_NOT_NEUTRAL")
    return df.withColumns({"copy_of_return": F.when(~copied, F.col("copy_of_return")), "outcome": F.when(flat, "NEUTRAL").otherwise(F.col("outcome")), "repair": reason})


def orphan_rows(features: DataFrame, bars: DataFrame, keys=("symbol", "date")) -> DataFrame:
    return features.join(bars.select(*keys), list(keys), "left_anti")


CHECKS: dict = {}


def register_check(check_id: str, severity: str):
    """Add a check: a function of a dict of tables to a one-row frame with `bad` and `total`."""
    def add(fn):
        CHECKS[check_id] = (fn, severity)
        return fn
    return add


def verdict_report(tables: dict, checks: dict | None = None) -> DataFrame:
    """One row per registered check, in one union."""
    parts = []
    for check_id, (fn, severity) in (checks if checks is not None else CHECKS).items():
        status = F.when(F.col("bad") == 0, "pass").otherwise("fail" if severity == "critical" else "warn")
        parts.append(fn(tables).select(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"), "bad", "total", status.alias("status")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_history(history: DataFrame, report: DataFrame) -> DataFrame:
    """History with this run appended and rows of checks that no longer exist purged."""
    return history.join(report.select("check_id").distinct(), "check_id", "left_semi").unionByName(report)


def flat_copy_share(rows: DataFrame, by) -> DataFrame:
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(flat.cast("double")).alias("flat_share"))


def check_adjustments(factors: DataFrame, actions: DataFrame, traded: DataFrame, tol: float = 0.02) -> DataFrame:
    """Declared actions on traded dates against derived factors: MATCH, MISMATCH, MISSING, or UNEXPLAINED factors."""
    declared = actions.join(traded.select("symbol", F.col("date").alias("ex_date")), ["symbol", "ex_date"], "left_semi").select("symbol", "ex_date", F.col("factor").alias("expected"))
    both = declared.join(factors.select("symbol", "ex_date", "factor"), ["symbol", "ex_date"], "full")
    status = (F.when(F.col("expected").isNull(), "UNEXPLAINED").when(F.col("factor").isNull(), "MISSING").when(F.abs(ratio("factor", "expected") - 1) > tol, "MISMATCH").otherwise("MATCH"))
    return both.withColumn("status", status)
