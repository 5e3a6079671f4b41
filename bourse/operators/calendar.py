"""Sessions: the trading calendar and arithmetic that counts sessions, never days."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_table(dates: DataFrame, date: str = "date") -> DataFrame:
    """Number the distinct sessions. Input rows shrink to one per date before the single ordered
    window, so that task sees only the calendar (about 250 rows a year)."""
    days = dates.select(F.col(date).alias("date")).distinct()
    return days.select("date", F.row_number().over(Window.orderBy("date")).cast("bigint").alias("idx"))


def session_index(bars: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Attach the session number `idx` to each bar."""
    return bars.join(sessions if sessions is not None else session_table(bars), "date")


def add_sessions(df: DataFrame, sessions: DataFrame, n: int, date: str = "date", out: str = "valid_until") -> DataFrame:
    """The n-th session after a session date; NULL beyond the calendar."""
    here = sessions.select(F.col("date").alias(date), (F.col("idx") + n).alias("_to"))
    there = sessions.select(F.col("date").alias(out), F.col("idx").alias("_to"))
    return df.join(here, date, "left").join(there, "_to", "left").drop("_to")


def roll_forward(df: DataFrame, sessions: DataFrame, date: str = "date", out: str = "session") -> DataFrame:
    """The first session on or after each date: one range of days per session, joined by day."""
    since = F.coalesce(F.date_add(F.lag("date").over(Window.orderBy("date")), 1), F.date_sub("date", 3660))
    spread = sessions.select("date", since.alias("_since"))
    days = spread.select(F.explode(F.sequence("_since", "date")).alias(date), F.col("date").alias(out))
    return df.join(days, date, "left")


def known_date(ts: Column, cutoff_hour: int = 19, zone: str = "Asia/Kolkata") -> Column:
    """Decision date on which a fact is first usable: after the cutoff hour it is the next date."""
    local = F.from_utc_timestamp(ts, zone)
    return F.date_add(local.cast("date"), F.when(F.hour(local) >= cutoff_hour, 1).otherwise(0))


def session_date(ts: Column, rollover_hour: int = 9, zone: str = "Asia/Kolkata") -> Column:
    """Session a moment belongs to: before the rollover hour it is still the previous date."""
    local = F.from_utc_timestamp(ts, zone)
    return F.date_sub(local.cast("date"), F.when(F.hour(local) < rollover_hour, 1).otherwise(0))


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end], as arithmetic on whole weeks plus a remainder of under a week."""
    days = F.datediff(end, start)
    rest = F.filter(F.sequence(F.lit(1), F.lit(6)),
                    lambda i: (i <= days % 7) & (F.weekday(F.dateadd(start, i)) < 5))
    return F.when(days > 0, F.floor(days / 7) * 5 + F.size(rest)).otherwise(0).cast("bigint")
