"""Window frames and guarded aggregates shared by the operators."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series(*keys: str, order: str = "date") -> WindowSpec:
    """One row per (key, session): rows of a key in time order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The last n rows up to (current row - skip)."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def guarded(agg: Column, counted: Column, frame: WindowSpec, min_periods: int) -> Column:
    """Aggregate over a frame, NULL while the frame holds fewer than min_periods values."""
    return F.when(F.count(counted).over(frame) >= min_periods, agg.over(frame))


def roll(fn, c, w: WindowSpec, n: int, min_periods: int | None = None, skip: int = 0) -> Column:
    c = col(c)
    return guarded(fn(c), c, trailing(w, n, skip), n if min_periods is None else min_periods)


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def clamp(c, lo, hi) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def comparable(c: Column) -> Column:
    """A double rounded for comparison between engines.

    Six decimals, after a step that moves exact halves off the rounding edge; two decimals from
    100,000 up, where sums taken in different orders differ further left. Negative zero is zero.
    """
    x = c.cast("double")
    return F.when(F.abs(x) >= 1e5, F.round(x + 1e-5, 2)).otherwise(F.round(x + 3e-10, 6)) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every floating column made comparable."""
    return df.select(
        *[
            comparable(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
