"""Exact percentiles over growing and sliding frames, n log n per key.

Values of a key, in order, become a wavelet matrix: per bit of their ranks one array of running counts. With it the k-th
smallest value of any stretch of rows is read off in one step per bit, for all rows at once. A window aggregate would
sort or count each frame anew.
"""

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        self.sorted, codes = np.unique(values, return_inverse=True)
        self.zeros: list[np.ndarray] = []
        self.bits = max(1, int(len(self.sorted) - 1).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            ones = (codes >> bit & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~ones)))
            codes = np.concatenate([codes[~ones], codes[ones]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[left:right], for arrays of each."""
        code = np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            from_, to = zeros[left], zeros[right]
            up = k >= to - from_
            k = np.where(up, k - (to - from_), k)
            left, right = np.where(up, zeros[-1] + left - from_, from_), np.where(up, zeros[-1] + right - to, to)
            code = 2 * code + up
        return self.sorted[code]


def frame_percentiles(values: np.ndarray, left: np.ndarray, right: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Interpolated percentiles of values[left[i]:right[i]], one row per frame; NaN where a frame is empty."""
    out = np.full((len(left), len(shares)), np.nan)
    n = right - left
    some = np.flatnonzero(n > 0)
    if len(some):
        matrix = WaveletMatrix(values)
        for j, share in enumerate(shares):
            at = share * (n[some] - 1)
            low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
            a, b = (matrix.kth(left[some], right[some], k) for k in (low, high))
            out[some, j] = np.where(a == b, a, (high - at) * a + (at - low) * b)
    return out


def with_percentiles(rows: DataFrame, key: str, order: str, value: str, shares: Sequence[float], out: str, n: str, days: int | None = None) -> DataFrame:
    """rows with `out`, the percentiles of `value` up to each row of its key in order of `order`, and `n`, the values in the frame.

    Without `days` a frame is all rows up to this one; with it, the rows dated from `days` before up to the row's date.
    Nulls are no values; `out` is null over an empty frame. A key's rows meet in one task: a few numbers per session.
    """

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        known = table.column(value).is_valid().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        values = table.column(value).drop_null().cast(pa.float64()).to_numpy()
        upto = np.append(0, np.cumsum(known))
        if days is None:
            first, last = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows) + 1
        else:
            day = table.column(order).cast(pa.date32()).cast(pa.int32()).to_numpy()
            first, last = np.searchsorted(day, day - days, "left"), np.searchsorted(day, day, "right")
        left, right = upto[first], upto[last]
        cuts = frame_percentiles(values, left, right, shares)
        lists = pa.array([None if empty else c for empty, c in zip(left == right, cuts.tolist(), strict=True)], pa.list_(pa.float64()))
        return table.append_column(out, lists).append_column(n, pa.array(right - left, pa.int64()))

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(n, T.LongType())])
    return rows.groupBy(key).applyInArrow(task, schema)
