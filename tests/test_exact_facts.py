"""Facts that must hold exactly, or to the solver's digits, where no SQL can say the result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse.operators import derivatives, ml


def test_a_chain_priced_at_a_known_volatility(spark):
    rows = []
    for k, (forward, years, sigma) in enumerate([(100.0, 0.1, 0.3), (2500.0, 0.02, 0.15), (52.5, 0.5, 0.8)]):
        for strike in np.linspace(0.8, 1.2, 17) * forward:
            ce, pe = (float(derivatives.black76(forward, strike, years, sigma, call, 0.065)) for call in (True, False))
            rows.append((k, float(strike), forward * 0.999, years, ce, pe))
    frame = spark.createDataFrame(rows, "k int, strike double, spot double, years double, ce_price double, pe_price double")
    keys = {c: F.col("k").cast("string") for c in derivatives.CHAIN}
    got = derivatives.chain_day_features(frame.select("*", *[v.alias(c) for c, v in keys.items()])).collect()
    want = {"0": (100.0, 0.3), "1": (2500.0, 0.15), "2": (52.5, 0.8)}
    assert len(got) == 3
    for r in got:
        forward, sigma = want[r[derivatives.CHAIN[0]]]
        assert r.forward == pytest.approx(forward, rel=1e-9) and r.atm_iv == pytest.approx(sigma, abs=1e-6) and r["skew"] == pytest.approx(0, abs=1e-6)


def _pooled(pairs):
    """Pool adjacent violators over (p, y): the isotonic mean of y at each p."""
    blocks = []
    for p, y in sorted(pairs):
        blocks.append([y, 1, [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + at]
    return {p: y / n for y, n, at in blocks for p in at}


def test_isotonic_map_is_pooled_violators(spark):
    rng = random.Random(3)
    rows = [(k, k / 200, float(rng.random() < (k / 200) ** 2), k) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, p double, y double, day int").select("id", "p", "y", F.expr("date_add(date'2024-01-01', day)").alias("day"))
    got = {r.p: r.calibrated for r in ml.isotonic_calibrate(df, "p", "y", "day", 1, 1).collect()}
    want = _pooled([(r[1], r[2]) for r in rows])
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert sum(got.values()) == pytest.approx(sum(r[2] for r in rows))
    few = ml.isotonic_calibrate(df, "p", "y", "day", 10_000, 1)
    assert all(r.calibrated == r.p for r in few.collect())
