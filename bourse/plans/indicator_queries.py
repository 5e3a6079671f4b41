"""Queries for the per-symbol window operators."""

from pyspark.sql import functions as F

from bourse.operators import indicators as ind
from bourse.plans.registry import query
from bourse.plans.sqltext import frame, over, prev, rolled, running

KEY = ["symbol", "date"]


@query("E1_session_index", uses="bars_w sessions_w", doubles="close",
       sql="SELECT symbol, date, close, dense_rank() OVER (ORDER BY date) AS idx FROM bars_w")
def _(t):
    from bourse.operators.calendar import session_index
    return session_index(t.bars_w.select(*KEY, "close"), t.sessions_w)


@query("E2_returns", uses="bars_w", doubles="ret_1 ret_5 ret_21 log_ret mom_12_1 mom_6_1", sql=f"""
SELECT symbol, date, close / {prev('close')} - 1 AS ret_1, close / {prev('close', 5)} - 1 AS ret_5,
       close / {prev('close', 21)} - 1 AS ret_21, ln(close / {prev('close')}) AS log_ret,
       {prev('close', 21)} / {prev('close', 252)} - 1 AS mom_12_1, {prev('close', 21)} / {prev('close', 126)} - 1 AS mom_6_1
FROM bars_w""")
def _(t):
    return ind.returns(t.bars_w.select(*KEY, "close")).drop("close")


@query("E3_moving_averages", uses="bars_w",
       doubles="sma_20 dist_sma_20 sma_50 dist_sma_50 sma_200 dist_sma_200", sql=f"""
SELECT symbol, date, {", ".join(
    f"s{n} AS sma_{n}, close / s{n} - 1 AS dist_sma_{n}, close > s{n} AS above_sma_{n}" for n in (20, 50, 200))}
FROM (SELECT symbol, date, close, {", ".join(f"{rolled('avg(close)', 'close', n)} AS s{n}" for n in (20, 50, 200))} FROM bars_w)""")
def _(t):
    return ind.moving_averages(t.bars_w.select(*KEY, "close")).drop("close")


TR = f"greatest(high - low, coalesce(abs(high - {prev('close')}), 0), coalesce(abs(low - {prev('close')}), 0))"


@query("E6_atr_simple", uses="bars_w", doubles="tr atr atr_pct", sql=f"""
SELECT symbol, date, tr, {rolled('avg(tr)', 'tr', 14)} AS atr, {rolled('avg(tr)', 'tr', 14)} / close AS atr_pct
FROM (SELECT *, {TR} AS tr FROM bars_w)""")
def _(t):
    return ind.atr(t.bars_w).select(*KEY, "tr", "atr", "atr_pct")


def _bollinger_sql(std):
    mid, sd = rolled("avg(close)", "close", 20), rolled(f"{std}(close)", "close", 20)
    return f"""
SELECT symbol, date, mid AS bb_mid, 4 * sd / mid AS bb_width, (close - mid + 2 * sd) / (4 * sd) AS bb_pct
FROM (SELECT *, {mid} AS mid, nullif({sd}, 0) AS sd FROM bars_w)"""


@query("E8_bollinger_sample", uses="bars_w", doubles="bb_mid bb_width bb_pct", sql=_bollinger_sql("stddev_samp"))
def _(t):
    return ind.bollinger(t.bars_w).select(*KEY, "bb_mid", "bb_width", "bb_pct")


@query("E8_bollinger_population", uses="bars_w", doubles="bb_mid bb_width bb_pct", sql=_bollinger_sql("stddev_pop"))
def _(t):
    return ind.bollinger(t.bars_w, population=True).select(*KEY, "bb_mid", "bb_width", "bb_pct")


HI14, LO14 = rolled("max(high)", "high", 14), rolled("min(low)", "low", 14)


@query("E9_oscillators", uses="bars_w", doubles="stoch_k stoch_d williams_r cci", sql=f"""
, a AS (SELECT *, (high + low + close) / 3 AS tp, 100 * (close - {LO14}) / nullif({HI14} - {LO14}, 0) AS k,
        -100 * ({HI14} - close) / nullif({HI14} - {LO14}, 0) AS r, row_number() {over()} AS no FROM bars_w),
b AS (SELECT *, {rolled('avg(tp)', 'tp', 20)} AS m, {rolled('avg(k)', 'k', 3)} AS d FROM a),
mad AS (SELECT x.symbol, x.no, sum(abs(y.tp - x.m)) / 20 AS dev FROM b x JOIN b y
        ON x.symbol = y.symbol AND y.no BETWEEN x.no - 19 AND x.no GROUP BY 1, 2)
SELECT b.symbol, date, k AS stoch_k, d AS stoch_d, r AS williams_r, (tp - m) / nullif(0.015 * dev, 0) AS cci
FROM b JOIN mad ON b.symbol = mad.symbol AND b.no = mad.no""")
def _(t):
    return ind.oscillators(t.bars_w).select(*KEY, "stoch_k", "stoch_d", "williams_r", "cci")


@query("E11_obv", uses="bars_w", doubles="obv obv_slope", sql=f"""
, a AS (SELECT *, coalesce(sign(close - {prev('close')}), 0) * volume AS s, row_number() {over()} AS no FROM bars_w),
b AS (SELECT *, sum(s) {running()} AS obv FROM a)
SELECT symbol, date, obv, {rolled('regr_slope(obv, no)', 'obv', 10)} AS obv_slope FROM b""")
def _(t):
    return ind.on_balance_volume(t.bars_w).select(*KEY, "obv", "obv_slope")


@query("E12_trend_sign", uses="bars_w", doubles="alignment", sql=f"""
, a AS (SELECT *, row_number() {over()} AS no FROM bars_w),
b AS (SELECT symbol, date, {", ".join(
    f"CASE WHEN count(close) {frame(n)} >= {n} THEN regr_slope(close, no) {frame(n)} / first_value(close) {frame(n)} END AS s{n}"
    for n in (5, 25, 63))} FROM a),
c AS (SELECT symbol, date, {", ".join(
    f"CASE WHEN s{n} > 0.001 THEN 1 WHEN s{n} < -0.001 THEN -1 WHEN s{n} IS NOT NULL THEN 0 END AS trend_{n}"
    for n in (5, 25, 63))} FROM b)
SELECT *, (trend_5 + trend_25 + trend_63) / 3.0 AS alignment FROM c""")
def _(t):
    return ind.trend_sign(t.bars_w).select(*KEY, "trend_5", "trend_25", "trend_63", "alignment")


@query("E13_historical_vol", uses="bars_w", doubles="hv_10 hv_20 hv_30 hv_60", sql=f"""
SELECT symbol, date, {", ".join(f"sqrt(252) * {rolled('stddev_samp(r)', 'r', n)} AS hv_{n}" for n in (10, 20, 30, 60))}
FROM (SELECT *, ln(close / {prev('close')}) AS r FROM bars_w)""")
def _(t):
    return ind.historical_vol(t.bars_w).select(*KEY, "hv_10", "hv_20", "hv_30", "hv_60")


@query("E14_vol_regime_expanding", uses="bars_m", doubles="hv_10", sql=f"""
, a AS (SELECT *, ln(close / {prev('close')}) AS r, row_number() {over()} AS no FROM bars_m),
b AS (SELECT symbol, date, no, sqrt(252) * {rolled('stddev_samp(r)', 'r', 10)} AS v FROM a),
q AS (SELECT x.symbol, x.no, count(y.v) AS n, quantile_cont(y.v, 0.33) AS lo, quantile_cont(y.v, 0.67) AS mid, quantile_cont(y.v, 0.9) AS hi
      FROM b x JOIN b y ON x.symbol = y.symbol AND y.no <= x.no GROUP BY 1, 2)
SELECT b.symbol, date, v AS hv_10, CASE WHEN n < 30 OR v IS NULL THEN 'MED' WHEN v <= lo THEN 'LOW' WHEN v <= mid THEN 'MED'
       WHEN v <= hi THEN 'HIGH' ELSE 'SPIKE' END AS vol_regime
FROM b JOIN q ON b.symbol = q.symbol AND b.no = q.no""")
def _(t):
    return ind.vol_regime_expanding(ind.historical_vol(t.bars_m, (10,)), "hv_10", 30).select(*KEY, "hv_10", "vol_regime")


@query("E15_lottery_liquidity", uses="bars_w",
       doubles="downside_vol_63 max_ret_21 gap_mean_21 close_loc_21 amihud_21 turnover_ratio_5_60", sql=f"""
, a AS (SELECT *, close / {prev('close')} - 1 AS r, ln(close / {prev('close')}) AS lr, close * volume AS t,
        open / {prev('close')} - 1 AS g, (close - low) / nullif(high - low, 0) AS loc FROM bars_w),
b AS (SELECT *, CASE WHEN lr < 0 THEN lr END AS down, abs(r) / nullif(t, 0) * 1e7 AS il FROM a)
SELECT symbol, date, {rolled('stddev_samp(down)', 'down', 63, 18)} AS downside_vol_63,
       {rolled('max(r)', 'r', 21, 15)} AS max_ret_21, {rolled('avg(g)', 'g', 21, 15)} AS gap_mean_21,
       {rolled('avg(loc)', 'loc', 21, 15)} AS close_loc_21, {rolled('avg(il)', 'il', 21, 15)} AS amihud_21,
       {rolled('avg(t)', 't', 5, 3)} / {rolled('avg(t)', 't', 60, 45)} AS turnover_ratio_5_60
FROM b""")
def _(t):
    return ind.lottery_liquidity(t.bars_w).select(
        *KEY, "downside_vol_63", "max_ret_21", "gap_mean_21", "close_loc_21", "amihud_21", "turnover_ratio_5_60")


@query("E16_year_range", uses="bars_w", doubles="dist_52w_high dist_52w_low pct_of_52w_high", sql=f"""
SELECT symbol, date, close / hi - 1 AS dist_52w_high, close / lo - 1 AS dist_52w_low, close / hi AS pct_of_52w_high, close >= hi AS new_high
FROM (SELECT *, {rolled('max(close)', 'close', 252, 120)} AS hi, {rolled('min(close)', 'close', 252, 120)} AS lo FROM bars_w)""")
def _(t):
    return ind.year_range(t.bars_w).select(*KEY, "dist_52w_high", "dist_52w_low", "pct_of_52w_high", "new_high")


@query("E17_rolling_beta_idio", uses="bars_w index_w", doubles="beta idio_vol", sql=f"""
, a AS (SELECT b.symbol, b.date, b.close, i.close AS ix FROM bars_w b LEFT JOIN index_w i ON b.date = i.date),
r AS (SELECT symbol, date, close / {prev('close')} - 1 AS r, ix / {prev('ix')} - 1 AS m FROM a),
s AS (SELECT symbol, date, CASE WHEN count(r) {frame(252)} >= 120 THEN covar_samp(r, m) {frame(252)} / nullif(var_samp(m) {frame(252)}, 0) END AS beta,
      var_samp(r) {frame(252)} AS vr, var_samp(m) {frame(252)} AS vm FROM r)
SELECT symbol, date, beta, CASE WHEN beta IS NOT NULL THEN sqrt(greatest(vr - beta * beta * vm, 0)) END AS idio_vol FROM s""")
def _(t):
    return ind.rolling_beta(t.bars_w, t.index_w).select(*KEY, "beta", "idio_vol")


@query("E18_risk_metrics", uses="bars_w index_w", doubles="beta sortino var_95 sharpe max_drawdown", sql=f"""
, a AS (SELECT b.symbol, b.date, b.close, i.close AS ix FROM bars_w b JOIN index_w i ON b.date = i.date),
r AS (SELECT *, close / {prev('close')} - 1 AS r, ix / {prev('ix')} - 1 AS m,
      row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM a),
w AS (SELECT *, close / max(close) {running()} - 1 AS dd FROM r WHERE rn <= 252 AND r IS NOT NULL)
SELECT symbol, count(*) AS n, covar_samp(r, m) / nullif(var_samp(m), 0) AS beta,
       CASE WHEN count(*) FILTER (WHERE r < 0) >= 5 THEN avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) * sqrt(252) END AS sortino,
       -100 * quantile_cont(r, 0.05) AS var_95, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(dd) AS max_drawdown
FROM w GROUP BY symbol HAVING count(*) >= 30""")
def _(t):
    return ind.risk_metrics(t.bars_w, t.index_w)


@query("E19_rolling_corr", uses="bars_w index_w", doubles="corr", sql=f"""
, a AS (SELECT b.symbol, b.date, b.close, i.close AS ix FROM bars_w b JOIN index_w i ON b.date = i.date),
r AS (SELECT symbol, date, close / {prev('close')} - 1 AS r, ix / {prev('ix')} - 1 AS m FROM a)
SELECT symbol, date, CASE WHEN count(r) {frame(90)} >= 40 THEN corr(r, m) {frame(90)} END AS corr FROM r""")
def _(t):
    return ind.rolling_corr(t.bars_w, t.index_w).select(*KEY, "corr")


@query("E28_avwap_deviation", uses="bars_w", doubles="avwap avwap_dev_pct", sql=f"""
SELECT symbol, date, v AS avwap, 100 * (close - v) / v AS avwap_dev_pct FROM (
  SELECT symbol, date, close, CASE WHEN count(*) {frame(20)} >= 2 THEN
    sum((high + low + close) / 3 * volume) {frame(20)} / sum(volume) {frame(20)} END AS v FROM bars_w)""")
def _(t):
    return ind.avwap_deviation(t.bars_w).select(*KEY, "avwap", "avwap_dev_pct")


@query("E28_session_vwap_bands", uses="bars_w", doubles="vwap vwap_up_2 vwap_down_2 vwap_dev", sql=f"""
, a AS (SELECT *, year(date) AS y, (high + low + close) / 3 AS tp FROM bars_w),
b AS (SELECT symbol, date, close, sum(tp * volume) OVER w / sum(volume) OVER w AS v, sum(tp * tp * volume) OVER w / sum(volume) OVER w AS q
      FROM a WINDOW w AS (PARTITION BY symbol, y ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT symbol, date, v AS vwap, v + 2 * round(sqrt(greatest(q - v * v, 0)), 4) AS vwap_up_2, v - 2 * round(sqrt(greatest(q - v * v, 0)), 4) AS vwap_down_2, close / v - 1 AS vwap_dev FROM b""")
def _(t):
    out = ind.session_vwap(t.bars_w, F.year("date"), "date")
    sd = F.round("vwap_sd", 4)
    return out.select(*KEY, "vwap", (F.col("vwap") + 2 * sd).alias("vwap_up_2"), (F.col("vwap") - 2 * sd).alias("vwap_down_2"), "vwap_dev")


@query("E29_order_flow", uses="bars_w", doubles="ofi ofi_z vpin_range vpin_tick kyle_lambda relative_volume", sql=f"""
, a AS (SELECT *, close - {prev('close')} AS d FROM bars_w),
b AS (SELECT *, abs(d) AS ad, sign(d) * volume AS sv, coalesce(abs((2 * close - high - low) / nullif(high - low, 0)), 0.0) AS loc,
      CASE WHEN volume <> 0 THEN CASE WHEN d <> 0 THEN 1.0 ELSE 0.0 END END AS one FROM a),
c AS (SELECT *, sum(sv) {frame(20)} AS fl FROM b)
SELECT symbol, date, coalesce(fl / nullif(sum(volume) {frame(20)}, 0), 0.0) AS ofi,
       coalesce((fl - {rolled('avg(fl)', 'fl', 100, 20)}) / nullif({rolled('stddev_samp(fl)', 'fl', 100, 20)}, 0), 0.0) AS ofi_z,
       avg(loc) {frame(50)} AS vpin_range, avg(one) {frame(50)} AS vpin_tick,
       coalesce(CASE WHEN count(sv) {frame(20)} >= 20 THEN covar_samp(ad, abs(sv)) {frame(20)} / nullif(var_samp(abs(sv)) {frame(20)}, 0) END, 0.0) AS kyle_lambda,
       volume / {rolled('avg(volume)', 'volume', 20, 20, 1)} AS relative_volume
FROM c""")
def _(t):
    return ind.order_flow(t.bars_w).select(*KEY, "ofi", "ofi_z", "vpin_range", "vpin_tick", "kyle_lambda", "relative_volume")


DELIV_SQL = "(SELECT symbol, date, CAST(n AS DOUBLE) / volume AS deliv_pct, CAST(n AS DOUBLE) AS deliv_qty, close * volume AS turnover, CAST(n AS DOUBLE) AS num_trades FROM bars_w)"


@query("E31_delivery_features", uses="bars_w", doubles="deliv_z_20 deliv_chg_5 deliv_spike deliv_trend deliv_qty_5 ticket_ratio", sql=f"""
SELECT symbol, date, (deliv_pct - {rolled('avg(deliv_pct)', 'deliv_pct', 20, 10)}) / nullif({rolled('stddev_samp(deliv_pct)', 'deliv_pct', 20, 10)}, 0) AS deliv_z_20,
       deliv_pct - {prev('deliv_pct', 5)} AS deliv_chg_5, deliv_pct - {rolled('avg(deliv_pct)', 'deliv_pct', 60, 30)} AS deliv_spike,
       {rolled('avg(deliv_pct)', 'deliv_pct', 21, 10)} - {rolled('avg(deliv_pct)', 'deliv_pct', 63, 30)} AS deliv_trend,
       sum(deliv_qty) {frame(5)} AS deliv_qty_5,
       turnover / num_trades / {rolled('avg(turnover / num_trades)', 'num_trades', 60, 30)} AS ticket_ratio
FROM {DELIV_SQL}""")
def _(t):
    df = t.bars_w.select(*KEY, (F.col("n") / F.col("volume")).alias("deliv_pct"), F.col("n").cast("double").alias("deliv_qty"),
                         (F.col("close") * F.col("volume")).alias("turnover"), F.col("n").cast("double").alias("num_trades"))
    return ind.delivery_features(df).select(*KEY, "deliv_z_20", "deliv_chg_5", "deliv_spike", "deliv_trend", "deliv_qty_5", "ticket_ratio")


@query("E32_iv_rank", uses="chain", doubles="iv iv_rank", sql=f"""
, a AS (SELECT symbol, expiry AS date, avg(ce_iv) AS iv FROM chain GROUP BY 1, 2),
b AS (SELECT *, min(iv) {frame(252)} AS lo, max(iv) {frame(252)} AS hi, count(iv) {frame(252)} AS n FROM a)
SELECT symbol, date, iv, CASE WHEN iv IS NULL THEN NULL WHEN n < 20 OR hi <= lo THEN 0.5 ELSE (iv - lo) / (hi - lo) END AS iv_rank FROM b""")
def _(t):
    iv = t.chain.groupBy("symbol", F.col("expiry").alias("date")).agg(F.avg("ce_iv").alias("iv"))
    return ind.iv_rank(iv, "iv").select(*KEY, "iv", "iv_rank")


@query("E33_ffill_with_age", uses="bars_w", doubles="close_ffill", sql=f"""
, a AS (SELECT symbol, date, CASE WHEN n % 3 = 0 THEN close END AS close, CASE WHEN n % 4 = 0 THEN n END AS n, row_number() {over()} AS no FROM bars_w)
SELECT symbol, date, last_value(close IGNORE NULLS) {frame(6)} AS close_ffill, last_value(n IGNORE NULLS) {frame(6)} AS n_ffill,
       no - max(CASE WHEN close IS NOT NULL THEN no END) {running()} AS close_age, no - max(CASE WHEN n IS NOT NULL THEN no END) {running()} AS n_age
FROM a""")
def _(t):
    sparse = t.bars_w.select(*KEY, F.when(F.col("n") % 3 == 0, F.col("close")).alias("close"), F.when(F.col("n") % 4 == 0, F.col("n")).alias("n"))
    return ind.ffill_with_age(sparse, ["close", "n"], 5).select(*KEY, "close_ffill", "n_ffill", "close_age", "n_age")


@query("E34_run_length", uses="bars_w", sql=f"""
, a AS (SELECT symbol, date, coalesce(close > {prev('close')}, false) AS up, row_number() {over()} AS no FROM bars_w),
b AS (SELECT *, no - max(CASE WHEN NOT up THEN no ELSE 0 END) {running()} AS run FROM a)
SELECT symbol, date, up, run, NOT up AND coalesce({prev('run')}, 0) > 0 AS exit_edge FROM b""")
def _(t):
    up = t.bars_w.withColumn("up", F.coalesce(F.col("close") > ind.prev("close"), F.lit(False)))
    return ind.run_length(up, "up").select(*KEY, "up", "run", "exit_edge")


@query("E36_oi_delta", uses="chain", doubles="oi prev_value pct_delta", sql=f"""
, a AS (SELECT symbol, expiry AS date, sum(ce_oi) AS oi FROM chain GROUP BY 1, 2)
SELECT symbol, date, oi, {prev('oi')} AS prev_value, 100 * (oi - {prev('oi')}) / nullif(abs({prev('oi')}), 0) AS pct_delta FROM a""")
def _(t):
    oi = t.chain.groupBy("symbol", F.col("expiry").alias("date")).agg(F.sum("ce_oi").alias("oi"))
    return ind.compare_previous(oi, "oi")


@query("E37_price_move_classes", uses="bars_w", sql=f"""
, a AS (SELECT *, {prev('close')} AS pc, high - low AS rng, {rolled('quantile_cont(volume, 0.5)', 'volume', 20, 10, 1)} AS med,
        {rolled('max(high)', 'high', 20, 10, 1)} AS ph FROM bars_w)
SELECT symbol, date, coalesce(100 * (open - pc) / pc >= 2, false) AS gap_up, coalesce(100 * (open - pc) / pc <= -2, false) AS gap_down,
       coalesce(abs(low - open) <= 0.0015 * pc AND rng >= 0.01 * pc AND close > open, false) AS open_low,
       coalesce(abs(high - open) <= 0.0015 * pc AND rng >= 0.01 * pc AND close < open, false) AS open_high,
       coalesce(volume / nullif(med, 0) >= 5, false) AS volume_shock,
       coalesce(high > ph AND (close - low) / nullif(rng, 0) >= 0.75, false) AS breakout
FROM a""")
def _(t):
    return ind.price_move_classes(t.bars_w).select(*KEY, "gap_up", "gap_down", "open_low", "open_high", "volume_shock", "breakout")


@query("E40_flyers_and_divers", uses="bars_raw", doubles="ret vol_ratio", sql=f"""
, a AS (SELECT *, close / {prev('close')} - 1 AS ret, volume / avg(volume) {frame(20, 1)} AS vol_ratio, max(close) {frame(252, 1)} AS hi,
        min(close) {frame(252, 1)} AS lo, row_number() {over()} AS no FROM bars_raw),
b AS (SELECT *, coalesce(close > hi AND ret > 0, false) AS new_high, coalesce(close < lo AND ret < 0, false) AS new_low FROM a)
SELECT symbol, date, ret, vol_ratio, new_high, new_low,
       CASE WHEN (ret >= 0.04 AND vol_ratio >= 1.5) OR new_high THEN 'FLYER' ELSE 'DIVER' END AS kind
FROM b WHERE no >= 60 AND close >= 20 AND ((abs(ret) >= 0.04 AND vol_ratio >= 1.5) OR new_high OR new_low)""")
def _(t):
    return ind.flyers_and_divers(t.bars_raw).select(*KEY, "ret", "vol_ratio", "new_high", "new_low", "kind")


@query("E48_price_distances", uses="bars_w",
       doubles="ma_30_dist_pct ma_50_dist_pct ma_150_dist_pct ma_200_dist_pct ret_3_pct high_dist_pct low_dist_pct vol_ratio", sql=f"""
, a AS (SELECT *, row_number() {over()} AS no, max(close) {frame(252)} AS hi, min(close) {frame(252)} AS lo FROM bars_w),
b AS (SELECT *, arg_max(no, row(close, no)) {frame(252)} AS hn FROM a)
SELECT symbol, date, {", ".join(f"100 * (close / {rolled('avg(close)', 'close', n, m)} - 1) AS ma_{n}_dist_pct" for n, m in ((30, 20), (50, 35), (150, 100), (200, 150)))},
       100 * (close / {prev('close', 3)} - 1) AS ret_3_pct, 100 * (close / hi - 1) AS high_dist_pct, 100 * (close / lo - 1) AS low_dist_pct,
       no - hn AS bars_from_high, volume / {rolled('avg(volume)', 'volume', 20, 10, 1)} AS vol_ratio
FROM b""")
def _(t):
    return ind.price_distances(t.bars_w).drop("open", "high", "low", "close", "volume", "n")


@query("E50_session_state", uses="bars_w", doubles="gap ret_1 intraday open_loc close_loc range_pct turnover_ratio dist_52w_low log_adt", sql=f"""
, a AS (SELECT *, nullif(high - low, 0) AS rng, close * volume AS t FROM bars_w)
SELECT symbol, date, open / {prev('close')} - 1 AS gap, close / {prev('close')} - 1 AS ret_1, close / open - 1 AS intraday,
       (open - low) / rng AS open_loc, (close - low) / rng AS close_loc, rng / open AS range_pct,
       t / {rolled('avg(t)', 't', 20, 15)} AS turnover_ratio, close / {rolled('min(close)', 'close', 252, 120)} - 1 AS dist_52w_low,
       ln({rolled('avg(t)', 't', 20, 15)}) AS log_adt
FROM a""")
def _(t):
    return ind.session_state(t.bars_w).drop("open", "high", "low", "close", "volume", "n")
