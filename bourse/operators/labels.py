"""Labels: forward returns by session count, barriers, path exits, weights and folds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, ratio
from bourse.operators.asof import asof_join
from bourse.operators.indicators import true_range
from bourse.operators.xsection import percentile_rank, winsorize


def forward_return(panel: DataFrame, sessions: DataFrame, horizon: int, entry: str = "open") -> DataFrame:
    """Return from the next session's open to the open `horizon` sessions later.

    Range frames on the session number read exact sessions, so gaps need no filled-in rows. A name
    that stops trading leaves at its last close inside the window; an unfinished window is NULL.
    """
    last = sessions.agg(F.max("idx")).scalar()
    w = Window.partitionBy("symbol").orderBy("idx")
    at = lambda c, n: F.first(c).over(w.rangeBetween(n, n))
    rows = panel.join(sessions, "date") if "idx" not in panel.columns else panel
    if entry == "close":
        return rows.withColumn("fwd", F.when(F.col("idx") + horizon <= last, ratio(at("close", horizon), "close") - 1))
    inside = F.last("close", ignorenulls=True).over(w.rangeBetween(1, horizon))
    rows = rows.withColumns({"_in": at("open", 1), "_out": at("open", 1 + horizon), "_stop": inside})
    done = F.col("idx") + 1 + horizon <= last
    gone = done & F.col("_out").isNull() & F.col("_in").isNotNull()
    price = F.coalesce(F.col("_out"), F.when(gone, F.col("_stop")))
    return rows.withColumns({
        "fwd": F.when(done, ratio(price, "_in") - 1),
        "stopped": F.coalesce(gone & F.col("_stop").isNotNull(), F.lit(False)),
    }).drop("_in", "_out", "_stop")


def vol_threshold(bars: DataFrame, horizon: int, n: int = 20, split: float = 25.0) -> DataFrame:
    """Win/loss threshold from trailing daily volatility, clamped; short histories use root time."""
    w = Window.partitionBy("symbol").orderBy("date")
    root = float(horizon) ** 0.5
    move = 100 * ratio(F.col("close") - F.lag("close").over(w), F.lag("close").over(w))
    rows = bars.withColumn("_r", move)
    rows = rows.withColumn("_r", F.when(F.abs("_r") < split, F.col("_r")))
    frame, closes = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-n, 0)
    fallback = max(0.5, min(10.0, root))
    enough = (F.count("close").over(closes) >= 10) & (F.count("_r").over(frame) >= 5)
    scaled = clamp(F.stddev_samp("_r").over(frame) * root, 0.5, 15.0)
    return rows.withColumn("threshold", F.when(enough, scaled).otherwise(fallback)).drop("_r")


def outcome(ret, threshold) -> Column:
    return F.when(ret >= threshold, "WIN").when(ret <= -threshold, "LOSS").when(ret.isNotNull(), "NEUTRAL").otherwise("PENDING")


def vol_rank(bars: DataFrame, window: int = 14, lookback: int = 20) -> DataFrame:
    """Share of the trailing average true ranges that do not exceed the current one; 0.5 while short."""
    w = Window.partitionBy("symbol").orderBy("date")
    span = w.rowsBetween(-(window - 1), 0)
    rows = bars.withColumn("_tr", F.when(F.lag("close").over(w).isNotNull(), true_range()))
    rows = rows.withColumn("atr", F.when(F.count("_tr").over(span) >= window, F.avg("_tr").over(span)))
    past = F.collect_list("atr").over(w.rowsBetween(-(lookback - 1), -1))
    rows = rows.withColumn("_past", past)
    share = F.size(F.filter("_past", lambda a: a <= F.col("atr"))) / F.size("_past")
    return rows.withColumn("vol_rank", F.when((F.size("_past") > 0) & F.col("atr").isNotNull(), share).otherwise(0.5)).drop("_tr", "_past")


def holding_windows(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """The `horizon` bars after each entry as an array of structs in session order; empty where none follows.

    `entries` carry (symbol, idx); the equi-join on the session number explodes each entry into its
    horizon, so an entry's window never exceeds `horizon` bars and hot symbols spread by session.
    Equal entries are looked up once and come back as often as they were given.
    """
    alike = entries.groupBy(*entries.columns).agg(F.count("*").alias("_alike"))
    steps = alike.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_at", F.col("idx") + F.col("_step"))
    path = bars.select("symbol", F.col("idx").alias("_at"), F.col("date").alias("_d"), F.col("open").alias("_o"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("close").alias("_c"))
    joined = steps.join(path, ["symbol", "_at"], "left")
    keys = entries.columns
    bar = F.struct(F.col("_at").alias("at"), F.col("_d").alias("date"), F.col("_o").alias("open"), F.col("_h").alias("high"), F.col("_l").alias("low"), F.col("_c").alias("close"))
    found = joined.groupBy(*keys, "_alike").agg(F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), bar))).alias("bars"))
    return found.select(*keys, "bars", F.explode(F.sequence(F.lit(1).cast("long"), "_alike")).alias("_copy")).drop("_copy")


EXIT_STATE = ("struct<anchor:double,mfe:double,mae:double,partial:boolean,booked:double,"
              "done:boolean,reason:string,date:date,price:double,gross:double>")


def exit_path(trades: DataFrame, scale: float = 0.5, mult: float = 3.0) -> DataFrame:
    """Replay each trade's bars: stop before target, chandelier trail from earlier extremes, half
    booked at the target. `trades` carry bars, entry, stop, target, atr, direction; without bars yet a
    trade is PENDING and its results are NULL.

    A fold over an array of at most the holding period: trades are independent rows.
    """
    long = F.col("direction") != "short"
    sign = F.when(long, 1.0).otherwise(-1.0)

    def leg(price):
        return sign * (price - F.col("entry")) / F.col("entry") * 100

    aimed = F.col("target").isNotNull() & F.when(long, F.col("target") > F.col("entry")).otherwise(F.col("target") < F.col("entry"))
    names = ("anchor", "mfe", "mae", "partial", "booked", "done", "reason", "date", "price", "gross")

    def state(**v):
        return F.struct(*[v[n].alias(n) for n in names])

    start = state(anchor=F.col("entry"), mfe=F.col("entry"), mae=F.col("entry"), partial=F.lit(False), booked=F.lit(0.0),
                  done=F.lit(False), reason=F.lit(None).cast("string"), date=F.lit(None).cast("date"),
                  price=F.lit(None).cast("double"), gross=F.lit(None).cast("double"))

    def step(s, b):
        low, high = F.when(long, b["low"]).otherwise(b["high"]), F.when(long, b["high"]).otherwise(b["low"])
        trail = s["anchor"] - sign * mult * F.col("atr")
        tight = F.when(long, F.greatest(F.col("stop"), trail)).otherwise(F.least(F.col("stop"), trail))
        stop = F.when(F.col("atr") > 0, tight).otherwise(F.col("stop"))
        hit = stop.isNotNull() & F.when(long, low <= stop).otherwise(low >= stop)
        hit = F.coalesce(hit, F.lit(False))
        mfe = F.when(long, F.greatest(s["mfe"], high)).otherwise(F.least(s["mfe"], high))
        mae = F.when(long, F.least(s["mae"], low)).otherwise(F.greatest(s["mae"], low))
        gross = F.when(s["partial"], scale * s["booked"] + (1 - scale) * leg(stop)).otherwise(leg(stop))
        reached = ~hit & aimed & ~s["partial"] & F.when(long, high >= F.col("target")).otherwise(high <= F.col("target"))
        reached = F.coalesce(reached, F.lit(False))
        moved = state(
            anchor=F.when(long, F.greatest(s["anchor"], high)).otherwise(F.least(s["anchor"], high)),
            mfe=mfe, mae=mae, partial=s["partial"] | reached,
            booked=F.when(reached, leg(F.col("target"))).otherwise(s["booked"]),
            done=hit, reason=F.when(hit, F.when(stop == F.col("stop"), "STOP_LOSS").otherwise("TRAILING_STOP")),
            date=F.when(hit, b["date"]), price=F.when(hit, stop), gross=F.when(hit, gross),
        )
        return F.when(s["done"], s).otherwise(moved)

    rows = trades.withColumn("_s", F.aggregate("bars", start.cast(EXIT_STATE), lambda s, b: step(s, b).cast(EXIT_STATE)))
    s, last = F.col("_s"), F.try_element_at("bars", F.lit(-1))
    held, some = leg(last["close"]), F.size("bars") > 0
    return rows.withColumns({
        "exit_reason": F.when(~some, "PENDING").otherwise(F.coalesce(s["reason"], F.when(s["partial"], "TIME_EXIT_PARTIAL").otherwise("TIME_EXIT"))),
        "exit_date": F.coalesce(s["date"], last["date"]),
        "exit_price": F.coalesce(s["price"], last["close"]),
        "gross_pct": F.coalesce(s["gross"], F.when(s["partial"], scale * s["booked"] + (1 - scale) * held).otherwise(held)),
        "mfe_pct": F.when(some, leg(s["mfe"])), "mae_pct": F.when(some, leg(s["mae"])),
    }).drop("_s", "bars")


def excursions(trades: DataFrame, mult: float = 3.0, cap: float = 50.0) -> DataFrame:
    """Largest favourable and adverse moves with their days, which came first, and the trailing exit; NULL without bars."""
    entry, some = F.col("entry"), F.size("bars") > 0
    pct = lambda price: 100 * (price - entry) / entry
    bounded = lambda price: F.least(F.greatest(pct(price), F.lit(-cap)), F.lit(cap))
    moves = F.transform("bars", lambda b, i: F.struct(bounded(b["high"]).alias("up"), bounded(b["low"]).alias("down"), (i + 1).alias("day"), b["high"].alias("high"), b["low"].alias("low")))
    rows = trades.withColumn("_m", moves)
    rows = rows.withColumns({
        "mfe_pct": F.when(some, F.greatest(F.array_max(F.transform("_m", lambda m: m["up"])), F.lit(0.0))),
        "mae_pct": F.when(some, F.least(F.array_min(F.transform("_m", lambda m: m["down"])), F.lit(0.0))),
    })
    day = lambda side, best: F.coalesce(F.array_min(F.transform(F.filter("_m", lambda m: m[side] == F.col(best)), lambda m: m["day"])), F.lit(0))
    rows = rows.withColumns({
        "days_to_mfe": F.when(F.col("mfe_pct") > 0, day("up", "mfe_pct")).when(some, 0),
        "days_to_mae": F.when(F.col("mae_pct") < 0, day("down", "mae_pct")).when(some, 0),
    })
    def peak(i):
        return F.aggregate(F.slice("bars", 1, i), entry, lambda a, b: F.greatest(a, b["high"]))
    stopped = F.filter(F.transform("_m", lambda m: F.struct(m["day"].alias("day"), m["high"].alias("high"), m["low"].alias("low"), (peak(m["day"] - 1) - mult * F.col("atr")).alias("stop"))), lambda m: m["low"] <= m["stop"])
    first = F.when((F.col("atr") > 0) & (F.size(stopped) > 0), F.get(stopped, F.lit(0)))
    rows = rows.withColumn("_first", first)
    close = F.when(some, bounded(F.try_element_at("bars", F.lit(-1))["close"]))
    return rows.withColumns({
        "mfe_first": (F.col("days_to_mfe") > 0) & ((F.col("days_to_mae") == 0) | (F.col("days_to_mfe") <= F.col("days_to_mae"))),
        "horizon_close_pct": close,
        "trail_exit_day": F.col("_first")["day"],
        "trail_exit_pct": F.coalesce(pct(F.least(F.col("_first")["stop"], F.col("_first")["high"])), close),
        "atr_pct": F.when(F.col("atr") > 0, 100 * F.col("atr") / entry).otherwise(0.0),
    }).drop("_m", "_first", "bars")


def triple_barrier(df: DataFrame) -> DataFrame:
    """1, 0 or NULL from excursions: asymmetric barriers scaled by ATR, wider as `vol_rank` rises."""
    # Barrier multipliers at the calm and the wild end, and the fallback cost band.
    up_lo, up_hi, down_lo, down_hi, cost_lo, cost_hi, flat = 1.0, 2.0, 0.5, 1.0, 0.10, 0.20, 0.4
    t = clamp("vol_rank", 0.0, 1.0)
    lerp = lambda a, b, default: F.coalesce(a + (b - a) * t, F.lit(default))
    atr = F.col("atr_pct")
    armed = F.coalesce(atr > 0, F.lit(False))
    hit_up = armed & (F.col("mfe_pct") >= lerp(up_lo, up_hi, up_hi) * atr)
    hit_down = armed & (F.col("mae_pct") <= -lerp(down_lo, down_hi, down_hi) * atr)
    cost = F.when(armed, lerp(cost_lo, cost_hi, 0.15) * atr).otherwise(flat)
    close = F.col("horizon_close_pct")
    label = (
        F.when(close.isNull(), None)
        .when(hit_up & hit_down, F.col("mfe_first").cast("int"))
        .when(hit_up, 1).when(hit_down, 0)
        .when(F.abs(close) < cost, None)
        .otherwise((close > cost).cast("int"))
    )
    return df.withColumn("tb_label", label)


def forward_max_label(bars: DataFrame, horizon: int, threshold: float) -> DataFrame:
    """1 if the highest close of the next rows gains `threshold`, NULL unless the whole window exists."""
    w = Window.partitionBy("symbol").orderBy("date")
    ahead = w.rowsBetween(1, horizon)
    gain = ratio(F.max("close").over(ahead), "close") - 1
    full = F.count("close").over(ahead) == horizon
    return bars.withColumns({"fwd_max": F.when(full, gain), "label": F.when(full, (gain >= threshold).cast("int"))})


def trend_scan(bars: DataFrame, least: int = 3, hold: int = 20, adverse: float = 0.10) -> DataFrame:
    """+1 or -1 if a monotone run of `least` closes starts before a counter-move beyond `adverse`."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.withColumn("_path", F.collect_list("close").over(w.rowsBetween(0, hold)))
    names = ("prev", "ext", "run", "out")

    def scan(sign):
        start = F.struct(F.col("close").alias("prev"), F.col("close").alias("ext"), F.lit(0).alias("run"), F.lit(0).alias("out"))

        def step(s, x):
            onward = (x - s["prev"]) * sign > 0
            ext = F.when(onward, F.greatest(s["ext"] * sign, x * sign) * sign).otherwise(s["ext"])
            run = F.when(onward, s["run"] + 1).otherwise(0)
            back = F.when(ext > 0, (ext - x) * sign / ext).otherwise(0.0)
            out = F.when(onward & (run >= least), 1).when(~onward & (back > adverse), -1).otherwise(0)
            new = F.struct(x.alias("prev"), ext.alias("ext"), run.alias("run"), out.alias("out"))
            return F.when(s["out"] != 0, s).otherwise(new)

        kind = "struct<" + ",".join(f"{n}:{'double' if n in ('prev', 'ext') else 'int'}" for n in names) + ">"
        tail = F.slice("_path", 2, F.lit(hold))
        return F.aggregate(tail, start.cast(kind), lambda s, x: step(s, x).cast(kind))["out"]

    label = F.when(F.size("_path") < least + 1, 0).when(scan(1.0) == 1, 1).when(scan(-1.0) == 1, -1).otherwise(0)
    return rows.withColumn("trend_label", label).drop("_path")


def movement_label(bars: DataFrame, share: float = 0.10, min_price: float = 20.0, min_turnover: float = 0.0) -> DataFrame:
    """Whether the session's range, as a percent of the last close, ranks in the top share of the
    eligible cross-section; features are those of the symbol's prior row."""
    w = Window.partitionBy("symbol").orderBy("date")
    turnover = F.col("close") * F.col("volume")
    span = w.rowsBetween(-19, 0)
    rows = bars.withColumns({
        "range_pct": 100 * ratio(F.col("high") - F.col("low"), F.lag("close").over(w)),
        "_t": F.when(F.count(turnover).over(span) >= 20, F.avg(turnover).over(span)),
    }).withColumn("lag_range_pct", F.lag("range_pct").over(w))
    rows = rows.where((F.col("close") >= min_price) & (F.col("_t") >= min_turnover) & F.col("range_pct").isNotNull())
    return rows.withColumn("moved", (percentile_rank("range_pct") >= 1 - share).cast("int")).drop("_t")


def average_uniqueness(entries: DataFrame, sessions: DataFrame, horizon: int, keys=()) -> DataFrame:
    """Mean of 1/concurrency over each label's span [idx, idx+horizon), read from prefix sums.

    Concurrency comes from +1/-1 events folded per session, and the span mean from the difference of
    two running sums, so no label is ever exploded into its days.
    """
    up = entries.groupBy(*keys, F.col("idx").alias("_i")).agg(F.count("*").alias("_d"))
    down = entries.groupBy(*keys, (F.col("idx") + horizon).alias("_i")).agg((-F.count("*")).alias("_d"))
    group = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    steps = up.unionByName(down).groupBy(*keys, "_i").agg(F.sum("_d").alias("_d"))
    spine = sessions.select(F.col("idx").alias("_i"))
    if keys:
        spine = entries.select(*keys).distinct().withColumn("_i", F.explode(F.sequence(F.lit(1), sessions.agg(F.max("idx").cast("int")).scalar() + horizon))).withColumn("_i", F.col("_i").cast("bigint"))
    spine = spine.join(steps, [*keys, "_i"], "full").withColumn("_c", F.sum(F.coalesce("_d", F.lit(0))).over(group))
    spine = spine.withColumn("_s", F.sum(F.when(F.col("_c") > 0, 1 / F.col("_c")).otherwise(0.0)).over(group))
    spine = spine.select(*keys, "_i", "_s", F.lag("_s", 1, 0.0).over(Window.partitionBy(*keys).orderBy("_i")).alias("_before"))
    first = spine.select(*keys, F.col("_i").alias("idx"), F.col("_before"))
    last = spine.select(*keys, (F.col("_i") - horizon + 1).alias("idx"), F.col("_s"))
    joined = entries.join(first, [*keys, "idx"]).join(last, [*keys, "idx"], "left")
    return joined.withColumn("uniqueness", (F.col("_s") - F.col("_before")) / horizon).drop("_s", "_before")


def sample_weights(df: DataFrame, label: str, half_life_days: float, loss_weight: float = 2.0) -> DataFrame:
    """Non-wins weighted up, each session weighing the same in total, and recent sessions more."""
    latest = df.agg(F.max("date")).scalar()
    return df.withColumns({
        "w_asymmetric": F.when(F.col(label) == 1, 1.0).otherwise(loss_weight),
        "w_date": 1 / F.count("*").over(Window.partitionBy("date")),
        "w_recency": F.pow(F.lit(0.5), F.datediff(latest, "date") / half_life_days),
    })


def walk_forward_folds(sessions: DataFrame, folds: int, horizon: int, min_train: int) -> DataFrame:
    """Expanding folds over session numbers: a training label is realised before its test block starts."""
    first = min_train + horizon + 1
    size = sessions.agg((F.max("idx") - first).alias("_n"))
    edge = lambda i: first + F.bround(F.col("_n") * i / folds).cast("bigint")
    bounds = size.select("_n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    bounds = bounds.select("fold", (edge(F.col("fold")) + 1).alias("test_from"), edge(F.col("fold") + 1).alias("test_to"))
    return bounds.where("test_to >= test_from").withColumn("train_to", F.col("test_from") - 1 - horizon)


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row once per fold in which it trains or tests. Folds are a handful of ranges of `idx`."""
    inside = df.join(folds, F.col("idx") <= F.col("test_to"))
    part = F.when(F.col("idx") >= F.col("test_from"), "TEST").when(F.col("idx") <= F.col("train_to"), "TRAIN")
    return inside.withColumn("part", part).where(F.col("part").isNotNull()).drop("test_from", "test_to", "train_to")


def embargo_split(df: DataFrame, sessions: DataFrame, share: float, horizon: int) -> DataFrame:
    """TRAIN, EMBARGO or TEST by session number: the last share of sessions, minus an embargo before it."""
    last = sessions.agg(F.max("idx")).scalar()
    cut = last - F.greatest(F.lit(1), F.floor(last * share))
    part = F.when(F.col("idx") > cut, "TEST").when(F.col("idx") > cut - horizon, "EMBARGO").otherwise("TRAIN")
    return df.withColumn("part", part)


def first_touch(trades: DataFrame, horizon: int) -> DataFrame:
    """Stop before target on each bar; a gap fills at the open; otherwise the last close or still open.

    `trades` carry bars, entry, target, stop; the level side follows from entry and target.
    """
    long = F.col("target") > F.col("entry")
    worse = lambda b: F.when(long, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop"))
    better = lambda b: F.when(long, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target"))
    past = lambda b, level, up: F.when(up, b["open"] >= F.col(level)).otherwise(b["open"] <= F.col(level))
    touched = F.get(F.filter("bars", lambda b: worse(b) | better(b)), F.lit(0))
    rows = trades.withColumn("_b", touched)
    b, last = F.col("_b"), F.try_element_at("bars", F.lit(-1))
    stopped = worse(b)
    fill = F.when(stopped, F.when(past(b, "stop", ~long), b["open"]).otherwise(F.col("stop"))).otherwise(
        F.when(past(b, "target", long), b["open"]).otherwise(F.col("target")))
    done = F.size("bars") >= horizon
    return rows.withColumns({
        "status": F.when(b.isNull(), F.when(done, "EXPIRED").otherwise("OPEN")).when(stopped, "FAILED").otherwise("COMPLETED"),
        "exit_reason": F.when(b.isNull(), F.when(done, "TIME_EXIT")).when(stopped, "STOP").otherwise("TARGET"),
        "exit_date": F.when(b.isNull(), F.when(done, last["date"])).otherwise(b["date"]),
        "exit_price": F.when(b.isNull(), F.when(done, last["close"])).otherwise(fill),
    }).drop("_b", "bars")


def same_day_trade(trades: DataFrame, slippage_bps: float = 10.0, commission_bps: float = 20.0, neutral: float = 0.2) -> DataFrame:
    """Same-day stop, target or close after the entry bar, long and short, net of slippage and commission."""
    long = F.col("direction") != "SHORT"
    fill = F.col("entry") * F.when(long, 1 + slippage_bps / 1e4).otherwise(1 - slippage_bps / 1e4)
    worse = lambda b: F.when(long, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop"))
    better = lambda b: F.when(long, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target"))
    later = F.slice("bars", 2, F.greatest(F.size("bars") - 1, F.lit(0)))
    rows = trades.withColumn("_b", F.get(F.filter(later, lambda b: worse(b) | better(b)), F.lit(0)))
    b = F.col("_b")
    price = F.when(b.isNull(), F.element_at("bars", -1)["close"]).when(worse(b), F.col("stop")).otherwise(F.col("target"))
    rows = rows.withColumns({
        "exit_reason": F.when(b.isNull(), "CLOSE").when(worse(b), "STOP").otherwise("TARGET"), "exit_price": price,
    })
    gross = F.when(long, F.col("exit_price") - fill).otherwise(fill - F.col("exit_price")) / fill * 100
    rows = rows.withColumn("pnl_pct", gross - 2 * commission_bps / 100)
    return rows.withColumn("outcome", F.when(F.col("pnl_pct") > neutral, "WIN").when(F.col("pnl_pct") < -neutral, "LOSS").otherwise("NEUTRAL")).drop("_b", "bars")


def target_replay(trades: DataFrame, multiples, cost_pct: float) -> DataFrame:
    """Net result of every trade with its target distance scaled by each multiple, by side."""
    rows = trades.withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    entry = F.col("entry")
    target = entry * (1 + sign * F.abs(F.col("target") - entry) / entry * F.col("multiple"))
    stopped = F.when(sign > 0, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    reached = F.when(sign > 0, F.col("high") >= target).otherwise(F.col("low") <= target)
    kind = F.when(stopped, "STOP").when(reached, "TARGET").otherwise("CLOSE")
    price = F.when(stopped, F.col("stop")).when(reached, target).otherwise(F.col("close"))
    rows = rows.withColumns({"kind": kind, "net": sign * (price - entry) / entry * 100 - cost_pct})
    share = lambda k: 100 * F.avg((F.col("kind") == k).cast("double"))
    return rows.groupBy("direction", "multiple").agg(
        F.count("*").alias("n"), share("TARGET").alias("target_pct"), share("STOP").alias("stop_pct"), F.avg("net").alias("net"))


def resolve_outcomes(decisions: DataFrame, bars: DataFrame, sessions: DataFrame, horizons, winsor: float = 0.01) -> DataFrame:
    """Grade every open decision at each horizon: entry at the next open, exit n sessions later at the
    open or at the last close of a name that stopped, over the session's mean; PENDING while incomplete."""
    last = sessions.agg(F.max("idx")).scalar()
    w = Window.partitionBy("symbol").orderBy("idx")
    rows = bars.join(sessions, "date")
    at = lambda c, n: F.first(c).over(w.rangeBetween(n, n))
    rows = rows.withColumns({"_in": at("open", 1)} | {f"_o{h}": at("open", 1 + h) for h in horizons}
                            | {f"_c{h}": F.last("close", ignorenulls=True).over(w.rangeBetween(1, h)) for h in horizons})
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_o{h}").alias("out"), F.col(f"_c{h}").alias("stop")) for h in horizons])
    graded = decisions.join(rows.select("symbol", "date", "idx", "_in", F.explode(each).alias("_e")).select("*", "_e.*"), ["symbol", "date"])
    done = F.col("idx") + 1 + F.col("horizon") <= last
    gone = done & F.col("out").isNull() & F.col("_in").isNotNull() & F.col("stop").isNotNull()
    graded = graded.withColumns({
        "stopped": F.coalesce(gone, F.lit(False)),
        "fwd": F.when(done, ratio(F.coalesce("out", "stop"), "_in") - 1),
        "pending": ~done,
    })
    graded = winsorize(graded, "fwd", winsor, "fwd_w", by=("date", "horizon"))
    mean = F.avg("fwd_w").over(Window.partitionBy("date", "horizon"))
    status = F.when(F.col("pending"), "PENDING").when(F.col("fwd").isNull(), "UNGRADEABLE").when(F.col("stopped"), "STOPPED_TRADING").otherwise("HORIZON")
    return graded.withColumns({"excess": F.col("fwd_w") - mean, "status": status}).select(
        *decisions.columns, "horizon", "fwd_w", "excess", "stopped", "status")


def resolve_appearances(appearances: DataFrame, bars: DataFrame) -> DataFrame:
    """Same-session, one- and five-bar returns after each appearance, from the first bar on or after it."""
    w = Window.partitionBy("symbol").orderBy("date")
    path = bars.select("symbol", "date", F.col("close").alias("entry_close"), F.lead("close", 1).over(w).alias("_c1"), F.lead("close", 5).over(w).alias("_c5"))
    out = asof_join(appearances, path, "symbol", "appeared", "date", ["entry_close", "_c1", "_c5"], direction="forward")
    same = F.when(F.col("matched") == F.col("appeared"), F.col("entry_close"))
    return out.withColumns({
        "return_same": 100 * (ratio(same, "entry_price") - 1),
        "return_1": 100 * (ratio("_c1", "entry_close") - 1), "return_5": 100 * (ratio("_c5", "entry_close") - 1),
    }).drop("_c1", "_c5", "matched")


