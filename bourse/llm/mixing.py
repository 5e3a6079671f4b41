"""Mixing sources to target token weights by entropy balancing.

Every document gets a rate (copies on average). Among all rates whose tokens meet their source's target, those closest
to "one copy of each" in relative entropy are exponential in the document's size: rate = min(cap, exp(lambda * size /
mean size)), with one lambda per source. lambda minimises the convex dual; Newton steps find it, each a single
distributed sum over the histogram of (source, size), which is exact because a rate depends on nothing else. Sums are
decimal, so their order does not matter and reruns agree. Rates are then rounded into whole copies.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm.shared import WORD, body, quoted, stored


def word_count(text: str) -> Column:
    """The number of words of the whole text."""
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(_source, _tokens, ...) with `_target`: weights in code-point order of the source (null last), repeating.

    All tokens are shared by weight; a target stops at `cap` times its source's tokens, and what it cannot take goes to
    the others by weight. With the sources ordered by cap * tokens / weight the level of the open ones has a closed form.
    """
    ordered = Window.orderBy(F.col("_source").asc_nulls_last())
    steps = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_w", F.element_at(steps, F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("_limit", F.lit(float(cap)) * F.col("_tokens"))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("_tokens").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return levels.withColumn("_target", F.least("_limit", F.col("_level") * F.col("_w"))).drop("_level")


def _rate(cap: float) -> Column:
    return F.when(F.col("_full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("_lambda") * F.col("_x"))))


def solve_tilts(histogram: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """sources with `_lambda`, the tilt of each. histogram: (_source, _size > 0, _n).

    Newton's step on the logarithm of the tokens a tilt gives, inside a bracket that every step narrows; each eighth
    step halves a closed bracket, so the loop ends for any input. It stops once every source is met or cannot move.
    """
    state = stored(
        sources.select(
            "_source", "_tokens", "_target", (F.col("_tokens") / F.col("_docs")).alias("_mean"),
            (F.col("_target") >= F.lit(cap * (1 - 1e-12)) * F.col("_tokens")).alias("_full"), F.lit(0.0).alias("_lambda"),
            F.when(F.col("_target") >= F.col("_tokens"), F.lit(0.0)).alias("_lo"), F.when(F.col("_target") <= F.col("_tokens"), F.lit(0.0)).alias("_hi"),
            (F.col("_tokens") == 0).alias("_done"),
        ),
        "mix-state",
    )
    step = 0
    while not state.where("not _done and not _full").isEmpty():
        step += 1
        active = state.where("not _done and not _full")
        x, n = F.col("_size") / F.col("_mean"), F.col("_n")
        rated = histogram.join(active, "_source").withColumn("_x", x).withColumn("_r", _rate(cap))
        exact = lambda c: F.sum(c.cast("decimal(38,14)"))
        sums = rated.groupBy("_source").agg(
            exact(n * F.col("_x") * F.col("_r")).cast("double").alias("_g"),
            exact(F.when(F.col("_r") < cap, n * F.col("_x") * F.col("_x") * F.col("_r")).otherwise(F.lit(0.0))).cast("double").alias("_h"),
        )
        goal = F.col("_target") / F.col("_mean")
        low = F.col("_g") < goal
        moved = state.join(sums, "_source", "left").withColumns({
            "_lo": F.when(low, F.col("_lambda")).otherwise(F.col("_lo")),
            "_hi": F.when(low, F.col("_hi")).otherwise(F.coalesce(F.when(F.col("_g").isNotNull(), F.col("_lambda")), F.col("_hi"))),
        })
        newton = F.col("_lambda") + (F.log(goal) - F.log("_g")) * F.col("_g") / F.col("_h")
        middle = (F.col("_lo") + F.col("_hi")) / 2
        inside = F.when((F.col("_h") > 0) & (F.coalesce(newton > F.col("_lo"), F.lit(True))) & (F.coalesce(newton < F.col("_hi"), F.lit(True))), newton)
        far = F.when(low, F.col("_lambda") + 1.0).otherwise(F.col("_lambda") - 1.0)
        chosen = F.coalesce(middle, inside, far) if step % 8 == 0 else F.coalesce(inside, middle, far)
        met = F.abs(F.col("_g") - goal) <= F.lit(tolerance) * goal
        stuck = (F.col("_hi") - F.col("_lo")) <= F.lit(1e-14) * (F.abs("_hi") + F.abs("_lo"))
        done = F.col("_done") | F.coalesce(met, F.lit(False)) | F.coalesce(stuck, F.lit(False))
        state = stored(
            moved.withColumn("_now", done).withColumn("_lambda", F.when(F.col("_now") | F.col("_full"), F.col("_lambda")).otherwise(chosen)).withColumn("_done", F.col("_now")).drop("_g", "_h", "_now"),
            "mix-state",
        )
    return state


def whole_copies(classes: DataFrame, cap: int, rounds: int = 4) -> DataFrame:
    """classes (_source, _size, _n, _r, _target) with `_k`, the copies that the class of equal sizes gets in all.

    Largest sizes first, the running sum of rates is rounded and its steps are taken, so that neighbours in size make
    up for each other. What a source is then off by is settled with copies of the largest sizes that still fit.
    """
    down = Window.partitionBy("_source").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.round(F.sum((F.col("_n") * F.col("_r")).cast("decimal(38,12)")).over(down))
    steps = classes.withColumn("_run", running.cast("long"))
    previous = F.coalesce(F.lag("_run").over(Window.partitionBy("_source").orderBy(F.col("_size").desc())), F.lit(0))
    out = stored(steps.withColumn("_k", F.least(F.greatest(F.col("_run") - previous, F.lit(0)), F.lit(cap) * F.col("_n"))).drop("_run"), "mix-copies")
    for _ in range(rounds):
        off = out.groupBy("_source").agg((F.max("_target") - F.sum(F.col("_k") * F.col("_size"))).alias("_off"))
        room = F.when(F.col("_off") > 0, F.lit(cap) * F.col("_n") - F.col("_k")).otherwise(F.col("_k"))
        fits = (F.col("_size") <= F.abs("_off")) & (room > 0)
        pick = out.join(off, "_source").where(fits).groupBy("_source").agg(F.max("_size").alias("_pick"), F.max("_off").alias("_off"))
        step = F.least(room, F.floor(F.abs("_off") / F.col("_size"))) * F.signum("_off").cast("long")
        out = stored(out.join(pick, "_source", "left").withColumn("_k", F.col("_k") + F.when(F.col("_size") == F.col("_pick"), step).otherwise(0).cast("long")).drop("_pick", "_off"), "mix-copies")
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, id: str = "doc_id", text: str = "text", source: str = "source", key: Column | None = None) -> DataFrame:
    """One row per input row: `id`, size, source_size, target, taken (= copies * size), copies, and rate.

    A null text has size 0, as an empty one; documents of size 0 get one copy, which takes no words. A null source is a
    source of its own. Which of a source's equally long documents get the odd copies is decided by a hash of the id
    (`key` replaces it); rows that share an id are told apart by their order. Other columns are not passed on. Empty
    in, empty out.
    """
    key = F.xxhash64(quoted(id).cast("string")) if key is None else key
    sized = stored(
        docs.select(
            quoted(id).alias("_id"), quoted(source).cast("string").alias("_name"), word_count(text).alias("_size"), key.alias("_h"), F.monotonically_increasing_id().alias("_row"),
        # A null source gets a key of its own, so that plain equality joins serve.
        ).withColumn("_source", F.when(F.col("_name").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "_name"))),
        "mix-sized",
    )
    histogram = stored(sized.groupBy("_source", "_size").agg(F.count("*").alias("_n"), F.min("_name").alias("_name")), "mix-histogram")
    per_source = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_tokens"), F.sum("_n").alias("_docs"), F.min("_name").alias("_name"))
    named = per_source.withColumnRenamed("_source", "_key").withColumnRenamed("_name", "_source")
    targets = stored(source_targets(named, weights, cap).drop("_source").withColumnRenamed("_key", "_source"), "mix-targets")
    filled = histogram.where("_size > 0").select("_source", "_size", "_n")
    tilts = solve_tilts(filled, targets, cap).select("_source", "_tokens", "_target", "_mean", "_full", "_lambda")
    classes = filled.join(tilts, "_source").withColumn("_x", F.col("_size") / F.col("_mean")).withColumn("_r", _rate(cap))
    classes = whole_copies(classes.select("_source", "_size", "_n", "_r", "_tokens", "_target"), cap)

    # Place of a document among those of its class: a hash bucket's offset, then the place within the bucket, so that
    # no class has to meet in one task however large it is.
    bucketed = sized.withColumn("_bucket", F.shiftrightunsigned("_h", 54).cast("int"))
    counts = bucketed.groupBy("_source", "_size", "_bucket").agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_ahead", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c")
    ends = histogram.select("_source", "_size").join(targets.select("_source", F.col("_tokens").alias("_all"), F.col("_target").alias("_goal")), "_source")
    plan = offsets.join(ends.join(classes, ["_source", "_size"], "left"), ["_source", "_size"])
    in_bucket = Window.partitionBy("_source", "_size", "_bucket").orderBy("_h", "_id", "_row")
    placed = bucketed.withColumn("_place", F.row_number().over(in_bucket)).join(plan, ["_source", "_size", "_bucket"])
    odd = (F.col("_ahead") + F.col("_place")) <= F.pmod(F.col("_k"), F.col("_n"))
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.expr("_k div _n") + odd.cast("long")).cast("long")
    return placed.select(
        F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_goal").alias("target"),
        (copies * F.col("_size")).alias("taken"), copies.alias("copies"), F.coalesce("_r", F.lit(1.0)).alias("rate"),
    )
