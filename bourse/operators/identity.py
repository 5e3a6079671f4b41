"""Identifiers, rename chains and the bitemporal graph."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.session import checkpoint_folder


def valid_isin(c) -> Column:
    """The upper-cased code if its form and check digit are right, else NULL."""
    code = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    chars = F.filter(F.split(code, ""), lambda x: x != "")
    digits = F.split(F.array_join(F.transform(chars, lambda x: F.when(F.rlike(x, F.lit("[A-Z]")), (F.ascii(x) - 55).cast("string")).otherwise(x)), ""), "")
    numbers = F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.cast("int"))
    double = F.transform(F.reverse(numbers), lambda x, i: F.when(i % 2 == 1, x * 2).otherwise(x))
    total = F.aggregate(double, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10)
    return F.when(F.rlike(code, F.lit("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")) & (total % 10 == 0), code)


def identity_keys(master: DataFrame) -> DataFrame:
    """ISIN-based issuer and instrument keys, else provisional ones with low confidence."""
    isin = valid_isin("isin")
    rows = master.withColumn("_isin", isin)
    fallback = F.concat_ws(":", F.lit("IN:PROVISIONAL"), F.coalesce("exchange", F.lit("NSE")), F.upper(F.trim("symbol")))
    ok = F.col("_isin").isNotNull()
    return rows.withColumns({
        "issuer_key": F.when(ok, F.concat(F.lit("IN:ISSUER:"), F.substring("_isin", 1, 7))).otherwise(fallback), "instrument_key": F.when(ok, F.concat(F.lit("IN:ISIN:"), "_isin")).otherwise(fallback),
        "basis": F.when(ok, "isin").otherwise("provisional_symbol"), "confidence": F.when(ok, 1.0).otherwise(0.35)}).drop("_isin")


def identifiers_long(master: DataFrame, schemes) -> DataFrame:
    """Wide provider-id columns to rows; schemes are (column, provider, scheme, confidence)."""
    each = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(s).alias("scheme"), F.col(c).cast("string").alias("value"), F.lit(conf).alias("confidence")) for c, p, s, conf in schemes])
    return master.select("symbol", F.explode(each).alias("_e")).select("symbol", "_e.*").where("value IS NOT NULL AND trim(value) <> ''")


def identifier_collisions(ids: DataFrame) -> DataFrame:
    """Provider ids that point to more than one symbol, candidates sorted."""
    owners = ids.select("provider", "scheme", "value", "symbol").distinct().groupBy("provider", "scheme", "value").agg(F.count("*").alias("owners"), F.array_sort(F.collect_list("symbol")).alias("_c"))
    return owners.where("owners > 1").select("provider", "scheme", "value", "owners", F.array_join("_c", ",").alias("candidates"))


def resolve_identifiers(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """resolved, ambiguous, not_found or invalid per (qid, provider, value); never a guess."""
    owners = ids.select("provider", "value", "symbol").distinct().groupBy("provider", "value").agg(F.count("*").alias("candidates"), F.min("symbol").alias("_s"))
    rows = queries.join(owners, ["provider", "value"], "left")
    blank = F.col("value").isNull() | (F.trim("value") == "")
    status = F.when(blank, "invalid").when(F.col("candidates").isNull(), "not_found").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return rows.select("qid", "provider", "value", status.alias("status"), F.when(status == "resolved", F.col("_s")).alias("symbol"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def renames_by_end(renames: DataFrame) -> DataFrame:
    """(old, current, hops, status) of every old symbol over (old, new), by pointer doubling.

    status `settled`: current is where the chain ends. `fork`: it reaches a symbol with more than one new one, which is
    current and where it stops (hops 0 for that symbol itself). `cycle`: it never ends, current and hops are NULL. After
    r rounds an unsettled pointer has gone 2**r steps, so once that exceeds the number of symbols it is in a cycle:
    the loop ends for any input, and no chain is too long.
    """
    checkpoint_folder(renames.sparkSession)
    ends = renames.select("old", "new").distinct().groupBy("old").agg(F.count("*").alias("_n"), F.min("new").alias("current")).checkpoint()
    forks = ends.where("_n > 1").select("old", F.col("old").alias("current"), F.lit(0).cast("bigint").alias("hops"))
    links = ends.where("_n = 1").select("old", "current", F.lit(1).cast("bigint").alias("hops"))
    symbols, steps, moving = links.count(), 1, True
    while moving and steps <= symbols:
        ahead = links.select(F.col("old").alias("current"), F.col("current").alias("_next"), F.col("hops").alias("_more"))
        moved = links.join(ahead, "current", "left").select("old", F.coalesce("_next", "current").alias("current"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_moved")).checkpoint()
        links, steps, moving = moved.drop("_moved"), 2 * steps, not moved.where("_moved").isEmpty()
    inside = links.select(F.col("old").alias("current"), F.lit(True).alias("_loops"))  # an end that still points on
    at_fork = forks.select("current", F.lit(True).alias("_forks"))
    out = links.join(inside, "current", "left").join(at_fork, "current", "left")
    status = F.when(F.col("_loops"), "cycle").when(F.col("_forks"), "fork").otherwise("settled")
    done = out.select("old", F.when(F.col("_loops").isNull(), F.col("current")).alias("current"), F.when(F.col("_loops").isNull(), F.col("hops")).alias("hops"), status.alias("status"))
    return done.unionByName(forks.withColumn("status", F.lit("fork")))


def symbol_chain(renames: DataFrame) -> DataFrame:
    """Current symbol of every old one whose chain has a single end, and its distance."""
    return renames_by_end(renames).where("status = 'settled'").drop("status")


def predecessors(renames: DataFrame) -> DataFrame:
    """(current, old, hops): all former symbols of each current one, the newest first in hops."""
    return symbol_chain(renames).select("current", "old", "hops")


def bitemporal_filter(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows known at and valid on a date; absent bounds are open."""
    out = df.where(F.col("available_at") <= as_of)
    if "valid_from" in df.columns:
        out = out.where((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    return out


def neighbourhood(nodes: DataFrame, edges: DataFrame, keys: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Outgoing and incoming edges of the asked keys, known and valid at `as_of`, at most `limit` per key."""
    from bourse.operators.sets import topk_per_group
    live = bitemporal_filter(edges, as_of)
    asked = keys.select("key").distinct()
    out = live.join(asked, F.col("src") == F.col("key")).select("key", F.lit("out").alias("direction"), "predicate", F.col("dst").alias("other"))
    into = live.join(asked, F.col("dst") == F.col("key")).select("key", F.lit("in").alias("direction"), "predicate", F.col("src").alias("other"))
    both = out.unionByName(into).join(bitemporal_filter(nodes, as_of).select(F.col("key").alias("other"), "kind"), "other")
    return topk_per_group(both, ["key"], [F.asc("direction"), F.asc("predicate"), F.asc("other")], limit)


def claim_rollup(claims: DataFrame, evidence: DataFrame, min_confidence: float) -> DataFrame:
    """Claims with their evidence as ordered JSON, and support against contradiction."""
    kept = evidence.where(F.col("confidence") >= min_confidence)
    rows = kept.groupBy("claim_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("evidence_id", "relation")))).alias("evidence"), F.count_if(F.col("relation") == "supports").alias("supports"), F.count_if(F.col("relation") == "contradicts").alias("contradicts"))
    return claims.join(rows, "claim_id", "left").withColumns({"evidence": F.coalesce("evidence", F.lit("[]")), "supports": F.coalesce("supports", F.lit(0)), "contradicts": F.coalesce("contradicts", F.lit(0))})


def decision_evidence(recs: DataFrame, components) -> DataFrame:
    """One row per component score: supports, contradicts or context against the row's direction."""
    each = F.array(*[F.struct(F.lit(c).alias("engine"), F.col(c).cast("double").alias("value")) for c in components])
    rows = recs.select("symbol", "date", "label", F.explode(each).alias("_e")).select("symbol", "date", "label", "_e.*").where("value IS NOT NULL")
    side = F.when(F.col("label").isin("Buy", "Strong Buy"), 1).when(F.col("label").isin("Sell", "Strong Sell"), -1).otherwise(0)
    lean = F.when(F.col("value") >= 60, 1).when(F.col("value") <= 40, -1).otherwise(0)
    relation = F.when((side == 0) | (lean == 0), "context").when(side == lean, "supports").otherwise("contradicts")
    return rows.select("symbol", "date", F.concat(F.lit("component:"), "engine").alias("evidence_key"), relation.alias("relation"), "value")
