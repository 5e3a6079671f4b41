"""Landing: exchange files, vendor payloads, upserts, snapshots and audit rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourse.functions.frames import finite, ratio
from bourse.functions.scalar import parse_date, parse_number
from bourse.session import written


def read_bars(spark: SparkSession, path: str, start: str, end: str, include_suspect: bool = False) -> DataFrame:
    """Bars of a date range; the plain comparisons on `date` prune partitions and reach the scan."""
    rows = spark.read.parquet(path).where((F.col("date") >= F.to_date(F.lit(start))) & (F.col("date") <= F.to_date(F.lit(end))) & (F.col("close") > 0))
    return rows if include_suspect else rows.where(~F.coalesce(F.col("is_suspect"), F.lit(False)))


def land_exchange_csv(spark: SparkSession, path: str, columns: dict, series=("EQ", "BE", "BZ", "SM", "ST"), keys=("date", "symbol", "series")) -> DataFrame:
    """An exchange day file: padded headers and cells trimmed, '-' as NULL, listed series, one row per key.

    `columns` maps file headers to (name, type); everything is read as text, so a bad cell is NULL and
    never fails the file.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    readers = {"string": lambda c: F.nullif(F.trim(c), F.lit("-")), "date": lambda c: parse_date(F.trim(c)), "double": parse_number, "long": lambda c: parse_number(c).cast("bigint")}
    rows = raw.select(*[(readers[kind](F.col(f"`{h}`")) if h in raw.columns else F.lit(None).cast("string" if kind == "string" else kind)).alias(name) for h, (name, kind) in columns.items()])
    rows = rows.where(F.col("symbol").isNotNull() & F.col("date").isNotNull() & (F.col("close") > 0))
    rows = rows.where(F.col("series").isin(*series)) if series else rows
    # Of a key's rows the largest one stays, compared by its columns in the order of `columns`.
    return rows.groupBy(*keys).agg(F.max(F.struct(*[n for n, _ in columns.values()])).alias("_r")).select("_r.*")


def land_two_layouts(old: DataFrame, new: DataFrame, old_map: dict, new_map: dict) -> DataFrame:
    """Two file layouts mapped onto one record type."""
    pick = lambda df, names: df.select(*[c.alias(n) for n, c in names.items()])
    return pick(old, old_map).unionByName(pick(new, new_map), allowMissingColumns=True)


def land_positional_table(df: DataFrame, payload: str, fields: dict) -> DataFrame:
    """Rows of a {tableHeaders, tableData} payload, each field found by the payload's own headers."""
    shape = "struct<tableHeaders:array<struct<unique_name:string>>,tableData:array<array<string>>>"
    rows = df.withColumn("_p", F.from_json(payload, shape))
    names = F.transform("_p.tableHeaders", lambda h: h["unique_name"])
    rows = rows.withColumns({"_h": names, "_row": F.explode("_p.tableData")})
    cell = lambda name: F.when(F.array_position("_h", name) > 0, F.get("_row", (F.array_position("_h", name) - 1).cast("int")))
    keep = [c for c in df.columns if c != payload]
    return rows.select(*keep, *[cell(name).cast(kind).alias(out) for out, (name, kind) in fields.items()])


def explode_statement(df: DataFrame, payload: str, periods, depth: int = 3) -> DataFrame:
    """A statement whose rows hold rows, flattened to (line item, period, value) to a fixed depth."""
    item = T.StructType([T.StructField("line_item", T.StringType()), *[T.StructField(p, T.StringType()) for p in periods]])
    for _ in range(depth - 1):
        item = T.StructType([*item.fields[: 1 + len(periods)], T.StructField("items", T.ArrayType(item))])
    keep = [c for c in df.columns if c != payload]
    level = df.select(*keep, F.explode(F.from_json(payload, T.ArrayType(item))).alias("_r"))
    parts = []
    for d in range(depth):
        parts.append(level.select(*keep, F.lit(d).alias("level"), F.col("_r.line_item").alias("line_item"), F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_r.{p}").alias("raw")) for p in periods])).alias("_e")))
        if d < depth - 1:
            level = level.select(*keep, F.explode("_r.items").alias("_r"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select(*keep, "level", "line_item", F.col("_e.period").alias("period"), parse_number("_e.raw").alias("value")).where("line_item IS NOT NULL AND value IS NOT NULL")


def merge_upsert(target: DataFrame, updates: DataFrame, keys, order: str, mode: str = "update") -> DataFrame:
    """Insert-or-update by key: `update` replaces, `ignore` keeps what is there, `fill_gaps` fills NULLs only.
    The batch is reduced to its newest row per key first."""
    keys, values = list(keys), [c for c in target.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_u"))
    both = target.withColumn("_t", F.lit(True)).join(newest, keys, "full")
    there = F.col("_t").isNotNull()
    def value(c):
        new = F.col("_u")[c]
        if mode == "update":
            return F.when(F.col("_u").isNotNull(), new).otherwise(F.col(c))
        return F.when(there, F.col(c)).otherwise(new) if mode == "ignore" else F.coalesce(F.col(c), new)
    return both.select(*keys, *[value(c).alias(c) for c in values])


def append_changes_only(history: DataFrame, updates: DataFrame, keys, value: str, order: str) -> DataFrame:
    """Updates that differ from the value before them, starting from the latest stored one."""
    keys = list(keys)
    latest = history.groupBy(*keys).agg(F.max_by(value, order).alias("_stored"), F.lit(True).alias("_known"))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    rows = updates.withColumns({"_before": before, "_first": first}).join(latest, keys, "left")
    changed = F.when(~F.col("_first"), ~F.col(value).eqNullSafe(F.col("_before"))).otherwise(F.col("_known").isNull() | ~F.col(value).eqNullSafe(F.col("_stored")))
    return rows.where(changed).select(*updates.columns)


def append_after_high_water(target: DataFrame, updates: DataFrame, keys, date: str) -> DataFrame:
    """Rows dated after each key's newest stored date; new keys come in whole."""
    marks = target.groupBy(*keys).agg(F.max(date).alias("_mark"))
    return updates.join(marks, list(keys), "left").where(F.col("_mark").isNull() | (F.col(date) > F.col("_mark"))).drop("_mark")


def replace_partition(df: DataFrame, path: str, partition_cols) -> None:
    """Replace exactly the partitions present in the batch."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash of a table."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash"))


def snapshot_with_manifest(spark: SparkSession, tables: dict, as_of: str, folder: str, budget_rows: int) -> DataFrame:
    """Freeze a run's inputs as files and return the manifest. Every table is written; count and order-free hash
    are observed by that same write, and `over_budget` only reports a table that is larger than planned."""
    facts = []
    for name, df in tables.items():
        seen = Observation(f"snapshot_{name}")
        df.observe(seen, F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash")).write.mode("overwrite").parquet(f"{folder}/{as_of}/{name}")
        facts.append((name, as_of, seen.get["rows"], seen.get["hash"], seen.get["rows"] > budget_rows))
    return spark.createDataFrame(facts, "`table` string, as_of string, rows bigint, hash string, over_budget boolean")


def completeness_watermark(dataset: str, df: DataFrame, partition: str, event_time: str, valid: Column, expected: DataFrame) -> DataFrame:
    """Expected, accepted and rejected rows and the event-time range of each partition."""
    got = df.groupBy(partition).agg(F.count_if(valid).alias("accepted"), F.count_if(~valid).alias("rejected"), F.min(event_time).alias("first_event"), F.max(event_time).alias("last_event"))
    out = expected.join(got, partition, "full").withColumns({"dataset": F.lit(dataset), "accepted": F.coalesce("accepted", F.lit(0)), "rejected": F.coalesce("rejected", F.lit(0))})
    return out.withColumn("complete", F.coalesce(F.col("accepted") >= F.col("expected"), F.lit(False)))


def stale_worklist(universe: DataFrame, done: DataFrame, as_of: Column, cap: int) -> DataFrame:
    """Symbols not yet refreshed for a date, never-covered and least recently covered first."""
    last = done.groupBy("symbol").agg(F.max("date").alias("last_done"))
    todo = universe.join(last, "symbol", "left").where(F.col("last_done").isNull() | (F.col("last_done") < as_of))
    return todo.orderBy(F.asc_nulls_first("last_done"), "symbol").limit(cap)


def clean_url(c) -> Column:
    """One scheme, lower-case host, single slashes in the path, no fragment."""
    url = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"^(?i)(https?):/+", "$1://")
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z]+)://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/{2,}", "/")
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def url_templates(urls: DataFrame, url: str = "url") -> DataFrame:
    """Endpoint templates: same host, path length and query keys; positions that vary are named by kind."""
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)
    segs = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    keys = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.split(p, "=")[0])), ",")
    rows = urls.select(url, host.alias("host"), segs.alias("_segs"), keys.alias("query_keys")).withColumn("segments", F.size("_segs"))
    key = ["host", "segments", "query_keys"]
    # Values per position are folded to (template, position) before anything is listed.
    spots = rows.select(*key, F.posexplode("_segs").alias("pos", "value")).groupBy(*key, "pos").agg(F.min("value").alias("v"), F.max("value").alias("_hi"))
    v = F.col("v")
    kind = F.when(F.rlike(v, F.lit(r"^\d{4}-\d{2}-\d{2}$")), "date").when(F.rlike(v, F.lit(r"^1\d{9}$")), "epoch").when(F.rlike(v, F.lit(r"^\d+$")), "int_id").otherwise("string")
    spots = spots.select(*key, F.struct("pos", F.when(v == F.col("_hi"), v).otherwise(F.concat(F.lit("{"), kind, F.lit("}"))).alias("part")).alias("_p"))
    paths = spots.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["part"]), "/").alias("path"))
    counts = rows.groupBy(*key).agg(F.count("*").alias("urls"))
    return counts.join(paths, key, "left").select(*key, F.concat(F.lit("/"), F.coalesce("path", F.lit(""))).alias("template"), "urls")


def _classified(v, ticker) -> Column:
    """Kind of a value: a known symbol, a date, seconds since 1970 (2001 to 2033), a number, else text."""
    epoch = (F.length(v) == 10) & v.try_cast("long").between(1_000_000_000, 2_000_000_000)
    number = F.rlike(v, F.lit(r"^\d+$"))
    return F.when(F.trim(v) == "", "string").when(ticker, "ticker").when(F.rlike(v, F.lit(r"^\d{4}-\d{2}-\d{2}$")), "date").when(number & epoch, "epoch").when(number, "int_id").otherwise("string")


def url_params(urls: DataFrame, universe: DataFrame, url: str = "url", samples: int = 5) -> DataFrame:
    """The parameters of each endpoint template: every path position that varies and every query key.

    A template is a prefix tree cut at host, path length and set of query keys; a node of it varies where more than one
    value stands at its place. A parameter's kind is that of its first value, `const` for a query key with one value;
    values that are symbols of `universe` (symbol, in any case) make a ticker. Columns: host, segments, query_keys,
    location (path or query), name, inferred_type, is_variable, distinct_count, sample_values (the first few, in order).
    """
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)
    segs = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(F.lit("query").alias("location"), decoded(F.substring_index(p, "=", 1)).alias("name"), decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))
    placed = F.transform(segs, lambda s, i: F.struct(F.lit("path").alias("location"), F.concat(F.lit("path_"), i.cast("string")).alias("name"), s.alias("value")))
    keys = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.split(p, "=")[0])), ",")
    rows = urls.where(F.trim(url) != "").select(host.alias("host"), F.size(segs).alias("segments"), keys.alias("query_keys"), F.explode(F.concat(placed, named)).alias("_p"))
    spot = ["host", "segments", "query_keys", "location", "name"]
    values = rows.select(*spot[:3], "_p.*").distinct()  # equal values of a place fold before anything is counted or listed
    facts = values.groupBy(*spot).agg(F.count("*").alias("distinct_count"), F.min("value").alias("_first"))
    order = Window.partitionBy(*spot).orderBy("value")
    some = values.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= samples).groupBy(*spot).agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    symbols = universe.select(F.upper("symbol").alias("_symbol")).distinct().withColumn("_known", F.lit(True))
    typed = facts.join(symbols, F.upper(F.trim("_first")) == F.col("_symbol"), "left").withColumn("is_variable", F.col("distinct_count") > 1)
    kind = F.when(F.col("is_variable"), _classified(F.col("_first"), F.col("_known").isNotNull())).otherwise("const")
    out = typed.join(some, spot).where("is_variable or location = 'query'")
    return out.select(*spot, kind.alias("inferred_type"), "is_variable", "distinct_count", "sample_values")


def url_triage(urls: DataFrame, families, url: str = "url") -> DataFrame:
    """Cleaned distinct URLs with the first family whose host and path patterns match."""
    rows = urls.select(clean_url(url).alias("clean")).groupBy("clean").agg(F.count("*").alias("seen"))
    host, rest = F.regexp_extract("clean", r"^[a-z]+://([^/?#]+)", 1), F.regexp_extract("clean", r"^[a-z]+://[^/?#]+(.*)$", 1)
    family = F.coalesce(*[F.when(F.rlike(host, F.lit(h)) & F.rlike(rest, F.lit(p)), name) for name, h, p in families], F.lit("unclassified"))
    return rows.withColumn("family", family)


def profile_json_fields(df: DataFrame, payload: str, group: str, previous: DataFrame | None = None) -> DataFrame:
    """Per field of flat payloads: coverage, numeric share, distinct values, range, and whether it is new."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_responses"))
    fields = df.select(group, F.explode(F.from_json(payload, "map<string,string>")).alias("path", "value"))
    number = finite(F.col("value").try_cast("double"))
    folded = fields.withColumn("_x", number).groupBy(group, "path").agg(
        F.count("*").alias("_present"), F.count("value").alias("_values"), F.count("_x").alias("_numbers"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"))
    # Exact in two steps: equal values of a field fold before they are counted.
    values = fields.where("value IS NOT NULL").select(group, "path", "value").distinct().groupBy(group, "path").agg(F.count("*").alias("distinct_values"))
    folded = folded.join(values, [group, "path"], "left")
    out = folded.join(sizes, group).select(group, "path", ratio("_present", "_responses").alias("coverage"), ratio("_numbers", "_values").alias("numeric_share"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "min", "max", "mean")
    if previous is None:
        return out
    return out.join(previous.select(group, "path").distinct().withColumn("_old", F.lit(True)), [group, "path"], "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def json_leaves(df: DataFrame, payload: str, keep) -> DataFrame:
    """(*keep, _row, path, kind, value): every scalar of nested payloads, whatever their depth.

    Object keys join to a dotted path; a list's items stand under the list's own path. A level of all payloads is opened
    at a time, and each is written, so the plan stays short. kind is number, string or other; value is the scalar as
    text. Payloads that are no JSON have no leaves.
    """
    v = F.schema_of_variant("_v")
    nested = F.startswith(v, F.lit("OBJECT")) | F.startswith(v, F.lit("ARRAY"))
    level = df.where(F.col(payload).isNotNull()).select(*keep, F.monotonically_increasing_id().alias("_row"), F.lit("").alias("path"), F.try_parse_json(payload).alias("_v"))
    level, leaves = written(level.where("_v is not null"), "payloads"), None
    kind = F.when(F.rlike(v, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), "number").when(v == "STRING", "string").otherwise("other")
    while True:
        some = level.where(~nested).select(*keep, "_row", "path", kind.alias("kind"), F.expr("try_variant_get(_v, '$', 'string')").alias("value"))
        leaves = some if leaves is None else leaves.union(some)
        deeper = level.where(nested)
        if deeper.isEmpty():
            return leaves
        opened = deeper.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()).alias("_e"))
        path = F.when(F.col("_e.key").isNull(), F.col("path")).when(F.col("path") == "", F.col("_e.key")).otherwise(F.concat_ws(".", "path", "_e.key"))
        level = written(opened.select(*keep, "_row", path.alias("path"), F.col("_e.value").alias("_v")), "payloads")


def profile_nested_fields(df: DataFrame, payload: str, group: str, universe: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Per path of nested payloads: type, fill rate, cardinality, numeric range, share of symbols, whether it is new.

    A path is numeric where numbers are at least as many as texts (min, max and mean are then given), else string where
    it has texts, else other. fill_rate: the share of the group's payloads that hold it; overlap: the share of its texts
    that are symbols of `universe` in any case.
    """
    sizes = df.where(F.length(payload) > 0).groupBy(group).agg(F.count("*").alias("_responses"))
    leaves = written(json_leaves(df, payload, [group]), "leaves")
    # Equal values of a payload's path fold first; presence and distinct values are then counted exactly in two steps.
    held = leaves.select(group, "path", "_row").distinct().groupBy(group, "path").agg(F.count("*").alias("_present"))
    values = leaves.groupBy(group, "path", "kind", "value").agg(F.count("*").alias("_n"))
    symbols = universe.select(F.upper("symbol").alias("_symbol")).distinct().withColumn("_known", F.lit(1))
    values = values.join(symbols, (F.col("kind") == "string") & (F.upper("value") == F.col("_symbol")), "left")
    of = lambda k, x="_n": F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(x))), F.lit(0))
    x = F.when(F.col("kind") == "number", F.col("value").try_cast("double"))
    facts = values.groupBy(group, "path").agg(
        of("number").alias("_numbers"), of("string").alias("_texts"), F.sum(F.when(F.col("kind") == "string", F.col("_n") * F.coalesce("_known", F.lit(0)))).alias("_met"),
        F.countDistinct("value").alias("_distinct"), F.max(F.col("value").isNull().cast("int")).alias("_null"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.sum(x * F.col("_n")).alias("_sum"))
    numeric = (F.col("_numbers") > 0) & (F.col("_numbers") >= F.col("_texts"))
    out = facts.join(held, [group, "path"]).join(sizes, group).select(
        group, "path", F.when(numeric, "numeric").when(F.col("_texts") > 0, "string").otherwise("other").alias("dtype"), ratio("_present", "_responses").alias("fill_rate"), (F.col("_distinct") + F.col("_null")).alias("cardinality"),
        F.when(numeric, F.col("_lo")).alias("min"), F.when(numeric, F.col("_hi")).alias("max"), F.when(numeric, ratio("_sum", "_numbers")).alias("mean"), F.coalesce(ratio("_met", "_texts"), F.lit(0.0)).alias("overlap"))
    if previous is None:
        return out
    return out.join(previous.select(group, "path").distinct().withColumn("_old", F.lit(True)), [group, "path"], "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def payload_features(responses: DataFrame, spec: dict) -> DataFrame:
    """Endpoint payloads to one typed row per symbol; spec maps output to (endpoint, JSON path).

    Payloads are parsed once. A list or a scalar where an object is expected, text that is no number and payloads that
    are no JSON give nulls, as do values of a million or more, which vendors use as marks.
    """
    rows = responses.select("symbol", "endpoint", F.try_parse_json("payload").alias("_v"))
    got = lambda path: F.try_variant_get("_v", path, "double")
    score = lambda path: F.when(got(path).between(-1e6, 1e6), got(path))
    return rows.groupBy("symbol").agg(*[F.max(F.when(F.col("endpoint") == e, score(path))).alias(out) for out, (e, path) in spec.items()])


def retention(parents: DataFrame, children: DataFrame, key: str, date: str, since: Column) -> DataFrame:
    """Child rows whose parent is still inside the window."""
    return children.join(parents.where(F.col(date) >= since).select(key), key, "left_semi")


def field_return_correlation(fields: DataFrame, returns: DataFrame, min_n: int) -> DataFrame:
    """Correlation of every numeric field with every return target across symbols."""
    both = fields.join(returns, "symbol").where(F.col("value").isNotNull() & F.col("ret").isNotNull())
    return both.groupBy("field", "target").agg(F.count("*").alias("n"), finite(F.corr("value", "ret")).alias("pearson")).where(F.col("n") >= min_n)


def register_flatten_statement(spark: SparkSession, name: str = "flatten_statement") -> None:
    """A table function for statements of unknown depth: flatten_statement(json) gives (level, line_item,
    period, raw). One small walk per payload; SQL calls it with LATERAL."""
    import json

    class FlattenStatement:
        def eval(self, payload: str):
            try:
                rows = [(0, r) for r in json.loads(payload or "[]")]
            except ValueError:
                return
            while rows:
                level, row = rows.pop(0)
                if not isinstance(row, dict):
                    continue
                for key, value in row.items():
                    if key not in ("line_item", "items") and row.get("line_item") and value is not None:
                        yield level, row["line_item"], key, str(value)
                rows.extend((level + 1, r) for r in row.get("items") or [])

    spark.udtf.register(name, F.udtf(FlattenStatement, returnType="level int, line_item string, period string, raw string"))
