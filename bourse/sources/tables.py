"""The driver tables, and the market-shaped views over them that stand in for vendor data."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.operators.calendar import session_table

TOTAL_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "l_extendedprice")


def bars_from_trades(trades: DataFrame, symbol, unit: str, price: str = "price") -> DataFrame:
    """OHLCV bars: one partially aggregated shuffle, so a hot symbol costs no more than a cold one."""
    order = F.struct(*TOTAL_ORDER)
    return (
        trades.groupBy(F.col(symbol).alias("symbol") if isinstance(symbol, str) else symbol.alias("symbol"),
                       F.date_trunc(unit, "ts").cast("date").alias("date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("qty").alias("volume"),
            F.count("*").alias("n"),
        )
    )


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def trades(self) -> DataFrame:
        part = self.part.select("p_partkey", "p_brand", "p_retailprice", "p_type")
        return self.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("raw_price"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
            "l_returnflag", "l_linestatus", "p_type",
        )

    @cached_property
    def bars_w(self) -> DataFrame:
        return bars_from_trades(self.trades, "symbol", "week")

    @cached_property
    def bars_m(self) -> DataFrame:
        return bars_from_trades(self.trades, "symbol", "month")

    @cached_property
    def bars_raw(self) -> DataFrame:
        return bars_from_trades(self.trades, "symbol", "week", "raw_price")

    @cached_property
    def bars_s(self) -> DataFrame:
        return bars_from_trades(self.trades, F.concat(F.lit("S"), F.col("l_suppkey")), "month")

    @cached_property
    def sessions_w(self) -> DataFrame:
        return session_table(self.lineitem.select(F.date_trunc("week", "l_shipdate").cast("date").alias("date")))

    @cached_property
    def sessions_m(self) -> DataFrame:
        return session_table(self.lineitem.select(F.date_trunc("month", "l_shipdate").cast("date").alias("date")))

    @cached_property
    def index_w(self) -> DataFrame:
        return self.bars_w.groupBy("date").agg(F.avg("close").alias("close"))

    @cached_property
    def index_m(self) -> DataFrame:
        return self.bars_m.groupBy("date").agg(F.avg("close").alias("close"))

    @cached_property
    def sectors(self) -> DataFrame:
        counts = self.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
        best = F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type")))
        return counts.groupBy(F.col("p_brand").alias("symbol")).agg(best.alias("sector"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.orders.groupBy(
            F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("as_of_date")
        ).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))

    @cached_property
    def decisions(self) -> DataFrame:
        keys = self.orders.select("o_orderkey", F.col("o_custkey").alias("symbol"))
        lines = self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            F.col("l_shipdate").cast("date").alias("date"),
        )
        return lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    @cached_property
    def spans(self) -> DataFrame:
        last = self.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
        return self.orders.join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
            F.col("o_orderkey").alias("span_id"),
            F.col("o_custkey").alias("symbol"),
            F.col("o_orderpriority").alias("list"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            F.when(F.col("last_ship") >= F.col("o_orderdate"), F.col("last_ship").cast("date")).alias("end_date"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        call, put = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
        iv = 0.1 + F.col("l_discount")
        return self.trades.groupBy(
            "symbol", F.date_trunc("month", "ts").cast("date").alias("expiry"), F.col("qty").alias("strike")
        ).agg(
            F.coalesce(F.sum(F.when(call, F.col("l_extendedprice"))), F.lit(0.0)).alias("ce_oi"),
            F.coalesce(F.sum(F.when(put, F.col("l_extendedprice"))), F.lit(0.0)).alias("pe_oi"),
            F.count_if(call).cast("double").alias("ce_vol"),
            F.count_if(put).cast("double").alias("pe_vol"),
            F.avg(F.when(call, iv)).alias("ce_iv"),
            F.avg(F.when(put, iv)).alias("pe_iv"),
        )

    @cached_property
    def spot(self) -> DataFrame:
        return self.trades.groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("expiry")).agg(
            F.avg("qty").alias("spot")
        )

    @cached_property
    def deals(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.lineitem.select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(flag == "N", "BUY").when(flag == "R", "SELL").alias("side"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("value"),
            "l_orderkey", "l_linenumber", "l_partkey",
        )

    @cached_property
    def preds(self) -> DataFrame:
        docs = self.documents.select("doc_id", "n_chars", "lang")
        return self.labels.join(docs, "doc_id").select(
            "doc_id",
            F.col("quality").cast("int").alias("y"),
            (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"),
            F.col("lang").alias("stratum"),
            (F.col("doc_id") % 20).alias("day"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.events.select(
            "event_id", F.col("event_type").alias("symbol"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Next-month results of every supplier bar, graded, with invented source, regime and horizon."""
        w = Window.partitionBy("symbol").orderBy("date")
        ret = F.col("return_pct")
        rows = self.bars_s.withColumn("return_pct", 100 * (F.lead("close").over(w) / F.col("close") - 1))
        return rows.select(
            "symbol", "date", "return_pct",
            F.when(ret.isNull(), "PENDING").when(ret <= -8, "STOP_LOSS").when(ret <= -2, "LOSS").when(ret >= 2, "WIN").otherwise("NEUTRAL").alias("outcome"),
            F.concat(F.lit("P"), F.col("n") % 3).alias("source"),
            F.when(F.month("date") <= 6, "BULL").otherwise("BEAR").alias("regime"),
            F.when(F.col("n") % 2 == 0, 5).otherwise(15).alias("horizon_days"),
            F.concat(F.lit("L"), F.substring("symbol", 2, 20).cast("int") % 10).alias("screener_id"),
            F.col("n").alias("prints"), (1.0 / (1.0 + F.exp(-(F.col("volume") - 250) / 200.0))).alias("p"),
            F.last_day("date").alias("resolved_on"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        seen = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderdate").cast("date").alias("first_seen")
        )
        start = F.to_date(F.lit("1995-01-01"))

        def fixed(df, prefix, key, kind):
            return df.select(F.concat(F.lit(prefix), F.col(key)).alias("key"), F.lit(kind).alias("kind"),
                             start.alias("available_at"))

        customers = self.customer.join(seen, "c_custkey", "left").select(
            F.concat(F.lit("C"), F.col("c_custkey")).alias("key"), F.lit("customer").alias("kind"),
            F.coalesce("first_seen", start).alias("available_at"))
        return (
            customers.unionByName(fixed(self.supplier, "S", "s_suppkey", "supplier"))
            .unionByName(fixed(self.nation, "N", "n_nationkey", "nation"))
            .unionByName(fixed(self.region, "R", "r_regionkey", "region"))
        )

    @cached_property
    def edges(self) -> DataFrame:
        def edge(df, prefix, key, predicate, to, target, when):
            return df.select(F.concat(F.lit(prefix), F.col(key)).alias("src"), F.lit(predicate).alias("predicate"),
                             F.concat(F.lit(to), F.col(target)).alias("dst"), when.alias("available_at"))

        start = F.to_date(F.lit("1995-01-01"))
        known = self.nodes.where("kind = 'customer'").select("key", "available_at")
        customers = self.customer.join(known, F.concat(F.lit("C"), F.col("c_custkey")) == F.col("key"))
        return (
            edge(customers, "C", "c_custkey", "located_in", "N", "c_nationkey", F.col("available_at"))
            .unionByName(edge(self.supplier, "S", "s_suppkey", "located_in", "N", "s_nationkey", start))
            .unionByName(edge(self.nation, "N", "n_nationkey", "part_of", "R", "n_regionkey", start))
        )
