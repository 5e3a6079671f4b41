"""Inputs that a cap, a round limit or a single micro-batch would answer wrongly."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bourse.operators import graph, identity, labels, rank, text, universe
from bourse.sources import landing
from bourse.streaming import live, sinks, state

START = dt.datetime(2024, 1, 1)


def test_long_chains_cycles_and_forks(spark):
    chain = [(f"a{k:03}", f"a{k + 1:03}") for k in range(100)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    fork = [("f", "g"), ("g", "h1"), ("g", "h2"), ("g", "h2")]
    rows = spark.createDataFrame(chain + cycle + fork, "old string, new string")
    got = {r.old: (r.current, r.hops, r.status) for r in identity.renames_by_end(rows).collect()}
    assert got == {f"a{k:03}": ("a100", 100 - k, "settled") for k in range(100)} | {k: (None, None, "cycle") for k in "wxyz"} | {"f": ("g", 1, "fork"), "g": ("g", 0, "fork")}
    before = [r.old for r in identity.predecessors(rows).where("current = 'a100'").orderBy("hops").collect()]
    assert before == [f"a{k:03}" for k in range(99, -1, -1)]


def test_components_wider_than_any_round_limit(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(100)] + [("p", "q"), ("s", "s")]
    got = {r.node: r.label for r in graph.component_labels(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{k:03}": "n000" for k in range(101)} | {"p": "p", "q": "p", "s": "s"}


def test_clusters_follow_links(spark):
    wave = [0.1, -0.2, 0.3, 0.05, -0.1, 0.2]
    rows = [(s, START.date() + dt.timedelta(d), x * (1 if s != "c" else -1)) for s in "abc" for d, x in enumerate(wave)]
    returns = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = rank.correlation_clusters(returns, returns.select("symbol").distinct(), 0.9, 3).collect()
    assert {(r.symbol, r.cluster) for r in got} == {("a", "a"), ("b", "a")}


def test_aliases_of_any_length(spark):
    docs = spark.createDataFrame([(1, "Shares of Alpha Beta, Gamma Delta Epsilon Zeta rose"), (2, "alpha beta gamma delta"), (3, None), (4, "")], "doc_id long, text string")
    aliases = spark.createDataFrame([("S6", "alpha beta gamma delta epsilon zeta"), ("S4", "alpha beta gamma delta"), ("S1", "rose"), ("S0", "lph")], "symbol string, alias string")
    got = {(r.doc_id, r.symbol, r["rank"]) for r in text.tag_entities(docs, aliases).collect()}
    assert got == {(1, "S6", 1), (1, "S4", 2), (1, "S1", 3), (2, "S4", 1)}


def test_more_queries_than_a_block(spark):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") / 7.0), F.sin(F.col("id") / 7.0)).alias("v"))
    asked = spark.range(250).select(F.col("id").alias("qid"), F.array(F.cos(F.col("id") / 41.0), F.sin(F.col("id") / 41.0)).alias("q"))
    few = {(r.qid, r.vec_id, r["rank"]) for r in text.vector_topk(asked, vectors, 3, block=20).collect()}
    assert len(few) == 750 and few == {(r.qid, r.vec_id, r["rank"]) for r in text.vector_topk(asked, vectors, 3).collect()}
    kept = text.vector_topk(asked, vectors, 3, live=spark.range(5).withColumnRenamed("id", "vec_id"))
    assert {r.vec_id for r in kept.collect()} <= set(range(5))


def test_windows_keep_every_entry(spark):
    bars = spark.createDataFrame([("a", k, START.date() + dt.timedelta(k), 10.0, 10.5, 9.5, 10.0) for k in range(4)], "symbol string, idx int, date date, open double, high double, low double, close double")
    entries = spark.createDataFrame([("a", 0, 10.0), ("a", 0, 10.0), ("a", 3, 10.0)], "symbol string, idx int, entry double")
    got = labels.holding_windows(entries, bars, 3)
    assert sorted((r.idx, len(r.bars)) for r in got.collect()) == [(0, 3), (0, 3), (3, 0)]
    trades = got.select("*", F.lit(5.0).alias("stop"), F.lit(20.0).alias("target"), F.lit(None).cast("double").alias("atr"), F.lit("long").alias("direction"))
    last = labels.exit_path(trades).where("idx = 3").first()
    assert last.exit_reason == "PENDING" and last.exit_price is None and last.mfe_pct is None
    assert labels.excursions(trades).where("idx = 3").first().mfe_pct is None
    assert labels.first_touch(trades, 3).where("idx = 3").first().status == "OPEN"


def test_exact_distinct_counts(spark):
    rows = spark.range(5000).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    got = {r["column"]: r.drop_reason for r in universe.untrainable(rows, ["a", "b"], F.lit(True), 0.1, 5000, 0.0).collect()}
    assert got == {"a": None, "b": "FEW_VALUES"}
    fields = spark.createDataFrame([("e", f'{{"k":{k},"n":"x"}}') for k in range(3000)], "g string, p string")
    assert {r.path: r.distinct_values for r in landing.profile_json_fields(fields, "p", "g").collect()} == {"k": 3000, "n": 1}


def test_snapshot_writes_every_table(spark, tmp_path):
    got = landing.snapshot_with_manifest(spark, {"big": spark.range(100), "small": spark.range(3)}, "d", str(tmp_path), 10).collect()
    assert {(r.table, r.rows, r.over_budget) for r in got} == {("big", 100, True), ("small", 3, False)}
    again = landing.content_hash(spark.read.parquet(f"{tmp_path}/d/big").orderBy(F.desc("id"))).first()
    assert (again.rows, again.hash) == (100, next(r.hash for r in got if r.table == "big"))


@pytest.fixture
def files(spark, tmp_path):
    """A stream of one file a batch; rows are (seconds, event_id, symbol, price)."""
    schema = "event_id long, symbol string, ts timestamp, price double"

    def stream(*batches):
        for k, rows in enumerate(batches):
            path = str(tmp_path / f"in/{k}")
            spark.createDataFrame([(i, s, START + dt.timedelta(seconds=at), p) for at, i, s, p in rows], schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    return stream


def test_upserts_merge_over_batches(spark, files, tmp_path):
    rows = files([(0, 1, "a", 1.0), (0, 2, "b", 2.0)], [(9, 9, "a", 9.0)], [(3, 3, "a", 3.0), (3, 4, "c", 4.0)], [(5, 5, "b", 5.0)])
    folder, each = str(tmp_path / "out"), sinks.upsert_latest(["symbol"], "event_id")
    sinks.run_available(rows, folder, each=each)
    newest = lambda: {(r.symbol, r.price) for r in sinks.read_latest(spark, folder, rows.schema, ["symbol"], "event_id").collect()}
    assert newest() == {("a", 9.0), ("b", 5.0), ("c", 4.0)}
    replayed = spark.createDataFrame([(9, "a", START, 9.0)], rows.schema)
    each(replayed, folder, 1)
    assert newest() == {("a", 9.0), ("b", 5.0), ("c", 4.0)}
    path = sinks.compact_latest(spark, folder, rows.schema, ["symbol"], "event_id", 1)
    assert spark.read.parquet(path).count() == 3


def test_late_rows_go_aside(spark, files, tmp_path):
    rows = files([(0, 1, "a", 1.0)], [(5000, 2, "a", 1.0)], [(100, 3, "a", 1.0), (4900, 4, "a", 1.0)], [(6000, 5, "a", 1.0)])
    folder = str(tmp_path / "out")
    sinks.run_available(rows, folder, each=sinks.split_late("ts", 600))
    ids = lambda part: {r.event_id for r in sinks.read_rows(spark, folder, rows.schema, part).collect()}
    assert ids("rows") == {1, 2, 4, 5} and ids("late") == {3}


def test_cycles_cut_by_batches_are_ranked_once(spark, files, tmp_path):
    from bourse.plans.streaming_queries import rank_closed
    rows = files([(0, 1, "a", 1.0), (60, 2, "b", 5.0)], [(120, 3, "a", 3.0), (90, 4, "b", 7.0), (95, 5, "c", 9.0)], [(130, 6, "c", 1.0), (4000, 7, "a", 1.0)], [(20000, 8, "a", 1.0)])
    rank_closed(rows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    assert {(r.symbol, r.score, r.n, r["rank"]) for r in got} == {("b", 6.0, 2, 1), ("c", 5.0, 2, 2)} and len(got) == 2


def test_ended_signals_stay_ended(spark, files, tmp_path):
    rows = files([(0, 1, "s", 10.0), (0, 2, "t", 10.0)], [(10, 3, "t", 50.0)], [(500, 4, "u", 10.0)], [(900, 5, "v", 10.0)], [(160, 6, "s", 10.0), (901, 7, "v", 10.0)], [(905, 8, "t", 90.0), (2000, 9, "v", 10.0)])
    quotes = rows.withColumns({"signal_id": F.col("symbol"), "up": F.lit(3.0), "down": F.lit(0.9)})
    out = state.signal_expiry(quotes, "1 second", 400)
    sinks.run_available(out, str(tmp_path / "out"))
    got = sorted((r.signal_id, r.status) for r in sinks.read_rows(spark, str(tmp_path / "out"), out.schema).collect())
    assert got.count(("s", "EXPIRED")) == 1 and got.count(("t", "COMPLETED")) == 1 and [g for g in got if g[0] in "st"] == [("s", "EXPIRED"), ("t", "COMPLETED")]
