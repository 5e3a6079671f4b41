"""Faults that the third round's review found."""

import datetime as dt
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bourse.llm import neural_lm, phrases
from bourse.operators import backtest, ml, search, spans, text
from bourse.plans import REGISTRY, rank_queries


def test_a_long_text_is_cut_into_words_once(spark):
    words = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    aliases = spark.createDataFrame([("A", "w19998 w19999"), ("B", "w7"), ("C", "w7 w9")], "symbol string, alias string")
    start = time.monotonic()
    assert [(r.symbol, r["rank"]) for r in text.tag_entities(docs, aliases).orderBy("rank").collect()] == [("A", 1), ("B", 2)]
    assert time.monotonic() - start < 30


def test_alive_but_unpriced_names_leave_the_period(spark):
    """A name without a bar on the exit date that trades again is no loss, in the book or in the universe (flat prices: all returns are 0)."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(6)]
    rows = [(d, f"s{k}", 100.0, True) for d in days for k in range(6) if not (k == 0 and d == days[2])]
    panel = spark.createDataFrame(rows, "date date, symbol string, next_open double, eligible boolean")
    scores = panel.select("date", "symbol", "next_open", F.lit("f").alias("factor"), F.lit(1.0).alias("score"))
    sessions = spark.createDataFrame([(d, k) for k, d in enumerate(days)], "date date, idx int")
    got = backtest.factor_backtest(scores, panel, sessions, 1, 2, cost_bps=0.0).collect()
    assert len(got) == 5 and {(r.gross_pct, r.universe_pct, r.missing_exits) for r in got} == {(0.0, 0.0, 0)}


def _peak(run) -> float:
    """MB that Python and numpy hold at most while it runs."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_phrases_hold_few_words_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 800), pa.array([" ".join(f"w{k * 7 + j}" for j in range(1200)) for k in range(800)])], names=["lang", "text"])
    assert _peak(lambda: [keys.size for part in phrases.slices(iter([batch]), 3) for keys in part.opened(None, None)]) < 80


def test_the_language_model_holds_few_copies():
    v = neural_lm.Vocabulary({}, {}, {}, np.ones(neural_lm.OUTPUTS, np.int64), np.ones(neural_lm.OUTPUTS, np.int64), 1, 1)
    model = neural_lm.Model.start(neural_lm.noise_of(v))
    table = neural_lm.OUTPUTS * neural_lm.OUTPUTS * 4 / 1e6
    assert _peak(model.scores) < 5.5 * table
    texts = [" ".join(f"w{k * 3 + j}" for j in range(k % 7 * 50)) for k in range(9000)]
    _, tokens, ends = neural_lm.Encoder(v).stream(texts)
    again = neural_lm.Encoder(v).tokens(texts)
    assert np.array_equal(tokens, again[0]) and np.array_equal(ends, again[1]) and sum(map(len, texts)) > 3 * neural_lm.CUT


def test_a_search_of_the_index_is_a_scan_over_shards_and_blocks(spark, tmp_path, monkeypatch):
    """Pairs of query and document stay within a pair of shard and block."""
    monkeypatch.setattr(search, "SHARD", 40)
    monkeypatch.setattr(search, "BLOCK", 5)
    monkeypatch.setattr(search, "AT_ONCE", 2)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 9)), None) for k in range(150)], "doc long, text string, source string")
    asked = spark.createDataFrame([(q, f"w{(q + j) % 8}") for q in range(12) for j in (0, 1, 3, 3)], "qid long, term string")
    search.write_text_index(docs, str(tmp_path / "index"), {"text": 1.0, "source": 3.0}, "doc")
    cut = search.search_text_index(spark, str(tmp_path / "index"), asked, 6)
    assert "CoGroups" in cut._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.qid, r.doc, r.score, r["rank"]) for r in cut.collect()}
    monkeypatch.setattr(search, "SHARD", 10_000)
    monkeypatch.setattr(search, "BLOCK", 10_000)
    assert got == {(r.qid, r.doc, r.score, r["rank"]) for r in search.search_text_index(spark, str(tmp_path / "index"), asked, 6).collect()}
    assert len(got) == 72


def test_keyword_search_cuts_a_text_once(spark, monkeypatch):
    plans, write = [], text.written
    monkeypatch.setattr(text, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    docs = spark.createDataFrame([(1, "That, with that", "x"), (2, "with it", "that"), (3, None, "that"), (4, "none", "y")], "doc_id long, text string, source string")
    got = text.keyword_search(docs, ["that", "with"], {"text": 1.0, "source": 3.0}, "doc_id", 5).collect()
    assert [r.doc_id for r in got] == [2, 1] and plans[0].count("regexp_replace") == 2


def test_weights_of_a_fold_need_no_window(spark, monkeypatch):
    plans, fit = [], ml.LinearRegression.fit
    monkeypatch.setattr(ml.LinearRegression, "fit", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(self, df))
    rows = spark.createDataFrame([(f"s{k}", dt.date(2024, 1, 1) + dt.timedelta(d), d + 1, float(k * d % 5), float((k + d) % 3)) for k in range(6) for d in range(12)], "symbol string, date date, idx int, x double, y double")
    folds = spark.createDataFrame([(0, 1, 6, 8, 10)], "fold int, train_from int, train_to int, test_from int, test_to int")
    monkeypatch.setattr(ml, "fold_rows", lambda df, folds: df.withColumns({"fold": F.lit(0), "part": F.when(F.col("idx") <= 6, "TRAIN").otherwise("TEST")}))
    assert ml.train_ranker_ensemble(rows, ["x"], "y", folds, 24.0).count() == 36
    assert plans and not any("Window" in p for p in plans)


def test_the_evaluation_panel_is_stored_once(spark, monkeypatch):
    names, write = [], rank_queries.written
    monkeypatch.setattr(rank_queries, "written", lambda df, name: names.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("l_discount"))) or write(df, name))
    once = None
    for query in ("K35_hedge_weights", "K37_control_arms", "K42_event_study", "K18_attribute_calls"):
        names.clear()
        plan = REGISTRY[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        once = once or names[0]
        assert names == [once] and once[0] == "evaluation-panel" and "l_discount" not in plan, query


def test_span_breadth_sums_one_window_per_symbol(spark):
    d = lambda n: dt.date(2024, 1, n)
    held = spark.createDataFrame([("a", d(1), d(3)), ("a", d(2), None), (None, d(1), None)], "symbol string, start_date date, end_date date")
    days = [("a", d(1)), ("a", d(2)), ("a", d(2)), ("a", d(4)), ("b", d(2)), (None, d(2)), ("a", None)]
    want = sorted([("a", d(1), 1), ("a", d(2), 2), ("a", d(2), 2), ("a", d(4), 1), ("b", d(2), None), (None, d(2), None), ("a", None, None)], key=str)
    panel = spark.createDataFrame(days, "symbol string, date date")
    got = spans.span_breadth(held, panel)
    assert sorted(map(tuple, got.collect()), key=str) == want and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    more = spans.span_breadth(held, panel.withColumn("x", F.lit(1))).select("symbol", "date", "breadth")
    assert sorted(map(tuple, more.collect()), key=str) == want


def test_bars_and_ranks_are_read_once(spark):
    plan = lambda q: REGISTRY[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_discount" not in plan("K44_journal_grading") and "Join" not in plan("K33_provider_consistency")
