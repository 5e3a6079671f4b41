"""Every query with an SQL twin, run on the smallest driver tables and compared row by row."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import canon, connect

FOLDER = os.environ.get("BOURSE_TEST_DATA", "/root/testdata/sf0.001")
# One or two of each family keep the suite short; tools/check.py runs them all.
SAMPLE = ["E2_returns", "E33_ffill_with_age", "J1_asof_lag_tolerance", "J2_asof_nearest_yoy", "J6_lateral_window_mean", "J10_span_breadth", "L10_forward_return_open", "L13_exit_path", "L22_average_uniqueness",
          "AG2_outcome_grouping_sets", "AG3_trade_metrics", "AG10_decile_table", "AG11_weighted_roc", "K1_per_date_ic", "K8_factor_backtest", "K24_classify_and_gate", "D1_max_pain", "T1_tag_entities",
          "I6_symbol_chain", "A6_merge_upsert_fill_gaps", "C14_verdict_report", "S1_bars_stream", "S11_daily_alert_cap", "P1_universe_mask", "F9_multi_format_dates"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql_twin(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no driver tables here")
    df = entry.queries()[name](spark, FOLDER)
    rel = connect(FOLDER).execute(entry.oracle_sql()[name])
    names, rows = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, df.collect()) == canon(names, rows)


def test_vector_search_takes_every_hundredth_row(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    df = entry.queries()["T9_vector_topk_hundredth"](spark, folder)
    rel = connect(folder).execute(entry.oracle_sql()["T9_vector_topk_hundredth"])
    rows = df.collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    assert {r.qid for r in rows} == ids and len(ids) > 10
    assert canon(df.columns, rows) == canon([d[0] for d in rel.description], rel.fetchall())


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables here")
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
