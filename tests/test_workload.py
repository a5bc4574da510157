"""Every query with SQL matches it on the smallest tables; names line up."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, texts

# The whole set runs in tools/check.py; these cover each family.
CHECKED = [
    "q_users_by_day", "q_account_drill", "q_backfill", "q_deviations_nan", "q_dev_matrix", "q_top_user_heatmap",
    "q_novelty_infer", "q_baseline_update", "q_policy", "q_user_day", "q_graph_merge", "q_train_human", "q_reasons",
    "q_graph_features", "q_graph_sample_nodes", "q_similarity", "q_curate", "q_regression",
]


def test_names():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = texts([tuple(r) for r in df.collect()], [df.columns.index(c) for c in columns])
    assert got == texts(rel.fetchall(), [list(rel.columns).index(c) for c in columns])


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "iforest_score" in df.columns
