"""A sample of registered queries against their SQL checks (all: python tests/check_oracle.py)."""

import duckdb
import pytest
from check_oracle import canonical

import __spark_entry__ as contract
from volpanel.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "s01_fixed_bar_scan s02_contract_master s04_opening_anchors s05_execution_windows p11_counting_under_uncertainty p14_quote_gate "
    "j04_common_sessions u03_missing_sessions w01_log_returns w04_vol_of_vol w05_ewma_premium x06_index_feature_history "
    "a03_theil_sen_slope a05_model_free_variance m03_implied_volatility x04_carrier_surface x19_condor_candidates x21_buy_and_hold a19_path_metrics"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, duck, name):
    left = contract.queries()[name](spark, FOLDER).toPandas()
    right = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert canonical(left) == canonical(right)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
