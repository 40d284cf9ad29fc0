"""Registered queries against DuckDB. ``CHECK_ALL=1`` runs every one of them."""

import os

import pytest
from checktool import SF_DIR, compare, connection

from __spark_entry__ import entry, oracle_sql, queries

FAST = ["bars_weekly", "quality_report", "company_dimension", "returns", "vol_std", "ema_macd", "market_regime",
        "group_neutral", "winsorize", "asof_daily", "split_audit", "rank_ic", "backtest", "sector_edges", "task_grid",
        "dedupe_resume"]
NAMES = sorted(oracle_sql()) if os.environ.get("CHECK_ALL") else FAST


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert len(got) > 0
    assert compare(got, want) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
