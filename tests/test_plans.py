"""Plans of registered queries: no nested loops, no sort before an aggregate of the raw tables. ``CHECK_ALL=1`` builds all."""

import os
import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"
SOME = ["bars_weekly", "bars_events", "dedupe_resume", "train_impute_scale", "ridge_one_feature", "cs_pct_rank", "winsorize", "rank_ic",
        "embedding_knn", "market_regime", "load_scope"]
NAMES = sorted(queries()) if os.environ.get("CHECK_ALL") else SOME


def plans_of(spark, monkeypatch, name):
    """The plan of the result and of every table that is written on the way."""
    seen, write = [], DataFrameWriter.parquet

    def recorded(self, path, *args, **kw):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", recorded)
        df = queries()[name](spark, SMALL)
    return [*seen, df._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops(spark, monkeypatch, name):
    for plan in plans_of(spark, monkeypatch, name):
        assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)
        if name in ("bars_weekly", "bars_events", "dedupe_resume"):
            assert "SortAggregate" not in plan
