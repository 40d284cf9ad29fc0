"""Many scores side by side against one at a time, in a task and sorted over the cluster."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.operators import evaluate, xsection

PAIRS = [("a", "y"), ("b", "y"), ("a", "z"), ("c", "z")]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    draw = lambda: None if rng.random() < 0.1 else round(float(rng.normal()), 1)
    rows = [("val" if t < 6 else "test", dt.date(2020, 1, 1) + dt.timedelta(days=t), f"S{s:02d}", f"sec{s % 2}", draw(), draw(), 1.0, draw(), draw(), float(rng.normal()))
            for t in range(12) for s in range(40 if t != 4 else 6)]
    return spark.createDataFrame(rows, "split string, date date, symbol string, sector string, a double, b double, c double, y double, z double, r double")


def sorted_rows(df, keys):
    return [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in sorted(df.collect(), key=lambda r: [str(r[k]) for k in keys])]


def test_stats_of_columns_are_those_of_each_pair(wide):
    every = evaluate.rank_ics(wide, ["split"], PAIRS, 10)
    for i, (s, t) in enumerate(PAIRS):
        one = evaluate.rank_ic(wide, ["split"], s, t, 10)
        assert sorted_rows(every.where(F.col("_run") == i).drop("_run"), ["date"]) == sorted_rows(one, ["date"])
        got = {r.date: r for r in one.collect()}
        for d, g in wide.dropna(subset=[s, t]).toPandas().groupby("date"):
            if len(g) < 10:
                assert d not in got
            elif s == "c":
                assert got[d].rank_ic is None and got[d].ic is None
            else:
                assert abs(got[d].rank_ic - g[s].rank().corr(g[t].rank())) < 1e-9 and abs(got[d].ic - g[s].corr(g[t])) < 1e-9


@pytest.mark.parametrize("neutral", [False, True])
def test_large_dates_give_the_same(wide, monkeypatch, neutral):
    def results():
        stats = evaluate.day_stats(wide, ["split"], PAIRS, 10, share=0.2)
        legs = evaluate.leg_rows(wide.select("split", "date", "symbol", "sector", "r", "a", "b"), ["split"], ["a", "b"], 0.2, 10, need=("r",), sector_neutral=neutral, least=10)
        return sorted_rows(stats, ["_run", "date"]), sorted_rows(legs, ["_run", "date", "symbol"])
    small = results()
    monkeypatch.setattr(evaluate, "DAY_ROWS", 10)
    assert results() == small
    assert small[1]


def test_backtests_of_columns_are_those_of_each(wide):
    how = dict(share=0.2, every=2, cost_bps=5.0, min_names=10)
    every = evaluate.backtests(wide, ["split"], ["a", "b"], "r", **how)
    for i, s in enumerate(("a", "b")):
        assert sorted_rows(every.where(F.col("_run") == i).drop("_run"), ["split", "date"]) == sorted_rows(evaluate.backtest(wide, ["split"], s, "r", **how), ["split", "date"])


def test_blend_in_a_row_is_that_of_long_members(wide):
    kept = wide.select("date", "symbol", "a", "b")
    weights = {"a": 0.7, "b": 0.2}
    long = kept.unpivot(["date", "symbol"], ["a", "b"], "run", "x").withColumn("w", F.when(F.col("run") == "a", 0.7).otherwise(0.2))
    want = {(r.date, r.symbol): r for r in xsection.rank_blend(long, "x", "w").collect()}
    equal, weighted = xsection.row_blend([(f"q_rank_{c}", w) for c, w in weights.items()])
    got = xsection.pct_ranks(kept, ["date"], ["a", "b"], "q").select("date", "symbol", equal.alias("e"), weighted.alias("w")).collect()
    assert len(got) == len(want)
    for r in got:
        other = want[r.date, r.symbol]
        assert r.e == other.rank_equal and (r.w is None) == (other.rank_weighted is None)
        assert r.w is None or abs(r.w - other.rank_weighted) < 1e-11
    assert any(r.e is None for r in got)
