import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import evaluate, experiments

KEYS = ["run"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for run in ("a", "b"):
        for t in range(9):
            for s in range(30 if t != 4 else 6):
                x = round(float(rng.normal()), 1)
                rows.append((run, dt.date(2020, 1, 1) + dt.timedelta(days=t), f"S{s:02d}", f"sec{s % 2}", x,
                             float(rng.normal()) / 50))
    return spark.createDataFrame(rows, "run string, date date, symbol string, sector string, x double, ret double")


def test_ic_is_invariant_and_matches_pandas(panel):
    base = evaluate.rank_ic(panel, KEYS, "x", "ret", 10).toPandas().sort_values(["run", "date"])
    warped = evaluate.rank_ic(panel.withColumn("x", F.exp("x") * 3 + 1), KEYS, "x", "ret", 10).toPandas()
    np.testing.assert_allclose(base["rank_ic"], warped.sort_values(["run", "date"])["rank_ic"], atol=1e-9)
    want = [g["x"].rank().corr(g["ret"].rank()) for _, g in panel.toPandas().query("run == 'a'").groupby("date") if len(g) >= 10]
    np.testing.assert_allclose(base.query("run == 'a'")["rank_ic"], want, atol=1e-9)


def test_constant_score_has_no_correlation(panel):
    out = evaluate.rank_ic(panel.withColumn("x", F.lit(1.0)), KEYS, "x", "ret", 10).collect()
    assert out and all(r["rank_ic"] is None for r in out)


@pytest.mark.parametrize("neutral", [False, True])
def test_weights_sum_to_zero_and_one(panel, neutral):
    choose = evaluate.sector_neutral_weights if neutral else evaluate.long_short_weights
    out = choose(panel, KEYS, "x", 0.1, 12).groupBy("run", "date").agg(
        F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).collect()
    assert out
    for r in out:
        assert abs(r["net"]) < 1e-12 and abs(r["gross"] - 1) < 1e-12


def test_overlapping_legs_net(spark):
    df = spark.createDataFrame([("r", dt.date(2020, 1, 1), "A", 1.0)], "run string, date date, symbol string, x double")
    rows = evaluate.long_short_weights(df, KEYS, "x", 0.1, 1).collect()
    assert [r["weight"] for r in rows] == [0.0]


def loop_backtest(pdf, share, every, bps, need):
    dates = sorted(pdf["date"].unique())[::every]
    held, rows = {}, []
    for d in dates:
        g = pdf[pdf["date"] == d].dropna().sort_values(["x", "symbol"])
        if len(g) < need:
            continue
        k = max(1, int(len(g) * share))
        w = {s: -0.5 / k for s in g["symbol"][:k]}
        for s in g["symbol"][-k:]:
            w[s] = w.get(s, 0) + 0.5 / k
        ret = sum(w[s] * r for s, r in zip(g["symbol"], g["ret"]) if s in w)
        turn = 0.5 * sum(abs(w.get(s, 0) - held.get(s, 0)) for s in set(w) | set(held))
        rows.append((d, ret, turn, ret - turn * bps / 1e4))
        held = w
    return pd.DataFrame(rows, columns=["date", "gross_return", "turnover", "net_return"])


@pytest.mark.parametrize("every", [1, 2])
def test_backtest_equals_the_loop(panel, every):
    got = evaluate.backtest(panel, KEYS, "x", "ret", share=0.1, every=every, cost_bps=5, min_names=12).toPandas()
    for run, pdf in panel.toPandas().groupby("run"):
        want = loop_backtest(pdf, 0.1, every, 5, 12)
        mine = got[got["run"] == run].sort_values("date").reset_index(drop=True)
        for c in ("gross_return", "turnover", "net_return"):
            np.testing.assert_allclose(mine[c], want[c], atol=1e-12)
        np.testing.assert_allclose(mine["equity_net"], (1 + want["net_return"]).cumprod())


def test_suspect_flag(spark):
    df = spark.createDataFrame([(3.5, 0.0), (None, 6.0), (1.0, None)], "s double, i double")
    assert [r[0] for r in df.select(evaluate.suspect(F.col("s"), F.col("i"))).collect()] == [True, True, False]


def test_thinned_grid_keeps_linspace_positions(spark):
    df = spark.createDataFrame([("g", i) for i in range(11)], "g string, i int")
    kept = sorted(r["i"] for r in experiments.thin_grid(df, ["g"], ["i"], 4).collect())
    assert kept == [int(v) for v in np.linspace(0, 10, 4, dtype=int)]


def test_fold_deviation_of_one_fold_is_zero(spark):
    df = spark.createDataFrame([("m", "f1", 0.5)], "model string, fold string, v double")
    row = experiments.across_folds(df, ["model"], ["v"]).first()
    assert (row["mean_v"], row["median_v"], row["std_v"]) == (0.5, 0.5, 0.0)


def test_gate_reasons_in_order(spark):
    runs = spark.createDataFrame([("low", -0.1), ("none", 0.1), ("few", 0.1), ("ok", 0.1)], "run_name string, mean_rank_ic double")
    yearly = spark.createDataFrame([("few", 1, 1.0, 0.1), ("ok", 3, 1.0, 0.1), ("low", 3, 1.0, 0.1)],
                                   "run_name string, val_years long, val_positive_year_frac double, val_min_year_rank_ic double")
    got = {r["run_name"]: r for r in experiments.stability(runs, yearly, None).collect()}
    assert {k: r["stability_reason"] for k, r in got.items()} == {
        "low": "low_full_val_rank_ic", "none": "empty_val_rank_ic_file", "few": "too_few_val_years", "ok": "pass"}
    # figures past the first failing gate stay empty
    assert {k: (r["val_years"], r["val_positive_year_frac"]) for k, r in got.items()} == {
        "low": (0, None), "none": (0, None), "few": (1, None), "ok": (3, 1.0)}


def test_worst_regime_is_empty_unless_reached(spark):
    runs = spark.createDataFrame([("bad", 0.1), ("weak", 0.1), ("ok", 0.1)], "run_name string, mean_rank_ic double")
    yearly = spark.createDataFrame([("bad", 3, 0.2, -0.1), ("weak", 3, 1.0, 0.1), ("ok", 3, 1.0, 0.1)],
                                   "run_name string, val_years long, val_positive_year_frac double, val_min_year_rank_ic double")
    regimes = spark.createDataFrame([("bad", -0.5), ("weak", -0.5), ("weak", 0.2), ("ok", 0.1)], "run_name string, mean_rank_ic double")
    got = {r["run_name"]: (r["stability_reason"], r["val_min_regime_rank_ic"]) for r in experiments.stability(runs, yearly, regimes).collect()}
    assert got == {"bad": ("unstable_yearly_rank_ic", None), "weak": ("unstable_regime_rank_ic", -0.5), "ok": ("pass", 0.1)}


def test_graph_ablation_holds_every_supervised_variant(spark):
    rows = [(f"r{i}", "t", "ridge", v, 0.1, 1.0, True) for i, v in enumerate(("supervised_graph", "supervised_graph_sector", "supervised_graph_random", "tabular"))]
    df = spark.createDataFrame(rows, "run_name string, target_col string, model string, feature_variant string, mean_rank_ic double, m double, stable boolean")
    got = {}
    for r in experiments.ensemble_members(df, "m").collect():
        got.setdefault(r["ensemble"], set()).add(r["run_name"])
    assert got["ensemble_graph_ablation_tree"] == {"r0", "r1", "r2"}
    assert "ensemble_supervised_graph_tree" not in got                      # one member is no ensemble


def test_leaf_limits_are_for_the_leafwise_model(spark):
    row = (100.0, 0.05, 4.0, 31.0, 50.0, 0.8, 0.8, 1.0)
    df = spark.createDataFrame([("lightgbm", *row), ("xgboost", *row)], "model string, n_estimators double, learning_rate double, max_depth double, "
                               "num_leaves double, min_child double, subsample double, colsample double, reg_lambda double")
    got = {(r["model"], r["tag"]): r["num_leaves"] for r in experiments.refine(df).collect()}
    assert got == {("lightgbm", "refine_lower_lr"): 31.0, ("lightgbm", "refine_more_regularized"): 15.0, ("lightgbm", "refine_more_capacity"): 49.0,
                   ("xgboost", "refine_lower_lr"): None, ("xgboost", "refine_more_regularized"): None, ("xgboost", "refine_more_capacity"): None}


def test_newest_artifact(spark):
    df = spark.createDataFrame([("t", "a", 1), ("t", "b", 3), ("t", "c", 2)], "target string, path string, modified int")
    assert experiments.newest_artifact(df, ["target"]).first()["path"] == "b"


def test_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        experiments.join_unique(left, left.unionByName(left).withColumn("v", F.lit(1)), ["k"])


def test_sector_neutral_backtest_is_balanced(panel):
    bt = evaluate.backtest(panel, KEYS, "x", "ret", share=0.1, every=1, cost_bps=5, min_names=12,
                           sector_neutral=True).toPandas()
    assert len(bt) == 16                                   # the short date is skipped in both runs
    np.testing.assert_allclose(bt["gross_exposure"], 1.0)
    np.testing.assert_allclose(bt["net_exposure"], 0.0, atol=1e-12)
    first = bt.sort_values("date").groupby("run").first()
    np.testing.assert_allclose(first["turnover"], 0.5)


def test_spread_matches_a_sort(panel):
    got = evaluate.decile_spread(panel, KEYS, "x", "ret", 0.1, 10).toPandas().set_index(["run", "date"])
    for key, g in panel.toPandas().groupby(["run", "date"]):
        if len(g) < 10:
            assert key not in got.index
            continue
        g, k = g.sort_values(["x", "symbol"]), max(1, int(len(g) * 0.1))
        assert got.loc[key, "n"] == len(g) and got.loc[key, "bucket_size"] == k
        np.testing.assert_allclose([got.loc[key, "bottom_mean"], got.loc[key, "top_mean"]], [g["ret"][:k].mean(), g["ret"][-k:].mean()])
