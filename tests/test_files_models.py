import datetime as dt
import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide import session
from crosstide.functions import text
from crosstide.operators import models, xsection
from crosstide.sources import files, tables


def test_csv_scans(spark, tmp_path):
    (tmp_path / "b.csv").write_text("date,symbol,open,high,low,close,volume,extra\n2020-01-02, aa ,1,2,0.5,1.5,10,x\n2020-01-03,BB,1,2,1,NaN,,y\n")
    df = files.read_bars_csv(spark, str(tmp_path / "b.csv"))
    rows = {r["symbol"]: r for r in df.collect()}
    assert set(rows) == {"AA", "BB"} and rows["BB"]["close"] is None and rows["BB"]["volume"] is None
    assert rows["AA"]["date"] == dt.date(2020, 1, 2) and "extra" not in df.columns
    (tmp_path / "c.csv").write_text("symbol,company,sector,sub_industry,headquarters,founded,date_added\n"
                                    "aa,Alpha,Tech,,\"Austin, Texas\",1998 (1911),1999-13-40\n")
    row = files.read_companies_csv(spark, str(tmp_path / "c.csv")).first()
    assert row["sub_industry"] == "Unknown" and row["date_added"] is None


def test_headquarters_and_years(spark):
    df = spark.createDataFrame([("Austin, Texas",), ("Toronto, Canada",), ("Solo",), ("",), (None,)], "h string")
    got = [tuple(r) for r in df.select(*text.headquarters_parts("h").values()).collect()]
    assert got == [("Austin", "Texas", "South"), ("Toronto", "Canada", "Non-US"), ("Solo", "Unknown", "Unknown"),
                   ("Unknown",) * 3, ("Unknown",) * 3]
    years = spark.createDataFrame([("1998 (1911)",), ("none",)], "f string")
    assert [tuple(r) for r in years.select(text.first_year("f"), text.earliest_year("f")).collect()] == [(1998, 1911), (None, None)]


def test_groups_catalogue_and_load(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, d), "A", "s", 1.5, 2.5, 7) for d in (1, 2, 3)],
                               "date date, symbol string, sector string, ret_1d double, target_ret_fwd_1d double, n long")
    base = str(tmp_path / "g")
    files.write_group(df, f"{base}/price", ["ret_1d", "n"])
    files.write_group(df, f"{base}/targets", ["target_ret_fwd_1d"])
    found = [(r["file"], r["column"]) for r in files.catalogue(spark, base).collect()]
    assert sorted(found) == [("price", "n"), ("price", "ret_1d")]
    assert dict(spark.read.parquet(f"{base}/price").dtypes)["ret_1d"] == "float"
    assert files.select_features(found, core=["ret_1d", "absent"]) == ["ret_1d"]
    panel = files.load_features(spark, base, ["target_ret_fwd_1d"], {"price": ["ret_1d"]}, start="2020-01-02")
    assert panel.count() == 2
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan


def test_lookback_filter(spark):
    cat = spark.createDataFrame([("f", c) for c in ("ret_20d", "mom_252d_skip_21d", "vol_ratio_20_60", "macd_line")],
                                "file string, column string")
    got = {r["column"]: r["in_window"] for r in files.with_lookback(cat, 60).collect()}
    assert got == {"ret_20d": True, "mom_252d_skip_21d": False, "vol_ratio_20_60": True, "macd_line": True}


def test_manifest_keeps_the_first(spark):
    out = files.manifest(spark, [("a", "x", "1"), ("b", "x", "2"), ("a", "y", "3")])
    assert sorted((r["feature"], r["category"]) for r in out.collect()) == [("a", "x"), ("b", "x")]


def test_run_artifacts(spark, tmp_path):
    for run, ir in (("r1", 1.5), ("r2", float("nan"))):
        d = tmp_path / run
        d.mkdir()
        d.joinpath("config.json").write_text(json.dumps({"model": "ridge", "target_col": "target_ret_fwd_5d"}))
        d.joinpath("metrics.json").write_text(json.dumps({"model_score": {"val": {"rank_ic_ir": ir, "rows": 7}}}))
        d.joinpath("walk_forward_metrics.json").write_text(json.dumps(
            {"run_name": run, "model": "ridge", "target_col": "target_rank_fwd_20d", "n_folds": 7,
             "fold_aggregate": {"mean_rank_ic_ir": 0.5}, "holdout": {"rank_ic_ir": 0.25, "suspect_overfit_or_leak": False}}))
    rows = {r["run_name"]: r for r in files.run_table(spark, str(tmp_path), ["model"], ["rank_ic_ir", "rows"]).collect()}
    assert rows["r1"]["rank_ic_ir"] == 1.5 and rows["r2"]["rank_ic_ir"] is None and rows["r2"]["rows"] == 7
    wf = files.read_walk_forward(spark, str(tmp_path)).orderBy("run_name").first()
    assert (wf["target_family"], wf["horizon"], wf["val_mean_icir"], wf["holdout_suspect"]) == ("rank", 20, 0.5, False)
    assert files.file_listing(spark, f"{tmp_path}/*/metrics.json").count() == 2


def test_shards_keep_the_last(spark, tmp_path):
    for version, v in ((1, 1.0), (2, 9.0)):
        spark.createDataFrame([("A", v, version)], "symbol string, v double, version int").write.parquet(f"{tmp_path}/s{version}")
    assert files.merge_shards(spark, f"{tmp_path}/s*", ["symbol"], ["version"]).first()["v"] == 9.0


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = x @ [0.5, -1.0, 0.0] + rng.normal(size=80) + 2
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    ready = models.scaled(df, df, ["a", "b", "c"])
    model = models.fit_ridge(ready, ["a", "b", "c"], "y", 10.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), want, atol=1e-9)
    assert model.intercept == pytest.approx(y.mean())
    ranked = [r["feature"] for r in models.importance(model, ["a", "b", "c"], spark).collect()]
    assert ranked[0] == "b"


def test_every_fold_and_run_from_one_pass(spark):
    rng = np.random.default_rng(1)
    n = 400
    day = rng.integers(0, 300, n)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.01] + [0, 1e6, 3]
    x[rng.random((n, 3)) < 0.1] = np.nan
    y, z = rng.normal(size=n), rng.normal(size=n)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=int(d)), start + dt.timedelta(days=int(d) + 5), *[None if np.isnan(v) else float(v) for v in r], float(a), float(b))
            for d, r, a, b in zip(day, x, y, z)]
    df = spark.createDataFrame(rows, "date date, label_end_date date, a double, b double, c double, y double, z double").withColumn("k", F.lit(7.0))
    folds = [("late", dt.date(2020, 9, 1), None), ("early", dt.date(2020, 4, 1), None), ("none", dt.date(2019, 1, 1), None)]
    fits = models.ridge_folds(df, ["a", "b", "c", "k"], folds, {"r1": ("y", 10.0), "r2": ("z", 0.5)})
    assert fits["none"] == {}
    for name, end, _ in folds[:2]:
        train = np.array([start + dt.timedelta(days=int(d) + 5) <= end for d in day])
        t = np.where(np.isnan(x[train]), np.nanmedian(x[train], axis=0), x[train])
        s = np.column_stack([(t - t.mean(0)) / t.std(0), np.zeros(train.sum())])
        for run, label, alpha in (("r1", y, 10.0), ("r2", z, 0.5)):
            want = np.linalg.solve(s.T @ s + alpha * np.eye(4), s.T @ (label[train] - label[train].mean()))
            m = fits[name][run]
            np.testing.assert_allclose(m.coefficients, want, atol=1e-8)
            assert m.intercept == pytest.approx(label[train].mean())
            got = [r.s for r in df.select(m.score().alias("s")).collect()]
            whole = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
            np.testing.assert_allclose(got, (whole - t.mean(0)) / t.std(0) @ want[:3] + m.intercept, atol=1e-7)


def test_scaler_uses_the_median_then_the_filled_moments(spark):
    df = spark.createDataFrame([("f", v) for v in (1.0, 2.0, 10.0, None)], "fit string, x double")
    row = xsection.scaler_table(df, ["x"], ["fit"]).first()
    filled = np.array([1, 2, 10, 2.0])
    assert row["_med_x"] == 2.0 and row["_mean_x"] == pytest.approx(filled.mean()) and row["_std_x"] == pytest.approx(filled.std())


def test_dedupe_last(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)], "k string, v int, x double")
    assert {r["k"]: r["x"] for r in tables.dedupe_last(df, ["k"], ["v"]).collect()} == {"A": 2.0, "B": 3.0}


def test_source_rules():
    """No unbounded shortcuts in the library: cross joins, local checkpoints, raw correlation, row UDFs."""
    banned = [r"\.join\([^\n]*F\.lit\(True\)\)", r"\.crossJoin\(", r"localCheckpoint", r"F\.corr\(", r"@F\.udf", r"\.toPandas\(", r"\.rdd\b"]
    for path in Path(__file__).resolve().parents[1].joinpath("crosstide").rglob("*.py"):
        body = path.read_text()
        for pattern in banned:
            assert not re.search(pattern, body), f"{pattern} in {path}"


def test_scope_rules(spark):
    df = spark.createDataFrame([(s, dt.date(2020, 1, d)) for s, n in (("A", 3), ("B", 1), ("C", 3)) for d in range(1, n + 1)],
                               "symbol string, date date")
    kept = tables.scope(df, min_history=2, max_symbols=1)
    assert {r["symbol"] for r in kept.collect()} == {"A"}
    assert tables.scope(df, start="2020-01-02").agg(F.count("*")).first()[0] == 4


def test_shared_tables_follow_their_folder_and_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})
    monkeypatch.setattr(session, "_SHARED", {})
    folder = f"{tmp_path}/in"
    build = lambda: spark.read.parquet(f"{folder}/t.parquet").groupBy("k").count()
    spark.range(10).withColumn("k", F.col("id") % 2).write.parquet(f"{folder}/t.parquet")
    first = session.shared(spark, "t", folder, build)
    assert session.shared(spark, "t", folder, build) is first
    spark.range(5).withColumn("k", F.lit(7).cast("long")).write.mode("append").parquet(f"{folder}/t.parquet")
    again = session.shared(spark, "t", folder, build)
    assert (first.count(), again.count()) == (2, 3)
    paths = [Path(p.removeprefix("file:")) for p in next(iter(session._WRITTEN.values()))]
    assert len(paths) == 2 and all(p.exists() for p in paths)
    session.clear(spark)
    assert not any(p.exists() for p in paths) and session._SHARED == {}
