import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from crosstide.operators import ranking, rollup, xsection


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them, ties and NULLs."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        g = "hot" if i % 10 else "cold"
        x = None if i % 17 == 0 else (0.0 if i % 3 == 0 else float(np.round(rng.normal(), 2)))
        rows.append((g, i, x))
    return spark.createDataFrame(rows, "g string, id long, x double")


def by_id(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def test_ranks_match_pandas_under_skew(skewed):
    got = by_id(ranking.with_ranks(skewed, ["g"], {"q": "x"}))
    want = got.groupby("g")["x"].rank(pct=True)
    np.testing.assert_allclose(got["q"], want, equal_nan=True)


def test_ties_need_no_shuffle_besides_the_sort(skewed):
    code = skewed.withColumns({"_known": F.col("x").isNotNull(), "_code": ranking.order_code(F.col("x"))})
    rows = ranking._sorted(code, ["g", "_known", "_code"], [])
    run = Window.partitionBy("g", "_known", "_code")
    plan = rows.withColumn("_first", F.min("_at").over(run))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1 and plan.count("Sort [") == 1


def test_hot_values_are_dealt_to_sub_runs(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLE", 1.1)
    monkeypatch.setattr(ranking, "HOT", 20)
    nulls = skewed.withColumn("h", F.when(F.col("id") % 7 > 0, F.col("g")))
    hot = ranking._hot_values(nulls.withColumn("_code", ranking.order_code(F.col("x"))), ["h"])
    assert 2 <= hot.count() < 10
    got = by_id(ranking.rank_parts(nulls, ["h"], "x", "r"))
    x = got.groupby("h", dropna=False)["x"]
    np.testing.assert_allclose(got["r_below"], x.rank(method="min") - 1, equal_nan=True)
    np.testing.assert_allclose(got["r_ties"], x.rank(method="max") - x.rank(method="min") + 1, equal_nan=True)
    np.testing.assert_allclose(got["r_n"].dropna(), x.transform("count")[got["x"].notna()])


@pytest.mark.parametrize("desc", [False, True])
def test_positions_are_a_total_order(skewed, desc):
    got = by_id(ranking.with_position(skewed, ["g"], "x", "id", "p", descending=desc))
    for _, part in got.dropna(subset=["x"]).groupby("g"):
        order = part.sort_values(["x", "id"], ascending=[not desc, True])
        assert order["p"].tolist() == list(range(1, len(part) + 1))
    assert got[got["x"].isna()]["p"].isna().all()


def test_quantiles_match_numpy(skewed):
    probs = [0.01, 0.5, 0.99]
    out = ranking.quantile_table(skewed, ["g"], ["x"], probs).toPandas().set_index("g")
    for g, part in skewed.toPandas().dropna().groupby("g"):
        np.testing.assert_allclose(out.loc[g, ["x_q0", "x_q1", "x_q2"]].astype(float), np.quantile(part["x"], probs), rtol=1e-12)


@pytest.mark.parametrize("kind", ["text", "prefix", "long prefix", "date", "timestamp", "boolean", "umlaut"])
def test_other_types_rank_like_a_sort(spark, kind):
    rng = np.random.default_rng(4)
    n = [int(i) for i in rng.integers(0, 300, 400)]
    start = dt.datetime(2020, 1, 1)
    value = {"text": lambda i: str(i), "prefix": lambda i: f"Supplier#{i:09d}", "long prefix": lambda i: "user-" * 30 + str(i),
             "date": lambda i: start.date() + dt.timedelta(days=i), "timestamp": lambda i: start + dt.timedelta(microseconds=i * 37),
             "boolean": lambda i: i % 2 == 0, "umlaut": lambda i: "äé"[i % 2] + chr(200 + i)}[kind]
    rows = [("a" if i % 5 else "b", i, value(v)) for i, v in enumerate(n)]
    df = spark.createDataFrame(rows, f"g string, id long, x {({'date': 'date', 'timestamp': 'timestamp', 'boolean': 'boolean'}).get(kind, 'string')}")
    got = by_id(ranking.with_position(df, ["g"], "x", "id", "p"))
    for g in "ab":
        part = sorted((r[2].encode() if isinstance(r[2], str) else r[2], r[1]) for r in rows if r[0] == g)
        place = dict(zip(got["id"], got["p"]))
        assert [place[i] for _, i in part] == list(range(1, len(part) + 1))
    ranked = by_id(ranking.rank_parts(df, [], "x", "r"))
    order = sorted(r[2].encode() if isinstance(r[2], str) else r[2] for r in rows)
    for r, below, ties in zip(rows, ranked["r_below"], ranked["r_ties"]):
        v = r[2].encode() if isinstance(r[2], str) else r[2]
        assert (below, ties) == (order.index(v), order.count(v))


@pytest.mark.parametrize("kind", ["narrow", "epoch seconds", "numbered text", "heavy tail"])
def test_one_group_is_cut_evenly_whatever_its_values(spark, kind):
    rng = np.random.default_rng(6)
    n = 8000
    x = {"narrow": 100 + 4 * rng.random(n), "epoch seconds": 1.6e9 + np.round(rng.random(n) * 6e6), "heavy tail": np.exp(9 * rng.normal(size=n)),
         "numbered text": [f"Supplier#{i:09d}" for i in rng.integers(0, 5000, n)]}[kind]
    pdf = pd.DataFrame({"g": 1, "id": np.arange(n), "x": x})
    df = spark.createDataFrame(pdf)
    parts = ranking._sorted(df, ["g"], [F.col("x")]).groupBy(F.shiftright("_at", ranking.PART_BITS)).count().collect()
    assert len(parts) == 1 or max(r["count"] for r in parts) < 2 * n / len(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranking._sorted(df, ["g"], [F.col("x")]).groupBy(F.shiftright("_at", ranking.PART_BITS)).count().collect()
        assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * n / 8
        got = by_id(ranking.with_ranks(df, ["g"], {"q": "x"}))
        at = by_id(ranking.with_position(df, ["g"], "x", "id", "p", descending=True))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    np.testing.assert_allclose(got["q"], pdf["x"].rank(pct=True))
    order = pdf.sort_values(["x", "id"], ascending=[False, True])["id"]
    assert at.set_index("p")["id"].sort_index().tolist() == order.tolist()


def test_order_code_is_the_order_of_doubles(spark):
    rng = np.random.default_rng(8)
    values = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, 2.0, 0.1]
    values += [v for e in range(-1074, 1024, 7) for v in (2.0 ** e, np.nextafter(2.0 ** e, 0), np.nextafter(2.0 ** e, np.inf))]
    values += rng.normal(size=500).tolist()
    values += [-v for v in values]
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "x double")
    codes = {}
    for r in df.select("x", ranking.order_code(F.col("x")).alias("c")).collect():
        if r.x is not None and r.x == r.x:
            bits = int(np.float64(abs(r.x)).view(np.int64))
            assert r.c == (bits if r.x >= 0 else -bits), r.x
        codes[str(r.x)] = r.c
    assert codes["None"] is None and codes["nan"] > codes["inf"] > codes["1.7976931348623157e+308"]


def test_pct_rank_literals(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 1.0, 1.0, None, 2.0, 3.0])], "g int, id int, x double")
    got = by_id(ranking.with_ranks(df, ["g"], {"q": "x"}))["q"]
    np.testing.assert_allclose(got, [.9, .3, .3, np.nan, .6, .9], equal_nan=True)


def test_winsorize_literal(spark):
    df = spark.createDataFrame([("2020-01-01", i, float(v)) for i, v in enumerate([1, 2, 4, 8, 16])], "date string, symbol int, x double")
    got = sorted(r["x"] for r in xsection.winsorize(df, ["x"], 0.01).collect())
    np.testing.assert_allclose([got[0], got[-1]], [1.04, 15.68])


def test_wide_and_long_ranks_agree(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"date": np.repeat(["a", "b"], 50), "symbol": np.tile(np.arange(50), 2),
                        **{f"x{i}": np.round(rng.normal(size=100), 1) for i in range(4)}})
    df = spark.createDataFrame(pdf)
    wide = ranking.with_ranks(df, ["date"], {f"cs_rank_x{i}": f"x{i}" for i in range(4)})
    long = xsection.pct_ranks(df, ["date"], [f"x{i}" for i in range(4)], "cs")
    cols = ["date", "symbol"] + [f"cs_rank_x{i}" for i in range(4)]
    order = ["date", "symbol"]
    pd.testing.assert_frame_equal(wide.select(*cols).toPandas().sort_values(order).reset_index(drop=True),
                                  long.select(*cols).toPandas().sort_values(order).reset_index(drop=True))


@pytest.mark.parametrize("limit", [0, 70, 10 ** 6])
def test_groups_of_any_size_rank_alike(skewed, monkeypatch, limit):
    monkeypatch.setattr(ranking, "GROUP_ROWS", limit)          # all sorted, both ways, all in memory
    got = by_id(ranking.with_ranks(skewed, ["g"], {"q": "x", "r": "id"}))
    for out, x in (("q", "x"), ("r", "id")):
        np.testing.assert_allclose(got[out], got.groupby("g")[x].rank(pct=True), equal_nan=True)
    dated = skewed.select(F.col("g").alias("date"), F.col("id").alias("symbol"), "x", (F.col("id") % 3).alias("y"),
                          F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("sector"))
    wide = xsection.scope_ranks(dated, {"cs": ["date"], "sec": ["date", "sector"]}, ["x", "y"])
    wide = wide.toPandas().sort_values("symbol").reset_index(drop=True)
    for c in ("x", "y"):
        np.testing.assert_allclose(wide[f"cs_rank_{c}"], wide.groupby("date")[c].rank(pct=True), equal_nan=True)
        np.testing.assert_allclose(wide[f"sec_rank_{c}"], wide.groupby(["date", "sector"])[c].rank(pct=True), equal_nan=True)


def test_ranks_of_groups_equal_ranks_of_their_members(spark):
    rows = [(d, s, f"g{s % 4}", None if s % 4 == 3 else float(s % 4 // 2)) for d in ("a", "b") for s in range(30)]
    df = spark.createDataFrame(rows, "date string, symbol int, grp string, x double")
    state = df.groupBy("date", "grp").agg(F.first("x").alias("v"))
    sizes = df.groupBy("date", "grp").agg(F.count(F.lit(1)).alias("_size"))
    out = df.join(rollup.member_ranks(state, sizes, "grp", {"q": "v"}), ["date", "grp"]).toPandas()
    np.testing.assert_allclose(out["q"], out.groupby("date")["x"].rank(pct=True), equal_nan=True)


def test_whole_table_as_one_group(skewed):
    got = by_id(ranking.rank_parts(skewed, [], "x", "r"))
    x = got["x"]
    np.testing.assert_allclose(got["r_below"], x.rank(method="min") - 1, equal_nan=True)
    np.testing.assert_allclose(got["r_n"].dropna(), x.notna().sum())


def test_universe_and_clipping(skewed):
    df = skewed.withColumnRenamed("g", "date")
    kept = xsection.liquidity_universe(df, "x", 0.2, tie="id").toPandas()
    want = df.toPandas()
    place = want.sort_values(["x", "id"]).groupby("date")["x"].rank(method="first", pct=True)
    assert sorted(kept["id"]) == sorted(want.loc[place[place > 0.2].index, "id"])
    clipped = by_id(xsection.winsorize(df, ["x"], 0.05))
    full = want.sort_values("id").reset_index(drop=True)
    lo, hi = (full.groupby("date")["x"].transform(lambda s: s.quantile(q)) for q in (0.05, 0.95))
    np.testing.assert_allclose(clipped["x"], full["x"].clip(lo, hi), equal_nan=True)
