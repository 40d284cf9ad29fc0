"""The design is written once, and the universe follows from a cut per date."""

import datetime as dt

from pyspark.sql import functions as F

from crosstide import session
from crosstide.operators import models, xsection


def rows(spark):
    data = [(dt.date(2020, 1, 1 + t), s, None if s == 3 else float(s // 2), float(s * t)) for t in range(3) for s in range(20)]
    return spark.createDataFrame(data, "date date, symbol long, liq double, f double")


def test_universe_drops_the_least_liquid_ties_by_symbol(spark):
    for share in (0.0, 0.01, 0.1, 0.5):
        want = sorted(s for place, s in enumerate([s for s in range(20) if s != 3], 1) if place / 19 > share) if share else list(range(20))
        got = xsection.liquidity_universe(rows(spark), "liq", share).where(F.col("date") == "2020-01-02").collect()
        assert sorted(r.symbol for r in got) == want


def test_design_is_staged_once(spark):
    df = rows(spark)
    with session.noted() as paths:
        out = models.prepare_design(df, ["f"], liquidity="liq", drop_share=0.1, winsor_share=0.01)
    wide = [p for p in paths if {"symbol", "f"} <= set(spark.read.parquet(p).columns)]
    assert len(wide) == 1
    assert out.count() == xsection.liquidity_universe(df, "liq", 0.1).count()
