import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.functions.text import agreed_horizon
from crosstide.operators import splits

TARGET, RETURN = "target_excess_sector_fwd_5d", "target_ret_fwd_5d"
TRAIN, VAL = "2020-12-31", "2021-01-15"


@pytest.fixture(scope="module")
def labelled(spark):
    rows, i = [], 0
    for s in ("AAA", "BBB", "CCC"):
        for d in pd.bdate_range("2020-12-01", "2021-01-29"):
            rows.append((s, d.date(), float(i), i / 10))
            i += 1
    df = spark.createDataFrame(rows, f"symbol string, date date, {RETURN} double, {TARGET} double")
    return splits.attach_labels(df, TARGET, RETURN, agreed_horizon(TARGET, RETURN), 1)


def audit(labelled, **kw):
    kept = splits.purged_splits(labelled, TRAIN, VAL, 2, **kw)
    rows = splits.split_audit(splits.assign_split(labelled, TRAIN, VAL), kept).collect()
    return {r["split"]: r for r in rows}


def test_golden_case(labelled):
    got = audit(labelled)
    assert {s: r["raw_rows"] for s, r in got.items()} == {"train": 69, "val": 33, "test": 12}
    assert {s: r["dropped_rows"] for s, r in got.items()} == {"train": 18, "val": 24, "test": 12}
    assert got["train"]["label_end_max"] == dt.date(2020, 12, 31) and got["val"]["label_end_max"] == dt.date(2021, 1, 15)
    assert got["train"]["kept_rows"] == 51 and got["train"]["dates"] == 17


def test_golden_case_with_explicit_data_end(labelled):
    assert audit(labelled, data_end="2021-01-21")["test"]["dropped_rows"] == 12
    assert audit(labelled, data_end="2021-01-29")["test"]["dropped_rows"] == 6


def test_embargo_longer_than_the_split_leaves_it_empty(labelled):
    kept = splits.purged_splits(labelled, TRAIN, VAL, 50)
    assert {r["split"] for r in kept.select("split").distinct().collect()} == {"train"}


def test_horizons_must_agree():
    with pytest.raises(ValueError):
        agreed_horizon("target_ret_fwd_5d", "target_ret_fwd_10d")
    with pytest.raises(ValueError):
        agreed_horizon("target_ret")


def test_yearly_folds_stop_at_the_holdout():
    folds = splits.yearly_folds("2012-12-31", "2016-01-01")
    assert [(str(a), str(b)) for _, a, b in folds] == [
        ("2012-12-31", "2013-12-31"), ("2013-12-31", "2014-12-31"), ("2014-12-31", "2015-12-31")]


def test_date_choices(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d), s) for d in range(1, 11) for s in range(d)], "date date, symbol int")
    dates = splits.date_counts(df)
    assert [r["date"].day for r in splits.budget_dates(dates, 6).orderBy("date").collect()] == [1, 2, 3]
    assert splits.budget_dates(dates, 0, seed=1).count() == 1
    assert [r["date"].day for r in splits.stride_dates(dates, 3, 2).orderBy("date").collect()] == [1, 4]
    assert splits.shard_dates(dates, 4).where(F.col("shard") == 3).count() == 2


def test_early_stop_falls_back_to_the_last_fifth(spark):
    def flags(n):
        df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(n)], "date date")
        rows = splits.early_stop_dates(df).orderBy("date").collect()
        return [r["in_train"] for r in rows], [r["in_val"] for r in rows]
    train, val = flags(10)
    assert train == [True] * 8 + [False] * 2 and val == [False] * 8 + [True] * 2
    assert flags(3) == ([True] * 3, [True] * 3)


def test_calendar_embargo_counts_positions(labelled):
    kept = splits.calendar_embargo(labelled, labelled, TRAIN, VAL, 2)
    first = kept.where(F.col("split") == "val").agg(F.min("date")).first()[0]
    assert first == dt.date(2021, 1, 5)
