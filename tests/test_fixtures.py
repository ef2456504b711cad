"""Hand-checkable inputs with known answers."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import aggregate, classify, joins, labels, select
from chronopanel.schema import PanelError, validate_panel
from chronopanel.sources import readers

D = dt.date


def days(start, n, step=1):
    return [D.fromisoformat(start) + dt.timedelta(days=i * step) for i in range(n)]


def frame(spark, dates):
    return spark.createDataFrame([(d,) for d in dates], "Date DATE")


def month_ends(start, n, freq="ME"):
    return [t.date() for t in pd.date_range(start, periods=n, freq=freq)]


def test_crisis_labels(spark, tmp_path):
    rows = [("USA", y, int(y in (2007, 2008)), 0, 0) for y in range(2005, 2011)]
    path = str(tmp_path / "crises")
    spark.createDataFrame(rows, "Country STRING, Year INT, Banking_crisis INT, Currency_crisis INT, Debt_Crises INT").write.csv(path, header=True)
    marked = readers.read_crises(spark, path)
    assert labels.crisis_columns(marked.drop("is_crisis")) == ["Banking_crisis", "Currency_crisis", "Debt_Crises"]
    want = {("USA", 2005), ("USA", 2006)}
    assert {tuple(r) for r in labels.create_labels(marked, 2, 0).collect()} == want
    assert {tuple(r) for r in labels.create_labels(marked, 2, 2).collect()} == want
    dropped = labels.label_lookback(marked, 2, 2).where("drop").select("Year").collect()
    assert sorted(r[0] for r in dropped) == [2008, 2009, 2010]


def test_classification(spark):
    rules = classify.Rules(
        patterns={1: ["consumption"], 2: ["interest rate"], 3: ["exchange rate"], 4: ["employment"], 5: ["wage"], 6: ["government"]},
        names={1: "Consumption", -1: "Others"},
    )
    names = ["Household Consumption", "Key interest rate", "Real exchange rate", "Employment", "Hourly wages", "Government debt", "Rainfall"]
    df = spark.createDataFrame([(i, n, None, "") for i, n in enumerate(names)], "id INT, name STRING, note STRING, topics STRING")
    assert [r[0] for r in classify.classify(df, rules).orderBy("id").select("bucket").collect()] == [1, 2, 3, 4, 5, 6, -1]
    more = classify.add_rules(rules, 7, ["rain"], name="Weather")
    last = classify.classify(df, more).orderBy(F.col("id").desc()).first()
    assert (last["bucket"], last["bucket_name"]) == (7, "Weather")


def test_default_rules_order(spark):
    cases = [
        ("GDP growth (annual %)", "", "", 1),
        ("Rural population", "gdp", "", -1),
        ("Gross enrolment", "", "Health, Trade", -1),
        ("Something else", "", "Trade", 5),
        ("Government expenditure", "", "", 2),
        ("Deposit interest rate", "", "", 4),
        ("Nothing known", "", "Unknown topic", -1),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id INT, name STRING, note STRING, topics STRING, want INT")
    assert classify.classify(df).where("bucket <> want").count() == 0


@pytest.mark.parametrize(
    "dates, want",
    [
        (days("2023-01-01", 10), "D"),
        (month_ends("2023-01-31", 10), "M"),
        (month_ends("2023-03-31", 10, "QE"), "Q"),
        (month_ends("2023-12-31", 10, "YE"), "Y"),
        (days("2023-01-01", 1), "Unknown"),
        ([D(2023, 1, 1), D(2023, 2, 1), D(2023, 3, 15)], "Unknown"),
        ([d for i, d in enumerate(days("2023-01-01", 10)) if i not in (3, 6)], "D"),
    ],
)
def test_frequency(spark, dates, want):
    df = frame(spark, dates).withColumn("Country", F.lit("A"))
    assert aggregate.series_frequency(df).first()["frequency"] == want


def timeline(spark, a, b=None):
    return sorted(r[0] for r in joins.join_timelines(spark, frame(spark, a), None if b is None else frame(spark, b)).collect())


def test_timelines(spark):
    assert len(timeline(spark, days("2023-01-01", 10), days("2023-01-03", 10))) == 12
    ends = timeline(spark, month_ends("2023-01-31", 3), month_ends("2023-02-28", 3))
    assert ends == month_ends("2023-01-31", 4)
    assert timeline(spark, [], []) == []
    assert len(timeline(spark, days("2023-01-01", 5), [])) == 5
    assert timeline(spark, days("2023-01-01", 40), month_ends("2023-01-31", 3)) == days("2023-01-01", 90)
    for freq in ("MS", "QS", "YS"):
        starts = month_ends("2020-01-01", 4, freq)
        assert timeline(spark, starts, starts) == starts
    november = month_ends("2020-11-01", 4, "QS-NOV")
    assert timeline(spark, november) == november


def merge_frames(spark):
    one = [(d, i, c) for i, (d, c) in enumerate(zip(days("2023-01-01", 5), "AABAA"))]
    two = [(d, i + 5, c) for i, (d, c) in enumerate(zip(days("2023-01-03", 5), "BBBAA"))]
    three = [(d, i + 10) for i, d in enumerate(days("2023-01-04", 5))]
    return (
        spark.createDataFrame(one, "Date DATE, Col1 INT, Country STRING"),
        spark.createDataFrame(two, "Date DATE, Col2 INT, Country STRING"),
        spark.createDataFrame(three, "Date DATE, Col3 INT"),
    )


def nulls(df, columns):
    return [df.where(F.col(c).isNull()).count() for c in columns]


def test_merge_keyed(spark):
    merged = joins.merge_timeseries(list(merge_frames(spark)))
    assert merged.count() == 16
    assert nulls(merged, ["Col1", "Col2", "Col3"]) == [11, 11, 6]


def test_merge_unkeyed(spark):
    merged = joins.merge_timeseries(list(merge_frames(spark)), on=None)
    assert merged.count() == 8
    assert sum(nulls(merged, ["Col1", "Col2", "Col3", "Country"])) == 12


def test_merge_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        joins.merge_timeseries([])
    with pytest.raises(ValueError):
        joins.merge_timeseries([spark.range(1)])


def test_validation(spark):
    good = spark.createDataFrame([("A", D(2020, 1, 1), 1.0)] * 2, "Country STRING, Date DATE, x DOUBLE")
    assert validate_panel(good) is good
    for kwargs in ({"required": ["y"]}, {"min_rows": 3}, {"check_keys": True}):
        with pytest.raises(PanelError):
            validate_panel(good, **kwargs)
    with pytest.raises(PanelError):
        validate_panel(good.drop("x"))


def test_read_panel_coerces_dates(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("A", "2020-01-31", 1.0), ("A", "not a date", float("nan"))], "Country STRING, Date STRING, x DOUBLE").write.parquet(path)
    rows = readers.read_panel(spark, path).orderBy(F.col("Date").asc_nulls_last()).collect()
    assert [(r["Date"], r["x"]) for r in rows] == [(D(2020, 1, 31), 1.0), (None, None)]


def test_market_groups():
    assert len(select.DEVELOPED_MARKETS) == 17
    assert len(set(select.EMERGING_MARKETS)) == 74
    assert not set(select.DEVELOPED_MARKETS) & set(select.EMERGING_MARKETS)


def test_grid_places_only_period_ends(spark):
    rows = [
        ("A", D(2020, 2, 29), 1.0),
        ("A", D(2020, 4, 10), 2.0),  # not a month end: its month is on the grid, its value is not
        ("A", D(2020, 4, 20), 3.0),
        ("B", D(2020, 1, 31), 4.0),
        ("B", D(2020, 5, 3), 5.0),
        ("B", D(2020, 5, 31), 6.0),
        ("C", D(2020, 3, 1), 7.0),
    ]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, x DOUBLE")
    got = {(r["Country"], r["Date"]): r["x"] for r in aggregate.complete_grid(df, "M").collect()}
    ends = month_ends("2020-01-31", 5)
    want = {(c, d): None for c in "ABC" for d in ends}
    want |= {("A", D(2020, 2, 29)): 1.0, ("B", D(2020, 1, 31)): 4.0, ("B", D(2020, 5, 31)): 6.0}
    assert got == want
