"""Geographic splits: the best there is where few countries hold all rows, near-exact where many do."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import split


def shares(df):
    n = df.count()
    return {r["split"]: r["n"] / n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}


def table(spark, sizes):
    rows = spark.createDataFrame([(f"C{i:05d}", n) for i, n in enumerate(sizes)], "Country STRING, n INT")
    return rows.select("Country", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


@pytest.mark.parametrize("sizes", [[411, 223, 157, 109, 61, 39], [500, 300, 200], [997, 3], [350, 350, 120, 95, 50, 35], [7]])
def test_few_countries(spark, sizes):
    """The training share is the nearest that any set of countries has."""
    got = shares(split.split_geographic(table(spark, sizes), 0.7))
    total = sum(sizes)
    best = min(abs(sum(c) / total - 0.7) for k in range(len(sizes) + 1) for c in combinations(sizes, k))
    assert abs(got.get("train", 0) - 0.7) == pytest.approx(best, abs=1e-4)
    assert sum(got.values()) == pytest.approx(1) and None not in got


def test_large_and_many_small(spark, monkeypatch):
    monkeypatch.setattr(split, "LARGEST", 5)
    sizes = [4000, 2500, 1700, 900, 700, *[7 + i % 5 for i in range(300)]]
    df = split.split_geographic(table(spark, sizes), 0.6, 0.25)
    got = shares(df)
    assert got["train"] == pytest.approx(0.6, abs=0.002) and got["test"] == pytest.approx(0.25, abs=0.002)
    assert df.groupBy("Country").agg(F.count_distinct(F.coalesce("split", F.lit("none"))).alias("k")).agg(F.max("k")).first()[0] == 1
    again = split.split_geographic(table(spark, sizes).repartition(5), 0.6, 0.25)
    assert sorted(map(tuple, df.select("Country", "split").distinct().collect()), key=str) == sorted(map(tuple, again.select("Country", "split").distinct().collect()), key=str)


def test_no_rows(spark):
    assert split.split_geographic(table(spark, [1]).limit(0)).collect() == []
