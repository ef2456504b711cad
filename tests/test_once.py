"""Work that is done once: on shared expressions, inputs and equal rows."""

import datetime as dt
import statistics

import numpy as np
from pyspark.sql import functions as F

from chronopanel import ordered
from chronopanel.operators import features, fill, impute


def counted(spark, df):
    """The same rows, and how many of them were read."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    return df.mapInPandas(through, df.schema), read


def test_gaps_are_worked_out_once(spark):
    """The sorted gaps of a run occur once in the plan, and even runs are told from others."""
    runs = [(["2000-01-31", "2000-02-29", "2000-03-31"], True), (["2000-01-31", "2000-02-29", "2000-06-30"], False), (["2000-01-31"], True)]
    df = spark.createDataFrame(runs, "d ARRAY<STRING>, want BOOLEAN").select(F.col("d").cast("array<date>").alias("d"), "want")
    got = df.select("want", features.consecutive_dates(F.col("d")).alias("even"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_sort") <= 1
    again = spark.range(3).select(features.consecutive_dates(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.date_add(F.lit("2000-01-01"), (i * 31 + F.col("id").cast("int"))))).alias("even"))
    assert again._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1
    assert all(r["want"] == r["even"] for r in got.collect())


def test_quantiles_read_their_input_once(spark):
    """Groups cut into blocks have exact quantiles, ties, single rows and missing values included."""
    values = {"a": [float(i * 37 % 1009) for i in range(1000)], "b": [5.0] * 700 + [float(i) for i in range(300)], "c": [3.0], "d": [float(i) for i in range(100)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    df, read = counted(spark, spark.createDataFrame(rows, "g STRING, v DOUBLE"))
    wanted = {"lo": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "hi": 1.0}
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", wanted, block_rows=20).collect()}
    assert read.value == len(rows)
    assert set(got) == set(values)
    for g, vs in values.items():
        assert np.allclose([got[g][n] for n in wanted], np.quantile(vs, list(wanted.values())))
    whole = ordered.exact_quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), [], "v", wanted, block_rows=20).first()
    assert np.allclose([whole[n] for n in wanted], np.quantile([v for _, v in rows if v is not None], list(wanted.values())))


def test_median_backfill_reads_its_input_once(spark):
    days = [dt.date(2000, m, 1) for m in range(1, 7)]
    rows = [(c, d, None if c == "A" and d.month < 4 else float(j * 10 + d.month)) for j, c in enumerate("ABCD") for d in days]
    df, read = counted(spark, spark.createDataFrame(rows, "Country STRING, Date DATE, v DOUBLE"))
    done = {(r["Country"], r["Date"].month): r["v"] for r in fill.backfill(df, "median").collect()}
    assert read.value == len(rows)
    assert all(done["A", m] == statistics.median([10.0 + m, 20.0 + m, 30.0 + m]) for m in (1, 2, 3))


def test_equal_rows_ask_once(spark, monkeypatch):
    """Rows alike on a date share a search, and each leaves out itself alone."""
    days = [dt.date(2000, m, 1) for m in range(1, 5)]
    rows = [(f"C{c:02d}", d, None if (c + d.month) % 3 == 0 else float(c * 10 + d.month), float(c % 2)) for c in range(20) for d in days]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, v DOUBLE, f DOUBLE")
    asked, search = [], impute.search

    def watched(queries, *rest):
        asked.append(queries.count())
        return search(queries, *rest)

    monkeypatch.setattr(impute, "search", watched)
    done = {(r["Country"], r["Date"]): r["v"] for r in impute.knn_impute(df, ["v"], k=3, metric="manhattan").collect()}
    assert asked == [8]  # four dates, two values
    assert len(done) == len(rows)
    for c, d, v, f in rows:
        if v is None:
            scaled = [(abs(g - f), o, e, w) for o, e, w, g in rows if e <= d and (o, e) != (c, d)]
            q75, q25 = np.quantile([g for o, e, _, g in rows if e <= d and (o, e) != (c, d)], [0.75, 0.25])
            spread = (q75 - q25) or 1.0
            best = sorted((g / spread, o, e, -1.0 if w is None else w) for g, o, e, w in scaled)[:3]
            known = [(w, 1 / (g + 1e-8)) for g, _, _, w in best if w >= 0]
            want = sum(w * x for w, x in known) / sum(x for _, x in known) if known else None
            assert (done[c, d] is None) == (want is None) and (want is None or abs(done[c, d] - want) < 1e-6)
        else:
            assert done[c, d] == v
