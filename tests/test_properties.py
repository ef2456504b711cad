"""Rules every operator keeps: no look-ahead, disjoint sets, known cells untouched."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import aggregate, encode, features, fill, impute, joins, labels, models, neighbours, select, split, vectors
from chronopanel.plans.recipes import run_recipe
from chronopanel.schema import PanelError, to_long, to_wide
from chronopanel.sources import writers

DATES = [d.date() for d in pd.date_range("2015-01-31", periods=40, freq="ME")]
KEYS = ["Country", "Date"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in ("A", "B", "C", "D"):
        for i, d in enumerate(DATES):
            x = None if rng.random() < 0.2 else float(np.round(rng.normal(10, 3), 3))
            y = None if i < 4 or rng.random() < 0.1 else float(np.round(i + rng.normal(), 3))
            rows.append((c, d, x, y, float(np.round(rng.normal(5, 1), 3)), int(rng.random() < 0.25)))
    return spark.createDataFrame(rows, "Country STRING, Date DATE, x DOUBLE, y DOUBLE, z DOUBLE, label INT").cache()


CUT = DATES[25]


def table(df, *columns):
    names = list(columns) or df.columns
    return df.select(*[f"`{n}`" for n in names]).toPandas().sort_values(KEYS).reset_index(drop=True)


BACKWARD = {
    "slope": lambda d: features.slope(d, ["x", "z"]),
    "acceleration": lambda d: features.acceleration(d, ["z"]),
    "rolling": lambda d: features.rolling(d, ["x"], [3, 6], ["mean", "std", "median", "skew"]),
    "exceedance": lambda d: features.exceedance(d, ["z"], 6),
    "ewm": lambda d: features.ewm(d, ["x"]),
    "ewma": lambda d: features.ewma(d, ["x"]),
    "dist_mean": lambda d: features.dist_mean(d, ["x"]),
    "momentum": lambda d: features.momentum(d, ["x"]),
    "volatility": lambda d: features.volatility(d, ["x"]),
    "global": lambda d: features.global_average(d, ["x"]),
    "seasonal": lambda d: features.seasonal(d, ["z"], centered=False),
    "seasonal_ratio": lambda d: features.seasonal(d, ["z"], "multiplicative", centered=False),
    "forward_fill": lambda d: fill.forward_fill(d, 2, latest_only=False),
    "knn": lambda d: impute.knn_impute(d, ["x", "y"], 3, features=["x", "y", "z"]),
    "forecast": lambda d: impute.forecast_fill(d, ["x", "y"]),
    "regression": lambda d: impute.regression_impute(d.drop("label"), ["x"]),
}


@pytest.mark.parametrize("name", BACKWARD)
def test_no_look_ahead(panel, name):
    """Values up to a date do not change when later rows are cut off."""
    whole = table(BACKWARD[name](panel).where(F.col("Date") <= CUT))
    cut = table(BACKWARD[name](panel.where(F.col("Date") <= CUT)))
    pd.testing.assert_frame_equal(whole, cut, check_exact=False, rtol=1e-7, atol=1e-7)


FILLS = {
    "forward_fill": lambda d: fill.forward_fill(d),
    "zero_fill": lambda d: fill.zero_fill(d),
    "backfill_mean": lambda d: fill.backfill(d, "mean", ["x", "y"]),
    "backfill_mode": lambda d: fill.backfill(d, "mode", ["x", "y"]),
    "knn": lambda d: impute.knn_impute(d, ["x", "y"], 3),
    "forecast": lambda d: impute.forecast_fill(d, ["x", "y"]),
    "regression": lambda d: impute.regression_impute(d, ["x", "y"]),
}


@pytest.mark.parametrize("name", FILLS)
def test_fills_keep_known_cells(panel, name):
    before, after = table(panel), table(FILLS[name](panel), *panel.columns)
    for c in ("x", "y", "z"):
        known = before[c].notna()
        np.testing.assert_array_equal(before.loc[known, c], after.loc[known, c])
        assert after[c].isna().sum() <= before[c].isna().sum()


def test_splits(panel):
    for cut in (split.split_cutoff(panel, CUT), split.split_balanced(panel)):
        span = {r["split"]: r for r in cut.groupBy("split").agg(F.min("Date").alias("a"), F.max("Date").alias("b")).collect()}
        assert span["train"]["b"] < span["test"]["a"]
    with pytest.raises(PanelError):
        split.split_balanced(panel.withColumn("label", F.lit(0)))
    by_country = split.split_geographic(panel, 0.5)
    assert by_country.groupBy("Country").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert by_country.count() == panel.count()


def test_many_countries_split_near_their_target(spark):
    df = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id") % 20_000 % (1 + F.col("id") % 20_000)).alias("Country"), F.col("id"))
    out = split.split_geographic(df, 0.7, 0.2)
    shares = {r["split"]: r["count"] / 60_000 for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.001 and abs(shares["test"] - 0.2) < 0.001


def test_few_countries_split_as_near_as_an_order_allows(spark):
    rows = [(f"c{i}",) for i, n in enumerate([50, 30, 10, 5, 3, 2]) for _ in range(n)]
    out = split.split_geographic(spark.createDataFrame(rows, "Country STRING"), 0.8).groupBy("split").count().collect()
    assert abs({r["split"]: r["count"] for r in out}["train"] - 80) <= 5


def test_grid_ends_with_the_last_complete_period(spark):
    rows = [("A", dt.date(2020, 12, 31), 1.0), ("A", dt.date(2022, 8, 31), 2.0), ("B", dt.date(2022, 8, 31), 3.0)]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, x DOUBLE")
    got = sorted(map(str, aggregate.complete_grid(df, "Y").collect()))
    ends = [dt.date(2020, 12, 31), dt.date(2021, 12, 31)]
    assert len(got) == 4 and {(r["Country"], r["Date"], r["x"]) for r in aggregate.complete_grid(df, "Y").collect()} == {
        ("A", ends[0], 1.0), ("A", ends[1], None), ("B", ends[0], None), ("B", ends[1], None)
    }
    alone = aggregate.complete_grid(df.where("Country = 'A'").drop("Country"), "Y")
    assert alone.columns == ["Date", "x"] and {(r["Date"], r["x"]) for r in alone.collect()} == {(ends[0], 1.0), (ends[1], None)}


def test_forecast_fills_each_gap_from_its_past():
    nan = float("nan")
    x = np.array([nan, nan, 5, 5, 5, 5, 5, 5, nan, 7, 8, 9, 8, 7, 9, nan])
    y = impute._fill_series(x)
    assert np.isnan(y[:2]).all() and y[8] == 5 and not np.isnan(y[15]) and y[15] != 5
    assert np.isnan(impute._fill_series(np.array([1.0, nan, 2.0]))[1]) and np.isnan(impute._fill_series(np.array([nan, nan]))).all()


def test_one_hot_is_sparse(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c STRING")
    out, fitted = encode.one_hot(df, "c")
    assert [r["c_one_hot"].toArray().tolist() for r in out.collect()] == [[0, 1], [1, 0], [0, 0]]
    assert fitted.transform(spark.createDataFrame([("zz",)], "c STRING")).first()["c_one_hot"].toArray().tolist() == [0, 0]
    with pytest.raises(PanelError):
        encode.fit_categories(df, "c", limit=1)


def test_scalers_fit_on_train_only(panel):
    train = panel.where(F.col("Date") <= CUT)
    fitted = encode.fit_standard(train, ["z"])
    scaled = encode.scale(train, fitted).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    shifted = panel.withColumn("z", F.when(F.col("Date") > CUT, F.col("z") + 100).otherwise(F.col("z")))
    assert encode.fit_standard(shifted.where(F.col("Date") <= CUT), ["z"]) == fitted
    back = encode.unscale(encode.scale(panel, fitted), fitted)
    np.testing.assert_allclose(table(back)["z"], table(panel)["z"])


def test_constant_columns_scale_by_one(panel):
    flat = panel.withColumn("z", F.lit(3.0))
    for f in (encode.fit_standard, encode.fit_robust, encode.fit_minmax):
        assert f(flat, ["z"])["z"] == (3.0, 1.0)


def brute_knn(pdf, columns, feats, k, metric):
    out = pdf.copy()
    for i, row in pdf.iterrows():
        gaps = [c for c in columns if np.isnan(row[c])]
        have = [f for f in feats if not np.isnan(row[f])]
        if not gaps or not have:
            continue
        past = pdf[(pdf.Date <= row.Date) & (pdf.index != i)].dropna(subset=have)
        if past.empty:
            continue
        med = past[have].median()
        iqr = (past[have].quantile(0.75) - past[have].quantile(0.25)).replace(0, 1)
        delta = ((past[have] - row[have].astype(float)) / iqr).to_numpy(dtype=float)
        d = np.sqrt((delta**2).sum(1)) if metric == "euclidean" else np.abs(delta).sum(1)
        near = past.assign(d=d).sort_values(["d", "Country", "Date"]).head(k)
        for c in gaps:
            ok = near[near[c].notna()]
            if len(ok):
                w = 1 / (ok.d + 1e-8)
                out.loc[i, c] = (ok[c] * w).sum() / w.sum()
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_against_brute_force(panel, metric, monkeypatch):
    """Small blocks and batches, so that merging over many of them is exercised."""
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BATCH", 5)
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 7)
    monkeypatch.setattr(impute, "VALUES_PER_BLOCK", 20)
    got = table(impute.knn_impute(panel.drop("label"), ["x", "y"], 4, metric=metric))
    want = brute_knn(table(panel.drop("label")), ["x", "y"], ["x", "y", "z"], 4, metric)
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-6)


def test_knn_without_scaling_and_hot_ties(spark):
    """Many equal rows: ties are broken by key, and every copy can be chosen."""
    rows = [(f"c{i:02d}", DATES[0], 1.0, 2.0 if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, a DOUBLE, b DOUBLE")
    done = impute.knn_impute(df, ["b"], 3, features=["a"], normalise=False)
    assert done.where("b IS NULL").count() == 0
    assert done.where("b <> 2.0").count() == 0


def test_staged_imputation_removes_donors(panel):
    donors = panel.where("Country = 'D'")
    rest = panel.where("Country <> 'D'").drop("label")
    out = impute.knn_impute_staged(rest, [("interior", 3), ("all", 2)], ["x", "y"], donors=donors.drop("label"))
    assert {r[0] for r in out.select("Country").distinct().collect()} == {"A", "B", "C"}
    assert out.count() == rest.count()
    with pytest.raises(ValueError):
        impute.knn_impute_staged(rest, [("sideways", 3)])


def test_edges_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", 9)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BATCH", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 3)), 2)
    x[40:] = x[0]  # a third of the points coincide
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id LONG, v ARRAY<DOUBLE>")
    got = neighbours.knn_edges(df, "id", "v", 5).toPandas()
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = sorted(range(60), key=lambda j: (d[j], j))[:5]
        assert list(got[got.id == i].sort_values("rank").neighbour) == want


def test_forecast_follows_simple_series():
    line = np.arange(20.0)
    np.testing.assert_allclose(impute.forecast(line, 3), [20, 21, 22], atol=1e-6)
    np.testing.assert_allclose(impute.forecast(np.full(8, 4.0), 2), [4, 4])
    decay = 8 * 0.5 ** np.arange(12)
    assert np.isfinite(impute.forecast(decay, 5)).all()


def test_forecast_fill_rules(spark):
    rows = [("few", d, 1.0 + i if i < 4 else None) for i, d in enumerate(DATES[:10])]
    rows += [("flat", d, 2.0 if i not in (7, 9) else None) for i, d in enumerate(DATES[:10])]
    rows += [("late", d, None if i < 2 else float(i % 3)) for i, d in enumerate(DATES[:10])]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, v DOUBLE")
    out = table(impute.forecast_fill(df, ["v"]))
    assert out[out.Country == "few"].v.isna().sum() == 6
    assert (out[out.Country == "flat"].v == 2.0).all()
    assert out[out.Country == "late"].v.isna().sum() == 2


def test_regression_finds_a_linear_rule(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in "ABC":
        for i, d in enumerate(DATES):
            a = float(rng.normal())
            rows.append((c, d, a, None if i % 7 == 6 else 3 * a + 2))
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, a DOUBLE, b DOUBLE")
    out = table(impute.regression_impute(df, ["b"]))
    np.testing.assert_allclose(out.b, 3 * out.a + 2, atol=1e-3)
    from pyspark.ml.regression import LinearRegression

    last = df.withColumn("b", F.when(F.col("Date") != DATES[-1], F.coalesce("b", 3 * F.col("a") + 2)))
    fitted = table(impute.regression_impute(last, ["b"], estimator=LinearRegression()))
    np.testing.assert_allclose(fitted.b, 3 * fitted.a + 2, atol=1e-3)


def test_global_components_ignore_signs(spark):
    def rows(sign):
        return [
            ("A", [2.0, 1.0], [0.7, 0.3], [0.7, 1.0], [[0.6, 0.8], [0.8, -0.6]]),
            ("B", [2.0, 1.0], [0.6, 0.4], [0.6, 1.0], [[0.6 * sign, 0.8 * sign], [0.8, -0.6]]),
        ]

    schema = "Country STRING, eigenvalues ARRAY<DOUBLE>, ratios ARRAY<DOUBLE>, cumulative ARRAY<DOUBLE>, components ARRAY<ARRAY<DOUBLE>>"
    for sign in (1, -1):
        out = vectors.global_components(spark.createDataFrame(rows(sign), schema)).orderBy("component").collect()
        np.testing.assert_allclose(out[0]["loadings"], [0.6, 0.8])
        assert out[1]["cumulative"] == pytest.approx(1.0)


def test_dynamic_pca_recursion(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    dates = [d.date() for d in pd.date_range("2020-01-31", periods=30, freq="ME")]
    df = spark.createDataFrame([("A", d, float(a), float(b)) for d, (a, b) in zip(dates, x)], "Country STRING, Date DATE, a DOUBLE, b DOUBLE")
    plain = {"standardise": False, "trend": None, "period": None}
    out = vectors.dynamic_pca(df, ["a", "b"], 0.9, 10, 5, plain).orderBy("Date").collect()
    assert [r["n_rows"] for r in out] == [10, 15, 20, 25, 30]
    mean, cov = x[0].copy(), np.zeros((2, 2))
    for row in x[1:]:
        new = 0.9 * mean + 0.1 * row
        cov = 0.9 * cov + 0.1 * np.outer(row - mean, row - new)
        mean = new
    np.testing.assert_allclose(out[-1]["eigenvalues"], np.linalg.eigvalsh(cov)[::-1])


def test_long_and_wide_agree(panel):
    wide = panel.select("Country", "Date", "x", "y", "z")
    pd.testing.assert_frame_equal(table(to_wide(to_long(wide), ["x", "y", "z"])), table(wide))


def test_history_join_never_sees_itself(panel):
    only = panel.where(F.col("Date") == DATES[0]).where("Country = 'A'").withColumn("x", F.lit(None).cast("double"))
    assert impute.knn_impute(only, ["x"], 3).where("x IS NOT NULL").count() == 0


def test_dedupe_needs_an_order(panel):
    with pytest.raises(PanelError):
        aggregate.dedupe(panel, ["Country"], "last")


def test_require_rows(panel):
    aggregate.require_rows_per_country(panel, 40)
    with pytest.raises(PanelError):
        aggregate.require_rows_per_country(panel, 41)


def test_recipe_logs_steps(panel):
    out, log = run_recipe(panel.drop("label"), [("forward_fill", {"n": 1}), ("backfill", {"fill": "zero"})])
    assert log == ["forward_fill(n=1)", "backfill(fill='zero')"]
    assert out.columns == ["Country", "Date", "x", "y", "z"]
    with pytest.raises(ValueError):
        run_recipe(panel, [("unknown", {})])


def test_dotted_names(spark):
    rows = [("A", DATES[0], 1.0, None), ("A", DATES[1], None, 2.0)]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, `GDP.Q` DOUBLE, `CPI.M` DOUBLE")
    assert fill.ffill_all(df).where("`GDP.Q` IS NULL").count() == 0
    assert select.select_columns(df, suffix=".Q").columns == ["Country", "Date", "GDP.Q"]
    assert aggregate.resample(df, "M").columns == df.columns
    assert joins.merge_timeseries([df]).columns == df.columns
    assert {r["column"] for r in aggregate.completeness(df).collect()} == set(df.columns)


def test_artefact_names_are_deterministic():
    assert writers.artefact_name("rf", {"b": 2, "a": 1}) == writers.artefact_name("rf", {"a": 1, "b": 2})


def test_training_rows_without_a_crisis(spark):
    """One class in the training rows: the other has probability zero, in rolling windows too until it was seen."""
    days = [dt.date(2000 + i // 12, 1 + i % 12, 1) for i in range(48)]
    rows = [(c, d, float(j + i), int(d.year == 2002)) for j, c in enumerate("AB") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, v DOUBLE, label INT")
    train, test = df.where("Date < '2001-01-01'"), df.where("Date >= '2001-01-01'")
    model = models.train_classifier(train, "random_forest", numTrees=3, maxDepth=2)
    done = models.predict(model, test).collect()
    assert len(done) == 72 and all(r["y_pred"] == 0 and r["y_pred_proba"] == 0.0 for r in done)
    rolled = models.fit_predict_rolling(train, test, test_months=12, step_months=12, numTrees=3, maxDepth=2)
    assert {r["window"]: r["n"] for r in rolled.predictions.groupBy("window").agg(F.count("y_pred_proba").alias("n")).collect()} == {1: 24, 2: 24, 3: 22}
    assert [r["train_samples"] for r in rolled.metrics.orderBy("window").collect()] == [24, 48, 72]
    assert rolled.history.count() == 3


def test_stored_models_and_results_without_a_crisis(spark, tmp_path):
    """One class in the training rows: a model read again still gives both probabilities, and its rows can be stored."""
    days = [dt.date(2000 + i // 12, 1 + i % 12, 1) for i in range(24)]
    rows = [(c, d, float(j + i), int(d.year == 2001)) for j, c in enumerate("AB") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "Country STRING, Date DATE, v DOUBLE, label INT")
    train, test = df.where("Date < '2001-01-01'"), df.where("Date >= '2001-01-01'")
    fit = lambda: models.train_classifier(train, "random_forest", numTrees=3, maxDepth=2)
    for _ in range(2):
        model = writers.train_or_load("random_forest", {"n": 3}, str(tmp_path / "models"), fit)
        assert {(r["y_pred"], r["y_pred_proba"]) for r in models.predict(model, test).collect()} == {(0, 0.0)}

    class Slim:
        def transform(self, rows):
            return models.predict(model, rows)

    writers.write_results(Slim(), train, test, str(tmp_path / "results"), "forest", "1", {})
    stored = writers.read_results(spark, str(tmp_path / "results"), "forest").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in stored} == {"train": 24, "test": 24}


def test_stored_models_from_another_thread(spark, tmp_path):
    """A thread without an active session finds, stores and loads models as the main one does."""
    df = spark.createDataFrame([("A", dt.date(2000, 1, i + 1), float(i), i % 2) for i in range(20)], "Country STRING, Date DATE, v DOUBLE, label INT")
    fit = lambda: models.train_classifier(df, "random_forest", numTrees=2, maxDepth=2)
    load = lambda: writers.train_or_load("random_forest", {"n": 2}, str(tmp_path), fit).stages[-1].numClasses
    with ThreadPoolExecutor(1) as pool:
        assert [pool.submit(load).result() for _ in range(2)] == [2, 2]
