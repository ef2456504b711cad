"""Classifiers over the labelled panel and over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import encode, features, models
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import scratch, with_views
from chronopanel.schema import DATE, KEYS
from chronopanel.sources import writers

SMALL = {"numTrees": 10, "maxDepth": 4}


def _rows(spark, sf):
    """Labelled monthly panel with a few features."""
    rolled = features.rolling(views.labelled(spark, sf), ["total", "orders"], 6, ["mean", "std"])
    return features.momentum(rolled, ["total", "orders"])


def _sets(spark, sf):
    rows = _rows(spark, sf)
    return rows.where(F.col(DATE) <= "1998-12-31"), rows.where(F.col(DATE) > "1998-12-31")


@query("mod1_random_forest")
def random_forest(spark, sf):
    train, test = _sets(spark, sf)
    model = models.train_classifier(train, "random_forest", **SMALL)
    return models.predict(model, test).select(*KEYS, "y_true", "y_pred", "y_pred_proba")


@query("mod1_gradient_boosting")
def boosting(spark, sf):
    train, test = _sets(spark, sf)
    model = models.train_classifier(train, "gradient_boosting", maxIter=5, maxDepth=3)
    return models.predict(model, test).select(*KEYS, "y_true", "y_pred", "y_pred_proba")


# A forest sees the label itself here, so its predictions must equal it.
@query("mod1_separable", f"{with_views('lnm')} SELECT Country, Date, label AS y_true, label AS y_pred FROM lnm")
def separable(spark, sf):
    rows = views.labelled(spark, sf).select(*KEYS, "orders", "label").withColumn("hint", F.col("label") * 2.0)
    model = models.train_classifier(rows, "random_forest", features=["hint"], numTrees=3, maxDepth=2)
    return models.predict(model, rows).select(*KEYS, "y_true", "y_pred")


def _hinted(spark, sf):
    """The labelled panel with one feature, which gives the label away."""
    return views.labelled(spark, sf).select(*KEYS, "label", (F.col("label") * 2.0).alias("hint"))


def _hinted_sets(spark, sf):
    rows = _hinted(spark, sf)
    return rows.where(F.col(DATE) <= "1998-12-31"), rows.where(F.col(DATE) > "1998-12-31")


# With the label among the features every choice of parameters scores 1.
@query("mod2_grid_search_separable", "SELECT 'maxDepth=2, numTrees=3' AS params, 1.0::DOUBLE AS score UNION ALL SELECT 'maxDepth=3, numTrees=3', 1.0", approx=["score"])
def grid_separable(spark, sf):
    found = models.grid_search(_hinted(spark, sf), "random_forest", {"maxDepth": [2, 3], "numTrees": [3]}, ["hint"], folds=2)
    return models.search_report(spark, found)


@query("mod3_mlp_separable", f"{with_views('lnm')} SELECT Country, Date, label AS y_true, label AS y_pred FROM lnm")
def mlp_separable(spark, sf):
    rows = _hinted(spark, sf)
    scaling, model = models.mlp_classifier(rows, ["hint"], hidden=[4], iterations=100)
    return models.predict(model, encode.scale(rows, scaling)).select(*KEYS, "y_true", "y_pred")


WINDOWS = """te AS (SELECT * FROM lnm WHERE Date > DATE '1998-12-31'), e AS (SELECT min(Date) AS lo, max(Date) AS hi FROM te),
s AS (SELECT hi, i, CAST(lo + to_months(CAST(12 * i AS INT)) AS DATE) AS s FROM e CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS i)),
wd AS (SELECT CAST(i + 1 AS INT) AS w, s, least(CAST(s + INTERVAL 12 MONTH AS DATE), hi) AS e FROM s WHERE s < hi)"""


def _hinted_rolling(spark, sf):
    train, test = _hinted_sets(spark, sf)
    return models.fit_predict_rolling(train, test, test_months=12, step_months=12, numTrees=3, maxDepth=2)


@query(
    "mod4_rolling_sizes",
    f"""{with_views('lnm')}, {WINDOWS}
SELECT wd.w AS "window", wd.s AS start_date, wd.e AS end_date, count(*) AS train_samples, avg(CAST(label AS DOUBLE)) AS train_crisis_rate
FROM wd JOIN lnm ON lnm.Date < wd.s OR lnm.Date <= DATE '1998-12-31' GROUP BY 1, 2, 3""",
    approx=["train_crisis_rate"],
)
def rolling_sizes(spark, sf):
    """Windows and training sets; they do not depend on the model."""
    return _hinted_rolling(spark, sf).metrics.select("window", "start_date", "end_date", "train_samples", "train_crisis_rate")


@query("mod6_predict_latest_separable", f"{with_views('lnm')} SELECT Country, Date, label AS y_pred FROM lnm WHERE Date > DATE '1998-12-31'")
def latest_separable(spark, sf):
    _, test = _hinted_sets(spark, sf)
    return models.predict(_hinted_rolling(spark, sf).model, test).select(*KEYS, "y_pred")


@query("mod7_importance_single", f"""{with_views('lnm')}, {WINDOWS} SELECT w AS "window", 'hint' AS feature, 1.0::DOUBLE AS importance FROM wd""", approx=["importance"])
def importance_single(spark, sf):
    return _hinted_rolling(spark, sf).history


@query("top4_feature_importances_single", "SELECT CAST(1 AS INT) AS \"window\", 'hint' AS feature, 1.0::DOUBLE AS importance", approx=["importance"])
def importances_single(spark, sf):
    return models.feature_importances(_hinted_rolling(spark, sf).history, 1, 5)


@query("mod2_grid_search")
def grid(spark, sf):
    train, _ = _sets(spark, sf)
    found = models.grid_search(train, "random_forest", {"maxDepth": [2, 4], "numTrees": [5]}, folds=3)
    return models.search_report(spark, found)


@query("mod3_mlp_classifier")
def mlp(spark, sf):
    train, test = _sets(spark, sf)
    scaling, model = models.mlp_classifier(train, hidden=[8], iterations=20)
    return models.predict(model, encode.scale(test, scaling)).select(*KEYS, "y_true", "y_pred", "y_pred_proba")


def _rolling(spark, sf):
    train, test = _sets(spark, sf)
    return models.fit_predict_rolling(train, test, test_months=12, step_months=12, **SMALL)


@query("mod4_rolling_metrics")
def rolling_metrics(spark, sf):
    return _rolling(spark, sf).metrics


@query("mod5_predictions_table")
def predictions(spark, sf):
    return _rolling(spark, sf).predictions.select(*KEYS, "window", "y_true", "y_pred", "y_pred_proba")


# Keys, windows and truth of the rolling predictions do not depend on the model.
@query(
    "mod5_prediction_windows",
    f"""{with_views('lnm')}, te AS (SELECT * FROM lnm WHERE Date > DATE '1998-12-31'), e AS (SELECT min(Date) AS lo, max(Date) AS hi FROM te),
s AS (SELECT hi, i, CAST(lo + to_months(CAST(12 * i AS INT)) AS DATE) AS s FROM e CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS i)),
wd AS (SELECT CAST(i + 1 AS INT) AS w, s, least(CAST(s + INTERVAL 12 MONTH AS DATE), hi) AS e FROM s WHERE s < hi)
SELECT Country, Date, wd.w AS "window", label AS y_true FROM te JOIN wd ON te.Date >= wd.s AND te.Date < wd.e""",
)
def prediction_windows(spark, sf):
    return _rolling(spark, sf).predictions.select(*KEYS, "window", "y_true")


@query("mod4_windows_together")
def windows_together(spark, sf):
    """Metrics of windows whose trees grow in one run."""
    train, test = _sets(spark, sf)
    return models.fit_predict_rolling(train, test, "histogram_forest", test_months=12, step_months=12).metrics


# On a feature that gives the label away, all windows at once: training sets, truth and predictions.
@query(
    "mod4_together_separable",
    f"""{with_views('lnm')}, {WINDOWS}, n AS (SELECT wd.w, count(*) AS train_samples FROM wd JOIN lnm ON lnm.Date < wd.s OR lnm.Date <= DATE '1998-12-31' GROUP BY 1)
SELECT Country, Date, wd.w AS "window", label AS y_true, label AS y_pred, n.train_samples FROM te JOIN wd ON te.Date >= wd.s AND te.Date < wd.e JOIN n ON n.w = wd.w""",
)
def together_separable(spark, sf):
    train, test = _hinted_sets(spark, sf)
    done = models.fit_predict_rolling(train, test, "histogram_forest", test_months=12, step_months=12, numTrees=1, featureShare=1.0)
    sizes = done.metrics.select("window", "train_samples")
    return done.predictions.select(*KEYS, "window", "y_true", "y_pred").join(sizes, "window").select(*KEYS, "window", "y_true", "y_pred", "train_samples")


@query("mod6_predict_latest")
def latest(spark, sf):
    _, test = _sets(spark, sf)
    return models.predict(_rolling(spark, sf).model, test).select(*KEYS, "y_pred", "y_pred_proba")


@query("mod7_importance_history")
def history(spark, sf):
    return _rolling(spark, sf).history


@query("top4_feature_importances")
def importances(spark, sf):
    return models.feature_importances(_rolling(spark, sf).history, 1, 5)


@query("mod8_train_or_load", f"{with_views('lnm')} SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM lnm WHERE Date > DATE '1998-12-31'", approx=["largest_difference"])
def train_or_load(spark, sf):
    """The second call loads what the first stored: predictions agree."""
    train, test = _sets(spark, sf)
    folder = scratch(spark, "models")
    fit = lambda: models.train_classifier(train, "random_forest", **SMALL)
    first = writers.train_or_load("random_forest", SMALL, folder, fit)
    second = writers.train_or_load("random_forest", SMALL, folder, fit)
    a = models.predict(first, test).select(*KEYS, F.col("y_pred_proba").alias("fitted"))
    b = models.predict(second, test).select(*KEYS, F.col("y_pred_proba").alias("loaded"))
    return a.join(b, list(KEYS)).agg(F.count("*").alias("n"), F.max(F.abs(F.col("fitted") - F.col("loaded"))).alias("largest_difference"))


@query(
    "snk4_snk5_results",
    f"""{with_views('lnm')} SELECT '20240201T000000' AS run_ts, CASE WHEN Date > DATE '1998-12-31' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM lnm GROUP BY 2""",
)
def results(spark, sf):
    """Two runs stored; the newest is read back."""
    train, test = _sets(spark, sf)
    model = models.train_classifier(train, "random_forest", **SMALL)
    folder = scratch(spark, "results")
    keep = lambda df: df.select(*KEYS, *models.feature_columns(df), "label")
    slim = _Slim(model)
    for run in ("20240101T000000", "20240201T000000"):
        writers.write_results(slim, keep(train), keep(test), folder, "forest", run, SMALL)
    return writers.read_results(spark, folder, "forest").groupBy("run_ts", "split").agg(F.count("*").alias("n"))


class _Slim:
    """Transformed rows without vector columns."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return models.predict(self.model, df)
