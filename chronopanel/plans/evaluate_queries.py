"""Scoring of predictions on labelled documents and of panel predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import evaluate
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import DATE, ENTITY, KEYS

SC = with_views("scores")
METRICS = ["accuracy", "precision", "recall", "f1_score"]
COUNTS = """sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1.0 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1.0 ELSE 0 END) AS tn"""
RATIOS = """(tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score"""
# All pairs of a positive and a negative: the definition, not the rank form.
AUC = "(SELECT avg(CASE WHEN p.{s} > n.{s} THEN 1.0 WHEN p.{s} = n.{s} THEN 0.5 ELSE 0 END) FROM {t} p JOIN {t} n ON p.y_true = 1 AND n.y_true = 0 {on})"


@query("evl1_classification_metrics", f"{SC}, c AS (SELECT {COUNTS} FROM scores) SELECT {RATIOS} FROM c", approx=METRICS)
def metrics(spark, sf):
    return evaluate.classification_metrics(views.scores(spark, sf))


@query(
    "evl2_window_metrics",
    f"""{SC}, c AS (SELECT lang, count(*) AS test_samples, avg(y_true) AS test_crisis_rate, {COUNTS} FROM scores GROUP BY 1),
u AS (SELECT p.lang, avg(CASE WHEN p.y_pred_proba > n.y_pred_proba THEN 1.0 WHEN p.y_pred_proba = n.y_pred_proba THEN 0.5 ELSE 0 END) AS a FROM scores p JOIN scores n ON p.y_true = 1 AND n.y_true = 0 AND p.lang = n.lang GROUP BY 1)
SELECT c.lang, test_samples, test_crisis_rate, {RATIOS}, coalesce(u.a, 0.5) AS roc_auc FROM c LEFT JOIN u ON c.lang = u.lang""",
    approx=["test_crisis_rate", *METRICS, "roc_auc"],
)
def window_metrics(spark, sf):
    return evaluate.window_metrics(views.scores(spark, sf), ["lang"])


@query("evl3_roc_auc", f"{SC} SELECT {AUC.format(s='y_pred_proba', t='scores', on='')} AS roc_auc", approx=["roc_auc"])
def auc(spark, sf):
    return evaluate.roc_auc(views.scores(spark, sf))


@query(
    "evl4_roc_curve",
    f"""{SC}, t AS (SELECT DISTINCT y_pred_proba AS threshold FROM scores), z AS (SELECT sum(y_true) AS p, sum(1 - y_true) AS n FROM scores)
SELECT threshold, sum(CASE WHEN s.y_pred_proba >= threshold THEN 1 - y_true ELSE 0 END) / max(z.n) AS fpr, sum(CASE WHEN s.y_pred_proba >= threshold THEN y_true ELSE 0 END) / max(z.p) AS tpr
FROM t, scores s, z GROUP BY 1""",
    approx=["threshold", "fpr", "tpr"],
    digits=9,
)
def curve(spark, sf):
    return evaluate.roc_curve(views.scores(spark, sf))


@query("evl5_confusion_matrix", f"{SC} SELECT y_true, y_pred, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY y_true) AS share FROM scores GROUP BY 1, 2", approx=["share"])
def confusion(spark, sf):
    return evaluate.confusion_matrix(views.scores(spark, sf))


# In the form that keeps its digits however far from zero the logit is.
BCE = "(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))"


@query(
    "evl6_loss_report",
    f"""{SC}, a AS (SELECT y_true::DOUBLE AS y, y_true * 0.9::DOUBLE + 0.05::DOUBLE AS ys, logit AS x FROM scores), b AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM a),
c AS (SELECT *, {BCE} AS ce, {BCE.replace(' y ', ' ys ')} AS ces, 1 - (p * y + (1 - p) * (1 - y)) AS miss, 1 - (p * ys + (1 - p) * (1 - ys)) AS misss FROM b)
SELECT avg((0.25::DOUBLE * y + 0.75::DOUBLE * (1 - y)) * pow(miss, 2) * ce) AS focal,
  avg((0.9::DOUBLE * ys + 0.1::DOUBLE * (1 - ys)) * pow(misss, 2.5::DOUBLE + 0.5 * misss) * ces) AS adaptive_focal, avg(ce) AS weighted_bce,
  avg((0.15::DOUBLE * y + 0.85::DOUBLE * (1 - y)) * pow(miss, 2.5::DOUBLE) * ce + 2 * p * (1 - y)) AS precision_focal FROM c""",
    approx=["focal", "adaptive_focal", "weighted_bce", "precision_focal"],
)
def losses(spark, sf):
    return evaluate.loss_report(views.scores(spark, sf))


@query(
    "evl7_threshold_predictions",
    f"{SC} SELECT doc_id, CAST(y_pred_proba >= 0.6::DOUBLE AS INT) AS y_pred, CAST(y_pred_proba > 0.6::DOUBLE AS INT) AS strict FROM scores",
)
def threshold(spark, sf):
    both = evaluate.threshold_predictions(evaluate.threshold_predictions(views.scores(spark, sf), 0.6), 0.6, inclusive=False, name="strict")
    return both.select("doc_id", "y_pred", "strict")


@query(
    "evl8_prediction_timeline",
    f"""{with_views('lnm', 'lab', 'master')}, rows_ AS (SELECT Country, Date, 1 / (1 + orders) AS p FROM lnm),
ext AS (SELECT min(Date) - 180 AS lo, max(Date) + 180 AS hi FROM rows_),
iv AS (SELECT Country, 'crisis' AS kind, greatest(make_date(CAST(Year AS INT), 1, 1), lo) AS start_date, least(make_date(CAST(Year AS INT), 12, 31), hi) AS end_date
  FROM lab, ext WHERE make_date(CAST(Year AS INT), 12, 31) >= lo AND make_date(CAST(Year AS INT), 1, 1) <= hi),
al AS (SELECT * FROM iv UNION ALL SELECT Country, 'prediction', Date, Date FROM rows_ WHERE p >= 0.15)
SELECT m.region, al.Country, kind, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM al JOIN master m ON m.name = al.Country
WHERE al.Country IN (SELECT Country FROM lab) AND al.Country IN (SELECT Country FROM rows_)""",
)
def timeline(spark, sf):
    nm = views.nation_month(spark, sf)
    predictions = nm.select(*KEYS, (1 / (1 + F.col("orders"))).alias("y_pred_proba"))
    regions = views.country_master(spark, sf).select(F.col("name").alias(ENTITY), "region")
    return evaluate.prediction_timeline(predictions, views.crisis_labels(spark, sf).join(regions, ENTITY), 0.15)


@query(
    "evl9_auc_by_experiment",
    f"""{SC}, e AS (SELECT y_true, y_pred_proba, CASE WHEN lang = 'en' THEN 'Mixed' WHEN doc_id % 2 = 0 THEN 'Developed' ELSE 'Emerging' END AS train_market,
  CASE WHEN doc_id % 3 = 0 THEN 'Developed' ELSE 'Emerging' END AS test_market, CASE WHEN doc_id % 5 < 2 THEN 'Plain' ELSE 'Wide' END AS method_name, CASE WHEN doc_id % 5 < 2 THEN 'ungrouped' ELSE 'Nets' END AS method_group FROM scores),
g AS (SELECT DISTINCT train_market, test_market, method_name, method_group FROM e),
u AS (SELECT p.train_market, p.test_market, p.method_name, avg(CASE WHEN p.y_pred_proba > n.y_pred_proba THEN 1.0 WHEN p.y_pred_proba = n.y_pred_proba THEN 0.5 ELSE 0 END) AS a
  FROM e p JOIN e n ON p.y_true = 1 AND n.y_true = 0 AND p.train_market = n.train_market AND p.test_market = n.test_market AND p.method_name = n.method_name GROUP BY 1, 2, 3)
SELECT g.*, coalesce(u.a, 0.5) AS roc_auc FROM g LEFT JOIN u USING (train_market, test_market, method_name)""",
    approx=["roc_auc"],
)
def experiments(spark, sf):
    d = F.col("doc_id")
    train = F.when(F.col("lang") == "en", "Developed + Emerging").when(d % 2 == 0, "Developed").otherwise("Emerging")
    test = F.when(d % 3 == 0, "Developed").otherwise("Emerging")
    rows = views.scores(spark, sf).withColumns(
        {"experiment": F.concat_ws(", ", train, test), "method": F.when(d % 5 < 2, "Plain").otherwise("Wide [Nets]")}
    )
    return evaluate.auc_by_experiment(rows)


@query(
    "evl10_roc_compare",
    f"""{SC} SELECT 'y_pred_proba' AS model, {AUC.format(s='y_pred_proba', t='scores', on='')} AS roc_auc UNION ALL SELECT 'other_score', {AUC.format(s='other_score', t='scores', on='')}""",
    approx=["roc_auc"],
)
def compare(spark, sf):
    return evaluate.roc_compare(views.scores(spark, sf), ["y_pred_proba", "other_score"])
