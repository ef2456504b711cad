"""Scoring of predictions. Every measure merges counts first; no measure sorts the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalars import experiment_parts
from chronopanel.operators.joins import countries_in_both, crisis_intervals
from chronopanel.ordered import running_totals
from chronopanel.schema import DATE, ENTITY, q

TRUE, PREDICTED, SCORE = "y_true", "y_pred", "y_pred_proba"


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _metric_columns() -> dict[str, Column]:
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("fn"), F.col("tn")
    zero = F.lit(0.0)
    return {
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1_score": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    }


def classification_metrics(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """Accuracy, precision, recall and F1; undefined ratios are 0."""
    t, p = q(true) == 1, q(predicted) == 1
    counts = df.groupBy(*by).agg(
        _count_if(t & p).alias("tp"), _count_if(~t & p).alias("fp"), _count_if(t & ~p).alias("fn"), _count_if(~t & ~p).alias("tn")
    )
    return counts.select(*by, *[e.alias(n) for n, e in _metric_columns().items()])


def _score_steps(df: DataFrame, by: Sequence[str], true: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with their running totals and group sizes."""
    by = list(by)
    steps = df.groupBy(*by, q(score).alias("__score")).agg(
        F.sum(q(true).cast("long")).alias("__pos"), F.sum(1 - q(true).cast("long")).alias("__neg")
    )
    running = running_totals(steps, by, "__score", {"__cpos": "__pos", "__cneg": "__neg"})
    sizes = df.groupBy(*by).agg(
        F.sum(q(true).cast("long")).alias("__P"), F.sum(1 - q(true).cast("long")).alias("__N")
    )
    if by:
        return running.join(sizes, by)
    total = sizes.agg(F.first(F.struct("__P", "__N"))).scalar()
    return running.withColumn("__t", total).select("*", "__t.__P", "__t.__N").drop("__t")


def roc_auc(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, score: str = SCORE) -> DataFrame:
    """Area under the ROC curve with ties averaged; 0.5 when one class is missing."""
    steps = _score_steps(df, by, true, score)
    wins = F.sum(F.col("__pos") * (F.col("__cneg") - F.col("__neg") / 2))
    pairs = F.max("__P") * F.max("__N")
    return steps.groupBy(*by).agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.5)).alias("roc_auc"))


def roc_curve(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, score: str = SCORE) -> DataFrame:
    """False and true positive rate at every distinct score, rows at or above it counting as positive."""
    steps = _score_steps(df, by, true, score)
    at_least = lambda total, run, own: F.col(total) - F.col(run) + F.col(own)
    return steps.select(
        *by,
        F.col("__score").alias("threshold"),
        F.try_divide(at_least("__N", "__cneg", "__neg"), F.col("__N")).alias("fpr"),
        F.try_divide(at_least("__P", "__cpos", "__pos"), F.col("__P")).alias("tpr"),
    )


def window_metrics(df: DataFrame, by: Sequence[str] = ("window",)) -> DataFrame:
    """Counts, class rate, F1, precision, recall and AUC of every window."""
    sizes = df.groupBy(*by).agg(
        F.count("*").alias("test_samples"), F.avg(q(TRUE).cast("double")).alias("test_crisis_rate")
    )
    return sizes.join(classification_metrics(df, by), list(by)).join(roc_auc(df, by), list(by))


def confusion_matrix(df: DataFrame, normalise: bool = True, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """Counts per (true, predicted) class and their share of the true class."""
    counts = df.groupBy(q(true).alias("y_true"), q(predicted).alias("y_pred")).agg(F.count("*").alias("n"))
    if not normalise:
        return counts
    # One row per pair of classes from here on.
    totals = counts.groupBy("y_true").agg(F.sum("n").alias("__total"))
    return counts.join(totals, "y_true").select("y_true", "y_pred", "n", (F.col("n") / F.col("__total")).alias("share"))


def _log_loss_with_logits(x: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Cross entropy of a logit, written so that large logits do not overflow."""
    weight = 1 + (pos_weight - 1) * y
    return (1 - y) * x + weight * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


# Default parameters of the losses.
LOSS_DEFAULTS = {
    "focal": {"alpha": 0.25, "gamma": 2.0},
    "adaptive_focal": {"alpha": 0.9, "gamma": 2.5, "label_smoothing": 0.1},
    "weighted_bce": {"pos_weight": 1.0},
    "precision_focal": {"alpha": 0.15, "gamma": 2.5, "precision_weight": 2.0},
}


def loss_expression(kind: str, logit: Column, true: Column, **params) -> Column:
    p = {**LOSS_DEFAULTS[kind], **params}
    y = true.cast("double")
    prob = 1 / (1 + F.exp(-logit))
    if kind == "weighted_bce":
        return _log_loss_with_logits(logit, y, p["pos_weight"])
    if kind == "adaptive_focal":
        y = y * (1 - p["label_smoothing"]) + 0.5 * p["label_smoothing"]
    entropy = _log_loss_with_logits(logit, y)
    class_weight = p["alpha"] * y + (1 - p["alpha"]) * (1 - y)
    if kind == "precision_focal":
        focal = class_weight * F.pow(1 - F.exp(-entropy), F.lit(p["gamma"])) * entropy
        return focal + p["precision_weight"] * prob * (1 - y)
    miss = 1 - (prob * y + (1 - prob) * (1 - y))
    power = F.lit(p["gamma"]) + (0.5 * miss if kind == "adaptive_focal" else F.lit(0.0))
    focal = F.pow(miss, power) * entropy
    return focal if p["alpha"] < 0 else class_weight * focal


def loss_report(df: DataFrame, kinds: Sequence[str] = tuple(LOSS_DEFAULTS), true: str = TRUE, logit: str = "logit") -> DataFrame:
    """Mean of each loss over a prediction table, in one pass."""
    return df.agg(*[F.avg(loss_expression(k, q(logit), q(true))).alias(k) for k in kinds])


def threshold_predictions(
    df: DataFrame, threshold: float = 0.5, inclusive: bool = True, score: str = SCORE, name: str = PREDICTED
) -> DataFrame:
    hit = q(score) >= threshold if inclusive else q(score) > threshold
    return df.withColumn(name, hit.cast("int"))


def prediction_timeline(predictions: DataFrame, crises: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Plot table: crisis intervals and positive prediction dates of shared countries.

    ``crises`` carries Country, Year and region; rows are (region, Country,
    kind, start_date, end_date).
    """
    shared = countries_in_both(crises, predictions)
    regions = crises.groupBy(ENTITY).agg(F.min("region").alias("region"))
    intervals = (
        crisis_intervals(crises.select(ENTITY, "Year").distinct(), predictions)
        .join(shared, ENTITY, "left_semi")
        .select(ENTITY, F.lit("crisis").alias("kind"), "start_date", "end_date")
    )
    hits = (
        threshold_predictions(predictions, threshold)
        .where(q(PREDICTED) == 1)
        .join(shared, ENTITY, "left_semi")
        .select(ENTITY, F.lit("prediction").alias("kind"), F.col(DATE).alias("start_date"), F.col(DATE).alias("end_date"))
    )
    return intervals.unionByName(hits).join(regions, ENTITY).select("region", ENTITY, "kind", "start_date", "end_date")


def auc_by_experiment(df: DataFrame, true: str = TRUE, score: str = SCORE) -> DataFrame:
    """AUC per method, group, training market and test market from labelled experiment names."""
    parts = experiment_parts(F.col("experiment"), F.col("method"))
    named = df.select(q(true), q(score), *[e.alias(n) for n, e in parts.items()])
    return roc_auc(named, list(parts), true, score)


def roc_compare(df: DataFrame, models: Sequence[str], true: str = TRUE) -> DataFrame:
    """AUC of many score columns at once."""
    typed = df.select(true, *[q(m).cast("double").alias(m) for m in models])
    long = typed.unpivot([true], [f"`{m}`" for m in models], "model", SCORE)
    return roc_auc(long, ["model"], true, SCORE)
