"""Classifiers in rolling windows, trained by MLlib on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import encode, expanding, split
from chronopanel.operators.evaluate import window_metrics
from chronopanel.operators.select import filter_date_range
from chronopanel.schema import DATE, KEYS, PanelError, cut_lineage, numeric_columns, q

LABEL = "label"
MODELS = {"random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier}


def feature_columns(df: DataFrame, label: str = LABEL) -> list[str]:
    return [c for c in numeric_columns(df) if c not in (label, "fold", "window")]


def _base(kind: str | Estimator, seed: int, label: str, **params) -> Estimator:
    if isinstance(kind, Estimator):
        return kind
    if kind not in MODELS:
        raise PanelError(f"unknown classifier {kind!r}")
    return MODELS[kind](featuresCol="features", labelCol=label, seed=seed, **params)


def classifier_pipeline(features: Sequence[str], kind: str | Estimator = "random_forest", label: str = LABEL, seed: int = 42, **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, _base(kind, seed, label, **params)])


def _with_classes(df: DataFrame, label: str) -> DataFrame:
    """The label with its number of classes, two at least: the rows before some date may hold no crisis at all."""
    most = df.agg(F.max(q(label).cast("double"))).first()[0]
    if most is None or not most.is_integer():
        return df
    classes = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(max(2, int(most) + 1))]}}
    return df.withMetadata(label, classes)


def train_classifier(df: DataFrame, kind: str | Estimator = "random_forest", features: Sequence[str] | None = None, label: str = LABEL, **params) -> PipelineModel:
    """Random forest, gradient boosting, or any given estimator on all variables but the keys."""
    features = list(features or feature_columns(df, label))
    return classifier_pipeline(features, kind, label, **params).fit(_with_classes(df.fillna(0.0, subset=features), label))


def predict(model: Transformer, df: DataFrame, label: str = LABEL, fill: bool = True) -> DataFrame:
    """Rows with y_true (when labelled), y_pred and the positive probability."""
    features = feature_columns(df, label)
    scored = model.transform(df.fillna(0.0, subset=features) if fill else df)
    own = [q(c) for c in df.columns if c != label]
    truth = [q(label).cast("int").alias("y_true")] if label in df.columns else []
    return scored.select(
        *own, *truth, F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability")[1].alias("y_pred_proba")
    )


def grid_search(
    df: DataFrame,
    kind: str,
    grid: dict[str, Sequence],
    features: Sequence[str] | None = None,
    label: str = LABEL,
    folds: int = 5,
    metric: str = "f1",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Stratified search on the training share: balanced folds, best parameters refitted."""
    features = list(features or feature_columns(df, label))
    held = split.stratified_holdout(df.fillna(0.0, subset=features), label=label)
    folded = split.stratified_kfold(held.where("split = 'train'").drop("split"), folds, label)
    # Folds are read many times; store them once.
    ready = _with_classes(cut_lineage(folded), label)
    pipeline = classifier_pipeline(features, kind, label)
    model = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(ready)


def search_report(spark, found: CrossValidatorModel) -> DataFrame:
    """Average score per parameter combination."""
    rows_ = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for m, s in zip(found.getEstimatorParamMaps(), found.avgMetrics)
    ]
    return spark.createDataFrame(rows_, "params STRING, score DOUBLE")


def mlp_classifier(df: DataFrame, features: Sequence[str] | None = None, label: str = LABEL, hidden: Sequence[int] = (16, 8), iterations: int = 50, seed: int = 42):
    """Dense network on robustly scaled features; returns (scaling, model)."""
    features = list(features or feature_columns(df, label))
    scaling = encode.fit_robust(df, features)
    scaled = encode.scale(df, scaling).fillna(0.0, subset=features)
    net = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[len(features), *hidden, 2], maxIter=iterations, seed=seed
    )
    return scaling, classifier_pipeline(features, net, label).fit(scaled)


def importances(spark, model: PipelineModel, window: int = 0) -> DataFrame:
    """(window, feature, importance) rows of a tree model."""
    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(window, n, float(v)) for n, v in zip(names, values)], "window INT, feature STRING, importance DOUBLE")


def feature_importances(history: DataFrame, window: int, top_n: int = 20) -> DataFrame:
    """Most important features of one window's model."""
    return history.where(F.col("window") == window).orderBy(F.col("importance").desc(), "feature").limit(top_n)


class RollingResult:
    """Predictions, per-window metrics, importances and the last model (or the forest of all windows) of a rolling run."""

    def __init__(self, predictions: DataFrame, metrics: DataFrame, history: DataFrame | None, model: PipelineModel | expanding.Forest):
        self.predictions, self.metrics, self.history, self.model = predictions, metrics, history, model


def _rolling_together(stacked, test, windows, per_date, in_training, label, numTrees: int = 20, maxDepth: int = 4, featureShare: float = 0.5):
    """All windows of a rolling run at once; a row is in the training sets from one window on, or up to one."""
    if not windows:
        raise PanelError("no test rows in any window")
    spark, n = stacked.sparkSession, len(windows)
    features = feature_columns(test, label)
    starts = F.array(*[F.lit(w["start_date"]) for w in windows])
    begun = F.size(F.filter(starts, lambda s: s <= F.col(DATE)))
    rows_ = stacked.select(
        *KEYS, *[q(c) for c in features], q(label), F.when(F.col("__kind") == 2, begun).otherwise(0).alias("first"),
        F.when(F.col("__kind") == 1, begun).otherwise(n).alias("until"),
    )
    forest = expanding.fit(rows_, features, n, label, depth=maxDepth, trees=numTrees, feature_share=featureShare, least_rows=1)
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w["window"]).alias("window"), F.lit(w["start_date"]).alias("s"), F.lit(w["end_date"]).alias("e")) for i, w in enumerate(windows)])
    inside = F.filter(spans, lambda w: (w["s"] <= F.col(DATE)) & (F.col(DATE) < w["e"]))
    asked = test.select("*", F.explode(inside).alias("__w")).select(*test.columns, F.col("__w.i").alias("__i"), F.col("__w.window").alias("window"))
    keep = [*test.columns, "window"]
    scored = expanding.predict(asked, forest, "__i", keep)
    own = [q(c) for c in keep if c != label]
    predictions = scored.select(
        *own, q(label).cast("int").alias("y_true"), (F.col("prediction") > 0.5).cast("int").alias("y_pred"), F.col("prediction").alias("y_pred_proba")
    )
    sizes = []
    for w in windows:
        seen = [r for r in per_date if in_training(r["__kind"], r[DATE], w["start_date"])]
        total = sum(r["n"] for r in seen)
        sizes.append((w["window"], w["start_date"], w["end_date"], total, sum(r["p"] or 0.0 for r in seen) / total if total else None))
    trained = spark.createDataFrame(sizes, "window INT, start_date DATE, end_date DATE, train_samples LONG, train_crisis_rate DOUBLE")
    gains = [(w["window"], c, float(v)) for i, w in enumerate(windows) for c, v in zip(features, forest.importances(i), strict=True)]
    history = spark.createDataFrame(gains, "window INT, feature STRING, importance DOUBLE")
    return RollingResult(predictions, trained.join(window_metrics(predictions), "window", "left"), history, forest)


def fit_predict_rolling(
    train: DataFrame,
    test: DataFrame,
    kind: str | Estimator = "random_forest",
    test_months: int = 12,
    step_months: int = 3,
    include_last: bool = False,
    label: str = LABEL,
    **params,
) -> RollingResult:
    """Train on everything before a window, predict it, move on.

    The driver loops over windows (calendar steps); every fit and prediction is
    a distributed job. Training and test rows are checkpointed once so that no
    window re-runs the plan that produced them. With ``kind="histogram_forest"``
    the trees of all windows grow together instead: then the number of jobs
    depends on their depth and not on the windows. A test row takes the place of
    the training row of its key once it lies before the window; which rows that
    concerns is found once, so a window's training set is a mere filter, stored
    while the model is fitted. Sizes come from one count per date.
    """
    spark = train.sparkSession
    test = cut_lineage(test)
    again = test.select(*KEYS, F.lit(True).alias("__again")).distinct()
    stacked = train.join(again, list(KEYS), "left").withColumn("__kind", F.when(F.col("__again"), 1).otherwise(0)).drop("__again")
    stacked = cut_lineage(stacked.unionByName(test.withColumn("__kind", F.lit(2))))
    positive = F.sum(q(label).cast("double"))
    per_date = stacked.groupBy(DATE, "__kind").agg(F.count("*").alias("n"), positive.alias("p")).collect()  # calendar days

    def in_training(kind, date, start):
        """Training rows (0), those a test row replaces later (1), test rows (2)."""
        return (kind == 0) | ((kind == 1) & (date >= start)) | ((kind == 2) & (date < start))

    windows = split.rolling_windows(test, test_months, step_months, include_last).orderBy("window").collect()
    if kind == "histogram_forest":
        held = [w for w in windows if any(r["__kind"] == 2 and w["start_date"] <= r[DATE] < w["end_date"] for r in per_date)]
        return _rolling_together(stacked, test, held, per_date, in_training, label, **params)
    predictions, history, sizes, model = None, None, [], None
    for w in windows:
        rows_ = filter_date_range(test, w["start_date"], w["end_date"])
        if rows_.limit(1).count() == 0:
            continue
        start = w["start_date"]
        seen = stacked.where(in_training(F.col("__kind"), F.col(DATE), F.lit(start))).drop("__kind").persist()
        model = train_classifier(seen, kind, label=label, **params)
        seen.unpersist()
        part = predict(model, rows_, label).withColumn("window", F.lit(w["window"]))
        predictions = part if predictions is None else predictions.unionByName(part)
        own = [r for r in per_date if in_training(r["__kind"], r[DATE], start)]
        n = sum(r["n"] for r in own)
        sizes.append((w["window"], start, w["end_date"], n, sum(r["p"] or 0.0 for r in own) / n if n else None))
        if hasattr(model.stages[-1], "featureImportances"):
            part = importances(spark, model, w["window"])
            history = part if history is None else history.unionByName(part)
    if predictions is None:
        raise PanelError("no test rows in any window")
    trained = spark.createDataFrame(sizes, "window INT, start_date DATE, end_date DATE, train_samples LONG, train_crisis_rate DOUBLE")
    metrics = trained.join(window_metrics(predictions), "window", "left")
    return RollingResult(predictions, metrics, history, model)
