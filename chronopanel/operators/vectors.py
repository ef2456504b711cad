"""Principal components and related measures of wide panels.

Covariance is always summed inside Spark; what reaches the driver or a single
task is a matrix over the variables, whose size the schema bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.features import prepare_series, prepare_windows
from chronopanel.schema import DATE, ENTITY, KEYS, PanelError, numeric_columns, q, spread
from chronopanel.sources.writers import train_or_load

# Variance shares used when choosing and describing components.
DEFAULT_VARIANCE = 0.95
DESCRIBED_VARIANCE = 0.8


@dataclass(frozen=True)
class Components:
    """Fitted components: scaling statistics, unit loadings (component by feature), variance shares.

    ``model`` is the same as a pipeline of MLlib's stages (assemble, scale, project, turn, cut off), which can be written,
    read and applied by itself; ``of`` makes components of it again.
    """

    features: tuple[str, ...]
    scaling: dict[str, tuple[float, float]]
    loadings: np.ndarray
    ratios: np.ndarray
    prefix: str
    model: PipelineModel

    @staticmethod
    def of(model: PipelineModel) -> Components:
        assembler, scaler, projection, turned, cut = model.stages
        features, kept = tuple(assembler.getInputCols()), cut.getIndices()
        factor = np.asarray(turned.getScalingVec().toArray())
        deviation = np.asarray(scaler.std.toArray()) / np.abs(factor[0])
        means = np.asarray(scaler.mean.toArray())
        scaling = {c: (float(m), float(d) or 1.0) for c, m, d in zip(features, means, deviation, strict=True)}
        loadings = projection.pc.toArray().T * np.sign(factor)[:, None]
        return Components(features, scaling, loadings[kept], projection.explainedVariance.toArray()[kept], cut.getOutputCol(), model)


def fix_signs(loadings: np.ndarray) -> np.ndarray:
    """Make the largest absolute loading of every component positive."""
    top = np.abs(loadings).argmax(axis=1)
    sign = np.sign(loadings[np.arange(len(loadings)), top])
    return loadings * np.where(sign == 0, 1.0, sign)[:, None]


def _fits(df: DataFrame, features: Sequence[str], n_components: float | int, parts: Sequence[tuple[str, Column | None]]) -> list[Components]:
    """Components of every part (prefix, condition) of the rows, under one scaling by all of them."""
    if not features:
        raise PanelError("no numeric features")
    columns = lambda stage: f"__pca_{stage}"
    assembler = VectorAssembler(inputCols=list(features), outputCol=columns("raw"), handleInvalid="error")
    raw = assembler.transform(df)
    n = df.count()
    scaler = StandardScaler(withMean=True, inputCol=columns("raw"), outputCol=columns("scaled")).fit(raw)
    scaled = scaler.transform(raw)
    # missing values are refused by the fit, and give missing scores later
    lenient = VectorAssembler(inputCols=list(features), outputCol=columns("raw"), handleInvalid="keep")
    out = []
    for prefix, condition in parts:
        rows_ = scaled if condition is None else scaled.where(condition)
        model = PCA(k=len(features), inputCol=columns("scaled"), outputCol=columns("projected")).fit(rows_.select(columns("scaled")))
        ratios, pc = model.explainedVariance.toArray(), model.pc.toArray().T
        if isinstance(n_components, float):
            k = int(np.searchsorted(np.cumsum(ratios), n_components - 1e-12)) + 1
        else:
            k = n_components
        k = max(1, min(k, len(features)))
        fixed = fix_signs(pc)
        # the scaler divides by sample deviations; components are of population ones
        factor = np.where((fixed * pc).sum(axis=1) < 0, -1.0, 1.0) * np.sqrt(n / (n - 1) if n > 1 else 1.0)
        turned = ElementwiseProduct(scalingVec=Vectors.dense(factor), inputCol=columns("projected"), outputCol=columns("turned"))
        cut = VectorSlicer(inputCol=columns("turned"), outputCol=prefix, indices=list(range(k)))
        out.append(Components.of(PipelineModel([lenient, scaler, model, turned, cut])))
    return out


def pca_fit(df: DataFrame, features: Sequence[str] | None = None, n_components: float | int = DEFAULT_VARIANCE, prefix: str = "PC") -> Components:
    """Components of standardised features: a share of variance (float) or a number (int)."""
    return _fits(df, list(features or numeric_columns(df)), n_components, [(prefix, None)])[0]


def pca_train_or_load(df: DataFrame, folder: str, features: Sequence[str], n_components: float | int = DEFAULT_VARIANCE, prefix: str = "PC") -> Components:
    """Components stored under their parameters, or fitted and stored."""
    params = {"features": "-".join(features), "n": n_components, "prefix": prefix}
    return Components.of(train_or_load("pca", params, folder, lambda: pca_fit(df, features, n_components, prefix).model))


def pca_transform(df: DataFrame, fitted: Components, keep: Sequence[str] = KEYS) -> DataFrame:
    """Component columns next to the kept ones."""
    return pca_project(df, [fitted], keep)


def pca_project(df: DataFrame, fits: Sequence[Components], keep: Sequence[str] = KEYS) -> DataFrame:
    """Rows projected on several component sets, each by one product per row of its stored model."""
    needed = list(dict.fromkeys([*keep, *(c for f in fits for c in f.features)]))
    scored = df.select(*[q(c) for c in needed])
    for f in fits:
        scored = f.model.transform(scored)
        scored = scored.drop(*[s.getOutputCol() for s in f.model.stages[:-1]])
        scored = scored.withColumn(f.prefix, vector_to_array(f.prefix))
    out = [
        F.nanvl(q(f.prefix)[i], F.lit(None).cast("double")).alias(f"{f.prefix}{i + 1}") for f in fits for i in range(len(f.loadings))
    ]
    return scored.select(*[q(c) for c in keep], *out)


def explained_variance(spark, fitted: Components) -> DataFrame:
    """Share and cumulative share per component, and how many reach 80 percent."""
    total = np.cumsum(fitted.ratios)
    needed = int(np.searchsorted(total, DESCRIBED_VARIANCE - 1e-12)) + 1
    rows_ = [(i + 1, float(r), float(c), needed) for i, (r, c) in enumerate(zip(fitted.ratios, total))]
    return spark.createDataFrame(rows_, "component INT, ratio DOUBLE, cumulative DOUBLE, needed_for_80 INT")


def class_pca_fit(
    df: DataFrame, label: str = "label", features: Sequence[str] | None = None, n_components: float | int = DEFAULT_VARIANCE
) -> tuple[Components, Components]:
    """Majority and minority components under one common scaling."""
    features = [c for c in (features or numeric_columns(df)) if c != label]
    parts = [(name, q(label) == cls) for cls, name in ((0, "Majority_PC"), (1, "Minority_PC"))]
    return tuple(_fits(df, features, n_components, parts))


def class_pca_transform(df: DataFrame, fits: Sequence[Components], keep: Sequence[str] = KEYS) -> DataFrame:
    return pca_project(df, fits, keep)


def loadings_rows(spark, *fits: Components) -> DataFrame:
    """(class, component, feature, position, loading) rows of one or several fits."""
    rows_ = [
        (f.prefix, i + 1, name, j, float(f.loadings[i, j]))
        for f in fits
        for i in range(len(f.loadings))
        for j, name in enumerate(f.features)
    ]
    return spark.createDataFrame(rows_, "prefix STRING, component INT, feature STRING, position INT, loading DOUBLE")


def top_components(loadings: DataFrame, component: int = 1, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest absolute loading, smallest first."""
    ranked = loadings.where(F.col("component") == component).orderBy(F.abs("loading").desc(), "position").limit(n)
    return ranked.select("prefix", "feature", F.abs("loading").alias("abs_loading")).orderBy("abs_loading")


def top_rank_components(loadings: DataFrame, n: int = 40) -> DataFrame:
    """Features by their summed ranks over all components of all classes."""
    per = Window.partitionBy("prefix", "component")  # one row per feature
    ranked = loadings.withColumn("__r", F.row_number().over(per.orderBy(F.abs("loading").desc(), F.col("position").desc())))
    scored = ranked.withColumn("__s", F.count("*").over(per) - F.col("__r") + 1)
    return scored.groupBy("feature").agg(F.sum("__s").alias("score")).orderBy(F.col("score").desc(), "feature").limit(n)


def loadings_table(loadings: DataFrame, n: int = 40, components: int = 2) -> DataFrame:
    """Loadings of the top-ranked features in percent of each component's largest loading."""
    top = top_rank_components(loadings, n)
    per = Window.partitionBy("prefix", "component")
    shown = loadings.where(F.col("component") <= components)
    shown = shown.withColumn("percent", 100 * F.abs("loading") / F.max(F.abs("loading")).over(per))
    return shown.join(top, "feature").select("prefix", "component", "feature", "score", "percent")


EIGEN_SCHEMA = (
    f"{ENTITY} string, {DATE} date, n_rows int, eigenvalues array<double>, ratios array<double>, "
    "cumulative array<double>, components array<array<double>>"
)


def _eigen_rows(country, days, sizes, cov: np.ndarray) -> pd.DataFrame:
    """Decompositions of many covariance matrices at once."""
    values, vectors_ = np.linalg.eigh(cov)
    values, loadings = values[:, ::-1], np.swapaxes(vectors_, 1, 2)[:, ::-1]
    top = np.abs(loadings).argmax(axis=2)
    sign = np.sign(np.take_along_axis(loadings, top[:, :, None], axis=2))
    loadings = loadings * np.where(sign == 0, 1.0, sign)
    total = values.sum(axis=1, keepdims=True)
    ratios = np.where(total > 0, values / np.where(total > 0, total, 1.0), 0.0)
    columns = [values, ratios, np.cumsum(ratios, axis=1), loadings]
    found = dict(zip(("eigenvalues", "ratios", "cumulative", "components"), (c.tolist() for c in columns), strict=True))
    return pd.DataFrame({ENTITY: country, DATE: days, "n_rows": sizes, **found})


_NO_EIGEN = pd.DataFrame(columns=[ENTITY, DATE, "n_rows", "eigenvalues", "ratios", "cumulative", "components"])


def sliding_pca(
    df: DataFrame, features: Sequence[str] | None = None, window: int = 36, step: int = 12, prepare: dict | None = None
) -> DataFrame:
    """Eigen decomposition of every window of every country, keyed by the window's last date.

    Windows overlap, but no row is copied: a country's rows come to one task once, its windows are views of them, and all
    are prepared, each by its own values only as ``prepare_series`` would, and decomposed together. Moments of shared
    stretches cannot be added up, as filling, scale, trend and season are a window's own.
    """
    features = list(features or numeric_columns(df))
    options = {"standardise": True, "trend": "rolling_mean", "window_size": window, "period": 12, **(prepare or {})}
    rows_ = spread(df.select(*KEYS, *[q(c).cast("double").alias(c) for c in features]), ENTITY)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        x, days = pdf[features].to_numpy(dtype=float), pdf[DATE].to_numpy()
        if len(x) < window or window < 2 or len(features) < 2:
            return _NO_EIGEN
        views = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)[::step].swapaxes(1, 2)
        ready = prepare_windows(views, **options)
        ready = ready - ready.mean(axis=1, keepdims=True)
        cov = np.swapaxes(ready, 1, 2) @ ready / (window - 1)
        return _eigen_rows(key[0], days[window - 1 :: step], window, cov)

    return rows_.groupBy(ENTITY).applyInPandas(one, EIGEN_SCHEMA)


# Rows of the recursion that are worked out together.
RECURSION_BLOCK = 64


def recursive_moments(x: np.ndarray, forgetting: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance with forgetting after every row, started by the first row.

    With m the mean so far and S the mean of outer products so far, both decay alike, and the covariance is S - m m'.
    Both merge: what came before a block enters it with the weight that the block's rows leave over, so blocks are
    triangular products and only (weight, mean, matrix) is carried from one to the next.
    """
    n, width = x.shape
    shifted = x - x[0]  # keeps the two terms of the covariance small
    both = np.concatenate([shifted, (shifted[:, :, None] * shifted[:, None, :]).reshape(n, -1)], axis=1)
    steps = np.arange(RECURSION_BLOCK)
    gap = steps[:, None] - steps[None, :]
    kernel = np.where(gap >= 0, (1 - forgetting) * forgetting ** np.maximum(gap, 0), 0.0)
    out = np.empty_like(both)
    carried = both[0]
    out[0] = carried
    for at in range(1, n, RECURSION_BLOCK):
        block = both[at : at + RECURSION_BLOCK]
        own = kernel[: len(block), : len(block)] @ block
        out[at : at + len(block)] = own + forgetting ** (1 + steps[: len(block)])[:, None] * carried
        carried = out[at + len(block) - 1]
    mean, outer = out[:, :width], out[:, width:].reshape(n, width, width)
    return mean + x[0], outer - mean[:, :, None] * mean[:, None, :]


def dynamic_pca(
    df: DataFrame,
    features: Sequence[str] | None = None,
    forgetting: float = 0.95,
    min_samples: int = 10,
    every: int = 1,
    prepare: dict | None = None,
) -> DataFrame:
    """Recursive mean and covariance with forgetting; components after each ``every`` rows.

    Countries are independent; inside one the recursion is worked out in blocks.
    """
    features = list(features or numeric_columns(df))
    rows_ = spread(df.select(*KEYS, *[q(c) for c in features]), ENTITY)
    ready = prepare_series(rows_, features, **(prepare or {}))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        x, days = pdf[features].to_numpy(dtype=float), pdf[DATE].to_numpy()
        there = np.isfinite(x).all(axis=1)
        x, days = x[there], days[there]
        number = np.arange(1, len(x) + 1)
        shown = np.flatnonzero((number >= min_samples) & (number % every == 0))
        if not len(shown):
            return _NO_EIGEN
        cov = recursive_moments(x, forgetting)[1][shown]
        return _eigen_rows(key[0], days[shown], number[shown], (cov + np.swapaxes(cov, 1, 2)) / 2)

    return ready.groupBy(ENTITY).applyInPandas(one, EIGEN_SCHEMA)


def latest_components(eigen: DataFrame) -> DataFrame:
    """The last window of every country."""
    pick = lambda c: F.max_by(c, DATE).alias(c)
    return eigen.groupBy(ENTITY).agg(*[pick(c) for c in ("eigenvalues", "ratios", "cumulative", "components")])


def global_components(latest: DataFrame) -> DataFrame:
    """(component, ratio, cumulative, loadings): country components averaged by first variance share.

    First components are turned to the side of the most heavily weighted
    country before averaging; averages are scaled to unit length.
    """
    weight = F.col("ratios")[0]
    anchor = latest.agg(F.max_by(F.col("components")[0], F.struct(weight, F.col(ENTITY)))).scalar()
    rows_ = latest.select(
        weight.alias("w"), anchor.alias("anchor"), "ratios", F.posexplode("components").alias("i", "v")
    )
    dot = F.aggregate(F.zip_with("v", "anchor", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    turned = rows_.withColumn("s", F.when((F.col("i") == 0) & (dot < 0), -1.0).otherwise(1.0))
    cells = turned.select("i", "w", F.col("ratios")[F.col("i")].alias("ratio"), F.posexplode(F.transform("v", lambda x: x * F.col("s"))).alias("j", "x"))
    mean = cells.groupBy("i", "j").agg(
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("ratio")) / F.sum("w")).alias("ratio")
    )
    packed = mean.groupBy("i").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"), F.max("ratio").alias("ratio")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = packed.withColumn("n", norm).withColumn("loadings", F.when(F.col("n") > 1e-10, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")))
    upto = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row per component
    return unit.select((F.col("i") + 1).alias("component"), "ratio", F.sum("ratio").over(upto).alias("cumulative"), "loadings")


def select_components(components: DataFrame, n: float | int = DEFAULT_VARIANCE) -> DataFrame:
    """Leading components: a number, or the fewest reaching a share (all when none does)."""
    if isinstance(n, int):
        return components.where(F.col("component") <= n)
    before = F.col("cumulative") - F.col("ratio")
    return components.where((before < n) | (F.col("component") == 1))


def project_components(df: DataFrame, features: Sequence[str], latest: DataFrame, overall: DataFrame) -> DataFrame:
    """Rows on their own country's components, or on the global ones for unseen countries."""
    chosen = overall.agg(F.sort_array(F.collect_list(F.struct("component", "loadings"))).alias("g")).select(
        F.transform("g", lambda s: s["loadings"])
    ).scalar()
    x = F.array(*[q(c).cast("double") for c in features])
    joined = df.select(*KEYS, x.alias("x")).join(latest.select(ENTITY, "components"), ENTITY, "left").withColumn("g", chosen)
    used = F.when(F.col("components").isNotNull(), F.slice("components", 1, F.size("g"))).otherwise(F.col("g"))
    dot = lambda v: F.aggregate(F.zip_with("x", v, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    return joined.select(*KEYS, F.col("components").isNotNull().alias("own"), F.transform(used, dot).alias("scores"))


def spectral_features(eigen: DataFrame) -> DataFrame:
    """Concentration of each window's eigenvalues."""
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x)
    return eigen.withColumn("__t", total).select(
        ENTITY,
        DATE,
        (F.size(F.filter("cumulative", lambda c: c < 0.95)) + 1).alias("n_eigenvalues_95"),
        (F.col("eigenvalues")[0] / F.col("__t")).alias("eigenvalue_ratio"),
        (-F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x / F.col("__t") * F.log2(x / F.col("__t") + 1e-10))).alias("spectral_entropy"),
        F.col("ratios")[0].alias("pc1_ratio"),
        F.aggregate(F.slice("ratios", 1, 3), F.lit(0.0), lambda s, x: s + x).alias("first3_ratio"),
    )


def aggregate_eigen(eigen: DataFrame, by: str = "last") -> DataFrame:
    """Eigenvalues and cumulative shares of a country over its windows."""
    cells = eigen.select(ENTITY, DATE, F.posexplode(F.arrays_zip("eigenvalues", "cumulative")).alias("i", "e"))
    if by == "last":
        pick = lambda c: F.max_by(c, DATE)
    elif by in ("mean", "min", "max"):
        pick = {"mean": F.avg, "min": F.min, "max": F.max}[by]
    else:
        raise ValueError("by must be last, mean, min or max")
    return cells.groupBy(ENTITY, (F.col("i") + 1).alias("component")).agg(
        pick(F.col("e.eigenvalues")).alias("eigenvalue"), pick(F.col("e.cumulative")).alias("cumulative")
    )


# Matrix cells a task holds before it passes its sums on.
MAX_HELD_CELLS = 4_000_000


def class_separation(df: DataFrame, by: str, features: Sequence[str], label: str = "label") -> DataFrame:
    """Distance between class centroids of each category under its pooled covariance.

    Every task multiplies its own rows per category in one matrix product; the
    matrices are added in two steps, so that no task gets one from every other.
    Missing values leave the pairs they belong to, as in a covariance.
    """
    n = len(features)
    shift = np.array([v or 0.0 for v in df.agg(*[F.avg(q(c)) for c in features]).first()])
    rows_ = df.select(q(by).alias("by"), (q(label) == 1).alias("positive"), F.array(*[q(c).cast("double") for c in features]).alias("x"))

    out = lambda held: pd.DataFrame({"by": list(held), "cells": [c.tobytes() for c in held.values()]})

    def products(batches):
        held: dict = {}
        for batch in batches:
            for key, own in batch.groupby("by", dropna=False):
                x = np.array(own["x"].tolist(), dtype=float).reshape(len(own), n) - shift
                m = ~np.isnan(x)
                x0, one = np.where(m, x, 0.0), m.astype(float)
                yes = own["positive"].to_numpy(dtype=bool, na_value=False)[:, None]
                no = (own["positive"] == False).to_numpy(dtype=bool, na_value=False)[:, None]  # noqa: E712
                sums = [x0.T @ x0, x0.T @ one, one.T @ one, np.array([(x0 * s).sum(0) for s in (yes, no)]), np.array([(one * s).sum(0) for s in (yes, no)])]
                cells = np.concatenate([s.reshape(-1) for s in sums])
                held[key] = held[key] + cells if key in held else cells
            if len(held) * 3 * n * n > MAX_HELD_CELLS:  # however many categories there are
                yield out(held)
                held = {}
        yield out(held)

    kind = df.schema[by].dataType.simpleString()
    added = lambda pdf: np.sum([np.frombuffer(c) for c in pdf["cells"]], axis=0)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"by": pdf["by"].iloc[:1], "cells": [added(pdf).tobytes()]})

    def separation(pdf: pd.DataFrame) -> pd.DataFrame:
        xx, x1, n2, sums, counts = np.split(added(pdf), np.cumsum([n * n, n * n, n * n, 2 * n]))
        xx, x1, n2 = (m.reshape(n, n) for m in (xx, x1, n2))
        with np.errstate(invalid="ignore", divide="ignore"):
            cov = (xx - x1 * x1.T / n2) / (n2 - 1)
            means = (sums / counts).reshape(2, n)
        d = means[0] - means[1]
        bad = np.isnan(d).any() or not np.isfinite(cov).all()
        value = np.nan if bad else float(np.sqrt(max(d @ np.linalg.pinv(cov) @ d, 0.0)))
        return pd.DataFrame({by: pdf["by"].iloc[:1], "distance": [value]})

    parts = rows_.mapInPandas(products, f"by {kind}, cells binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    merged = parts.groupBy("by", "part").applyInPandas(merge, f"by {kind}, cells binary")
    found = merged.groupBy("by").applyInPandas(separation, f"`{by}` {kind}, distance double")
    return found.where(~F.isnan("distance"))


def top_categories(separations: DataFrame, by: str, n: int = 3) -> DataFrame:
    return separations.orderBy(F.col("distance").desc(), by).limit(n)


SPREADS = ("determinant", "trace", "frobenius", "range")


def component_spreads(df: DataFrame, columns: Sequence[str], method: str = "determinant") -> DataFrame:
    """Spread of every pair of component columns, from one aggregate row."""
    if method not in SPREADS:
        raise ValueError(f"method must be one of {SPREADS}")
    if len(columns) < 2:
        raise PanelError("at least two components are needed")
    pairs = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            a, b = q(columns[i]), q(columns[j])
            if method == "trace":
                value = F.var_pop(a) + F.var_pop(b)
            elif method == "range":
                value = (F.max(a) - F.min(a)) * (F.max(b) - F.min(b))
            else:
                va, vb, c = F.var_samp(a), F.var_samp(b), F.covar_samp(a, b)
                value = va * vb - c * c if method == "determinant" else F.sqrt(va * va + vb * vb + 2 * c * c)
            pairs.append(F.struct(F.lit(columns[i]).alias("first"), F.lit(columns[j]).alias("second"), value.alias("spread")))
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def choose_components(df: DataFrame, columns: Sequence[str], method: str = "determinant") -> DataFrame:
    """The pair of components with the largest spread."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("first")) * len(columns) + F.array_position(
        F.array(*map(F.lit, columns)), F.col("second")
    )
    return component_spreads(df, columns, method).orderBy(F.col("spread").desc(), place).limit(1)
