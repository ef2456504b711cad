"""Encodings and scalers: statistics are fitted on one frame and applied to any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.ordered import exact_quantiles, rank_distinct
from chronopanel.schema import DATE, ENTITY, PanelError, data_columns, q, replace_columns, to_long


def fit_categories(df: DataFrame, column: str, limit: int | None = 2_000) -> list[str]:
    """Sorted categories. Each becomes a column, so more than ``limit`` are an error; None sets no limit.

    For columns with very many categories use ``one_hot``, which is sparse.
    """
    distinct = df.select(column).where(q(column).isNotNull()).distinct()
    found = [r[0] for r in (distinct if limit is None else distinct.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise PanelError(f"{column} has more than {limit} categories")
    return sorted(found)


def one_hot(df: DataFrame, column: str, name: str | None = None) -> tuple[DataFrame, PipelineModel]:
    """One sparse vector column with a place per category, unseen and missing ones all 0, and the fitted encoder."""
    name = name or f"{column}_one_hot"
    index = StringIndexer(inputCol=column, outputCol="__index", stringOrderType="alphabetAsc", handleInvalid="keep")
    encoder = OneHotEncoder(inputCol="__index", outputCol=name, dropLast=True)
    fitted = Pipeline(stages=[index, encoder]).fit(df)
    return fitted.transform(df).drop("__index"), fitted


def dummy_transform(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 column per stored category; unseen categories are all 0."""
    return df.select("*", *[q(column).eqNullSafe(c).cast("int").alias(f"{column}_{c}") for c in categories])


def dummy_fit(df: DataFrame, column: str, limit: int | None = 2_000) -> tuple[DataFrame, list[str]]:
    categories = fit_categories(df, column, limit)
    return dummy_transform(df, column, categories), categories


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """0-based position of the value among the sorted distinct values.

    Distinct values are ranked in blocks, so a column with very many categories
    never has to be sorted in one place.
    """
    name = name or f"{column}_code"
    codes = rank_distinct(df.select(column).where(q(column).isNotNull()).distinct(), column, name)
    return df.join(codes, column, "left")


def _stats_row(df: DataFrame, aggregates: Mapping[str, Column]) -> dict:
    return df.agg(*[e.alias(k) for k, e in aggregates.items()]).first().asDict() if aggregates else {}


def fit_standard(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero deviation scales by 1."""
    columns = list(columns or data_columns(df))
    row = _stats_row(
        df,
        {f"m_{i}": F.avg(q(c)) for i, c in enumerate(columns)} | {f"s_{i}": F.stddev_pop(q(c)) for i, c in enumerate(columns)},
    )
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def fit_robust(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """Exact median and interquartile range per column; a zero range scales by 1."""
    columns = list(columns or data_columns(df))
    stats = exact_quantiles(to_long(df, columns, keys=[]), ["variable"], "value", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    found = {r["variable"]: (r["mid"], (r["hi"] - r["lo"]) or 1.0) for r in stats.collect()}  # one row per column
    return {c: found.get(c, (0.0, 1.0)) for c in columns}


def fit_minmax(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """Minimum and range per column; a zero range scales by 1."""
    columns = list(columns or data_columns(df))
    row = _stats_row(
        df,
        {f"lo_{i}": F.min(q(c)) for i, c in enumerate(columns)} | {f"hi_{i}": F.max(q(c)) for i, c in enumerate(columns)},
    )
    out = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        out[c] = (0.0, 1.0) if lo is None else (float(lo), float(hi - lo) or 1.0)
    return out


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - center) / spread with fitted statistics."""
    return replace_columns(df, {c: (q(c) - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in fitted.items()})


def unscale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {c: q(c) * F.lit(float(s)) + F.lit(float(m)) for c, (m, s) in fitted.items()})


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    return scale(df, fit_standard(df if train is None else train, columns))


def robust_scale(df: DataFrame, columns: Sequence[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    return scale(df, fit_robust(df if train is None else train, columns))


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    return scale(df, fit_minmax(df if train is None else train, columns))


def temporal_features(df: DataFrame) -> DataFrame:
    """Country code, days since the first date, year and month."""
    coded = label_encode(df, ENTITY, "country_code")
    first = df.agg(F.min(DATE)).scalar()
    return coded.withColumns(
        {
            "days_since_baseline": F.datediff(DATE, first),
            "year": F.year(DATE),
            "month": F.month(DATE),
        }
    )
