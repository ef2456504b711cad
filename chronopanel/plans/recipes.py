"""Declarative preparation recipes: a list of named steps applied lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chronopanel.operators import aggregate, fill, impute, select

STEPS = {
    "trim_timeseries": select.trim_timeseries,
    "drop_columns": select.drop_columns,
    "drop_static": select.drop_static,
    "rename_values": select.rename_values,
    "filter_countries": select.filter_countries,
    "resample": aggregate.resample,
    "complete_grid": aggregate.complete_grid,
    "forward_fill": fill.forward_fill,
    "zero_fill": fill.zero_fill,
    "backfill": fill.backfill,
    "knn_impute": impute.knn_impute,
    "knn_impute_staged": impute.knn_impute_staged,
    "forecast_fill": impute.forecast_fill,
    "regression_impute": impute.regression_impute,
}


def run_recipe(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> tuple[DataFrame, list[str]]:
    """Apply the steps in order; the log names each with its parameters."""
    log = []
    for name, params in steps:
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}; known: {sorted(STEPS)}")
        df = STEPS[name](df, **params)
        log.append(f"{name}({', '.join(f'{k}={v!r}' for k, v in params.items())})")
    return df, log
