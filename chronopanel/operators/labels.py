"""Crisis flags, run-up labels and recovery periods."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalars import add_years
from chronopanel.schema import DATE, ENTITY, q, series


def crisis_columns(df: DataFrame) -> list[str]:
    """Columns whose name mentions a crisis."""
    return [c for c in df.columns if re.search("crisis|crises", c, re.IGNORECASE)]


def mark_crises(df: DataFrame, crisis_types: Sequence[str] | None = None) -> DataFrame:
    """``is_crisis`` is true when any crisis flag equals 1."""
    flag = F.lit(False)
    for c in crisis_types if crisis_types is not None else crisis_columns(df):
        flag = flag | (F.coalesce(q(c).cast("double"), F.lit(0.0)) == 1.0)
    return df.withColumn("is_crisis", flag)


def label_lookback(df: DataFrame, lookback: int = 2, recovery: int = 2, order: str = "Year") -> DataFrame:
    """Flag the rows before and after crisis rows.

    ``label``: a crisis follows within ``lookback`` rows and the row is none.
    ``drop``: a crisis precedes within ``recovery`` rows.
    """
    w = series(order=order)
    soon = F.max("is_crisis").over(w.rowsBetween(1, lookback)) if lookback > 0 else F.lit(False)
    recent = F.max("is_crisis").over(w.rowsBetween(-recovery, -1)) if recovery > 0 else F.lit(False)
    return df.select(
        "*",
        (F.coalesce(soon, F.lit(False)) & ~F.col("is_crisis")).cast("int").alias("label"),
        F.coalesce(recent, F.lit(False)).alias("drop"),
    )


def create_labels(df: DataFrame, lookback: int = 2, recovery: int = 2) -> DataFrame:
    """(Country, Year) pairs labelled positive and not in recovery."""
    marked = df if "is_crisis" in df.columns else mark_crises(df)
    flagged = label_lookback(marked, lookback, recovery)
    return flagged.where((F.col("label") == 1) & ~F.col("drop")).select(ENTITY, F.col("Year").cast("int").alias("Year"))


def union_labels(*labels: DataFrame) -> DataFrame:
    out = labels[0].select(ENTITY, "Year")
    for other in labels[1:]:
        out = out.unionByName(other.select(ENTITY, "Year"))
    return out.distinct()


def build_labels(df: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """Label 1 when (Country, year of Date) is listed, else 0."""
    listed = labels.select(ENTITY, F.col("Year").alias("__year")).distinct().withColumn("__hit", F.lit(1))
    keyed = df.withColumn("__year", F.year(DATE))
    return (
        keyed.join(listed, [ENTITY, "__year"], "left")
        .select(*[q(c) for c in df.columns if c != name], F.coalesce("__hit", F.lit(0)).alias(name))
    )


def drop_recovery(df: DataFrame, years: int = 4, label: str = "label") -> DataFrame:
    """Drop the years after a positive row, up to the next positive row."""
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(label) == 1, F.col(DATE)), ignorenulls=True).over(before)
    return (
        df.withColumn("__p", last)
        .where((F.col(label) == 1) | F.col("__p").isNull() | (F.col(DATE) >= add_years(F.col("__p"), years)))
        .drop("__p")
    )


def positive_periods(df: DataFrame, flag: str = "y_pred", gap: int = 32) -> DataFrame:
    """Runs of positive rows; a gap of more than ``gap`` days starts a new run."""
    w = series()
    positive = df.where(F.col(flag) == 1).select(ENTITY, DATE)
    opens = F.coalesce(F.datediff(DATE, F.lag(DATE).over(w)) > gap, F.lit(True)).cast("int")
    runs = positive.withColumn("__open", opens).withColumn(
        "period", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy(ENTITY, "period").agg(F.min(DATE).alias("start_date"), F.max(DATE).alias("end_date"))
