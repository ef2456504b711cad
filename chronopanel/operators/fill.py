"""Gap filling inside and across series, and imputation masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.aggregate import global_by_date
from chronopanel.schema import DATE, ENTITY, cut_lineage, expanding, q, replace_columns, series, to_long, to_wide, whole

BACKFILLS = ("mean", "median", "mode", "zero")


def _columns(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str]) -> list[str]:
    return [c for c in (columns or df.columns) if c in df.columns and c not in (*by, DATE)]


def ffill_all(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Carry the last value forward without limit."""
    w = expanding(series(by))
    return replace_columns(df, {c: F.last(q(c), ignorenulls=True).over(w) for c in _columns(df, columns, by)})


def forward_fill(
    df: DataFrame,
    n: int | None = None,
    latest_only: bool = True,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (ENTITY,),
) -> DataFrame:
    """Carry values forward over at most ``n`` consecutive gaps.

    ``latest_only`` fills nothing but the tail after a series' last value.
    """
    names = _columns(df, columns, by)
    w = series(by)
    numbered = df.withColumn("__rn", F.row_number().over(w))
    exprs: dict[str, Column] = {}
    for c in names:
        valid_rn = F.when(q(c).isNotNull(), F.col("__rn"))
        carried = F.last(q(c), ignorenulls=True).over(expanding(w))
        distance = F.col("__rn") - F.last(valid_rn, ignorenulls=True).over(expanding(w))
        allowed = F.lit(True) if n is None else distance <= n
        if latest_only:
            allowed = allowed & (F.col("__rn") > F.max(valid_rn).over(whole(by)))
        exprs[c] = F.when(q(c).isNull() & allowed, carried).otherwise(q(c))
    return replace_columns(numbered, exprs).drop("__rn")


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Series never reported, or reported only as 0, become 0 throughout."""
    w = whole(by)
    exprs = {}
    for c in _columns(df, columns, by):
        silent = F.coalesce(F.max(F.abs(q(c))).over(w), F.lit(0.0)) == 0
        exprs[c] = F.when(silent, F.lit(0.0)).otherwise(q(c))
    return replace_columns(df, exprs)


def _is_leading(c: str, by: Sequence[str]) -> Column:
    first = F.min(F.when(q(c).isNotNull(), F.col(DATE))).over(whole(by))
    return F.col(DATE) < first


def backfill(
    df: DataFrame, fill: str = "mean", columns: Sequence[str] | None = None, by: Sequence[str] = (ENTITY,)
) -> DataFrame:
    """Fill the cells before a series' first value with 0 or a statistic of that date.

    The statistic is taken across countries from the unfilled panel. Series
    without any value are left alone. For the median, which takes several
    passes, the panel is checkpointed first.
    """
    if fill not in BACKFILLS:
        raise ValueError(f"fill must be one of {BACKFILLS}")
    names = _columns(df, columns, by)
    if fill == "zero":
        return replace_columns(df, {c: F.when(_is_leading(c, by), F.lit(0.0)).otherwise(q(c)) for c in names})
    if ENTITY not in df.columns:
        return df
    if fill == "median":
        df = cut_lineage(df)
    if fill == "mean":
        stats = df.groupBy(DATE).agg(*[F.avg(q(c)).alias(f"__g_{c}") for c in names])
    else:
        long = global_by_date(to_long(df, names), fill).withColumnRenamed("stat", "value")
        wide = to_wide(long, names, keys=[DATE])
        stats = wide.select(DATE, *[q(c).alias(f"__g_{c}") for c in names])
    joined = df.join(stats, DATE, "left")
    exprs = {c: F.when(_is_leading(c, by), q(f"__g_{c}")).otherwise(q(c)) for c in names}
    return replace_columns(joined, exprs).select(*[q(c) for c in df.columns])


def imputation_mask(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    include_before: bool = False,
    include_after: bool = False,
    by: Sequence[str] = (ENTITY,),
) -> DataFrame:
    """Boolean frame of the cells to impute.

    Interior gaps always count, leading and trailing ones on request. Series
    with fewer than two values are never imputed.
    """
    w = whole(by)
    exprs = []
    for c in _columns(df, columns, by):
        valid = F.when(q(c).isNotNull(), F.col(DATE))
        first, last = F.min(valid).over(w), F.max(valid).over(w)
        wanted = F.lit(True)
        if not include_before:
            wanted = wanted & (F.col(DATE) > first)
        if not include_after:
            wanted = wanted & (F.col(DATE) < last)
        exprs.append((q(c).isNull() & (F.count(q(c)).over(w) >= 2) & wanted).alias(c))
    return df.select(*by, DATE, *exprs)
