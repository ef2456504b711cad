"""Gap filling and masks over the sparse supplier panel."""

from __future__ import annotations

from chronopanel.operators import fill
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import KEYS

SP = with_views("sp")
COLUMNS = ["quantity", "revenue", "lines"]
UPTO = "(PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def each(pattern: str) -> str:
    return ", ".join(pattern.replace("@", c) for c in COLUMNS)


@query("win23_ffill_all", f"{SP} SELECT Country, Date, {each('last_value(@ IGNORE NULLS) OVER u AS @')} FROM sp WINDOW u AS {UPTO}")
def ffill_all(spark, sf):
    return fill.ffill_all(views.sparse(spark, sf))


NUMBERED = f"r AS (SELECT *, row_number() OVER (PARTITION BY Country ORDER BY Date) AS rn FROM sp)"


@query(
    "win24_forward_fill",
    f"""{SP}, {NUMBERED} SELECT Country, Date, {each('CASE WHEN @ IS NULL AND rn - max(CASE WHEN @ IS NOT NULL THEN rn END) OVER u <= 2 THEN last_value(@ IGNORE NULLS) OVER u ELSE @ END AS @')}
FROM r WINDOW u AS {UPTO}""",
)
def forward_fill(spark, sf):
    return fill.forward_fill(views.sparse(spark, sf), 2, latest_only=False)


@query(
    "win25_forward_fill_latest",
    f"""{SP}, {NUMBERED} SELECT Country, Date, {each('CASE WHEN @ IS NULL AND rn > max(CASE WHEN @ IS NOT NULL THEN rn END) OVER (PARTITION BY Country) AND rn - max(CASE WHEN @ IS NOT NULL THEN rn END) OVER u <= 3 THEN last_value(@ IGNORE NULLS) OVER u ELSE @ END AS @')}
FROM r WINDOW u AS {UPTO}""",
)
def forward_fill_latest(spark, sf):
    return fill.forward_fill(views.sparse(spark, sf), 3)


@query(
    "win26_zero_fill",
    f"{SP} SELECT Country, Date, {each('CASE WHEN count(@) OVER p = 0 OR max(abs(@)) OVER p = 0 THEN 0 ELSE @ END AS @')} FROM sp WINDOW p AS (PARTITION BY Country)",
)
def zero_fill(spark, sf):
    return fill.zero_fill(views.sparse(spark, sf))


LEADING = "Date < min(CASE WHEN @ IS NOT NULL THEN Date END) OVER (PARTITION BY Country)"


def backfill_sql(value: str) -> str:
    return f"{SP}{{extra}} SELECT sp.Country, sp.Date, {each(f'CASE WHEN {LEADING.replace("Date", "sp.Date").replace("@", "sp.@")} THEN {value} ELSE sp.@ END AS @')} FROM sp{{join}}"


@query("win27_backfill_zero", backfill_sql("0").format(extra="", join=""))
def backfill_zero(spark, sf):
    return fill.backfill(views.sparse(spark, sf), "zero")


STAT_JOIN = " JOIN g ON g.Date = sp.Date"


@query(
    "win28_backfill_mean",
    backfill_sql("g.@").format(extra=f", g AS (SELECT Date, {each('avg(@) AS @')} FROM sp GROUP BY 1)", join=STAT_JOIN),
    approx=COLUMNS,
)
def backfill_mean(spark, sf):
    return fill.backfill(views.sparse(spark, sf), "mean")


@query(
    "win28_backfill_median",
    backfill_sql("g.@").format(extra=f", g AS (SELECT Date, {each('median(@) AS @')} FROM sp GROUP BY 1)", join=STAT_JOIN),
    approx=COLUMNS,
)
def backfill_median(spark, sf):
    return fill.backfill(views.sparse(spark, sf), "median")


MODES = ", ".join(
    f"m_{c} AS (SELECT Date, {c} FROM (SELECT Date, {c}, count(*) AS n FROM sp WHERE {c} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY Date ORDER BY n DESC, {c}) = 1)"
    for c in COLUMNS
)


@query(
    "win28_backfill_mode",
    backfill_sql("g.@").format(
        extra=f", {MODES}, g AS (SELECT d.Date, {each('m_@.@')} FROM (SELECT DISTINCT Date FROM sp) d "
        + " ".join(f"LEFT JOIN m_{c} ON m_{c}.Date = d.Date" for c in COLUMNS)
        + ")",
        join=STAT_JOIN,
    ),
)
def backfill_mode(spark, sf):
    return fill.backfill(views.sparse(spark, sf), "mode")


def mask_sql(before: bool, after: bool) -> str:
    first = "min(CASE WHEN @ IS NOT NULL THEN Date END) OVER p"
    last = "max(CASE WHEN @ IS NOT NULL THEN Date END) OVER p"
    test = "@ IS NULL AND count(@) OVER p >= 2"
    test += "" if before else f" AND Date > {first}"
    test += "" if after else f" AND Date < {last}"
    return f"{SP} SELECT Country, Date, {each(f'coalesce({test}, false) AS @')} FROM sp WINDOW p AS (PARTITION BY Country)"


@query("win29_imputation_mask", mask_sql(False, False))
def mask(spark, sf):
    return _flags(fill.imputation_mask(views.sparse(spark, sf)))


@query("win29_imputation_mask_before", mask_sql(True, False))
def mask_before(spark, sf):
    return _flags(fill.imputation_mask(views.sparse(spark, sf), include_before=True))


@query("win29_imputation_mask_all", mask_sql(True, True))
def mask_all(spark, sf):
    return _flags(fill.imputation_mask(views.sparse(spark, sf), include_before=True, include_after=True))


def _flags(df):
    from pyspark.sql import functions as F

    return df.select(*KEYS, *[F.coalesce(c, F.lit(False)).alias(c) for c in COLUMNS])
