"""Panel conventions shared by every operator.

A panel has one row per (Country, Date), ``Date`` being of DATE type, and any
number of numeric variables. NULL is the only missing value. Because keys are
unique and dates are calendar days, one series holds at most 366 rows per year
of history whatever the size of the table; windows over a single series are
therefore bounded. Work across series (per date, per column, over the whole
table) is never put in one window: it goes through partial aggregation or
through ``chronopanel.ordered``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "Country"
DATE = "Date"
KEYS = (ENTITY, DATE)

_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


class PanelError(ValueError):
    """A frame does not meet the panel contract."""


def series(by: Sequence[str] = (ENTITY,), order: str = DATE) -> WindowSpec:
    """Time-ordered window over one series."""
    return Window.partitionBy(*by).orderBy(order)


def rows(spec: WindowSpec, start: int, end: int = 0) -> WindowSpec:
    return spec.rowsBetween(start, end)


def expanding(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(by: Sequence[str] = (ENTITY,)) -> WindowSpec:
    return Window.partitionBy(*by)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = KEYS) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def data_columns(df: DataFrame, exclude: Iterable[str] = KEYS) -> list[str]:
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace or append columns in one projection, keeping column order."""
    kept = [exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns]
    added = [e.alias(c) for c, e in exprs.items() if c not in df.columns]
    return df.select(*kept, *added)


def q(name: str) -> Column:
    """Column by exact name; indicator names may contain dots."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing in a panel; Spark treats it as a value, so convert on read."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return replace_columns(df, {c: F.nanvl(q(c), F.lit(None).cast("double")) for c in floats})


def null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + q(c).isNull().cast("int")
    return total


def to_long(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide panel to (keys, variable, value)."""
    columns = list(columns or data_columns(df, keys))
    typed = df.select(*keys, *[q(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), [f"`{c}`" for c in columns], "variable", "value")


def to_wide(df: DataFrame, variables: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, variable, value) to one column per variable, by a single shuffle."""
    pivoted = df.groupBy(*keys).pivot("variable", list(variables) if variables else None)
    return pivoted.agg(F.first("value", ignorenulls=True))


def validate_panel(
    df: DataFrame,
    required: Sequence[str] = (),
    min_rows: int = 0,
    require_numeric: bool = True,
    check_keys: bool = False,
) -> DataFrame:
    """Fail early when keys, columns, numeric variables or rows are missing.

    Schema checks cost nothing. The row minimum and key uniqueness each run one
    partially aggregated job and are only done when asked for.
    """
    missing = [c for c in (*KEYS, *required) if c not in df.columns]
    if missing:
        raise PanelError(f"missing columns: {missing}")
    if require_numeric and not numeric_columns(df):
        raise PanelError("no numeric variables")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise PanelError(f"fewer than {min_rows} rows")
    if check_keys and df.where(F.col(DATE).isNotNull()).groupBy(*KEYS).count().where("count > 1").limit(1).count():
        raise PanelError("duplicate (Country, Date) keys; resolve them with aggregate.dedupe")
    return df


def renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, to cogroup frames of shared origin."""
    return df.toDF(*df.columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by key into the session's shuffle partitions, none of them merged later.

    For work that is heavy per row: adaptive execution would merge partitions
    by their bytes and leave such work on a few cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names.

    A folder of our own is set only for a local master that names none; on a
    cluster the shared folder has to come from ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise PanelError("set spark.checkpoint.dir to a shared folder")
            import tempfile

            folder = tempfile.mkdtemp(prefix="chronopanel-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
