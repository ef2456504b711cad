"""Readers: landed files to DataFrames with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.operators.labels import crisis_columns, mark_crises
from chronopanel.schema import DATE, ENTITY, KEYS, nan_to_null, q, replace_columns, validate_panel

# Index columns left behind by other writers, name prefix.
INDEX_COLUMN_PREFIX = "__index_level_"
# Country codes in the macro-history file and their names.
MACRO_HISTORY_NAMES = {"USA": "United States", "UK": "United Kingdom"}

CATALOGUE_SCHEMA = "id STRING, name STRING, sourceNote STRING, topics STRING, source_id STRING"
MASTER_SCHEMA = "name STRING, `alpha-3` STRING, region STRING"
OBSERVATION_SCHEMA = "country STRUCT<value: STRING>, date STRING, indicator STRUCT<id: STRING>, value STRING"
SERIES_DOC_SCHEMA = (
    "labels MAP<STRING, STRING>, series_code STRING, series_name STRING, "
    "dimensions STRUCT<LOCATION: STRING, SUBJECT: STRING, MEASURE: STRING, FREQUENCY: STRING>, "
    "period_start_day ARRAY<STRING>, value ARRAY<DOUBLE>"
)


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = KEYS) -> DataFrame:
    """Drop columns holding no value at all; one partially aggregated pass."""
    candidates = [c for c in df.columns if c not in keep]
    if not candidates:
        return df
    filled = df.agg(F.count("*").alias("__rows"), *[F.count(q(c)).alias(c) for c in candidates]).first()
    if filled["__rows"] == 0:
        return df
    return df.drop(*[c for c in candidates if filled[c] == 0])


def tidy_panel(df: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Coerce ``Date`` to DATE, drop index leftovers and empty columns, make NaN missing."""
    df = df.drop(*[c for c in df.columns if c.startswith(INDEX_COLUMN_PREFIX)])
    if isinstance(df.schema[DATE].dataType, T.StringType):
        df = df.withColumn(DATE, F.to_date(F.try_to_timestamp(F.col(DATE))))
    else:
        df = df.withColumn(DATE, F.to_date(DATE))
    df = nan_to_null(df)
    return drop_empty_columns(df) if drop_empty else df


def read_panel(
    spark: SparkSession, path: str, subset: str | None = None, split: str | None = None, check_keys: bool = False
) -> DataFrame:
    """Read a stored panel; ``subset`` and ``split`` prune partitions.

    Unique (Country, Date) keys are what bounds the length of a series, and with
    it every per-series window; ``check_keys`` reads the table once more to make
    sure of them.
    """
    df = spark.read.parquet(path)
    for column, wanted in (("subset", subset), ("split", split)):
        if wanted is not None and column in df.columns:
            df = df.where(F.col(column) == wanted).drop(column)
    panel = tidy_panel(df)
    return validate_panel(panel, require_numeric=False, check_keys=True) if check_keys else panel


def read_catalogue(spark: SparkSession, path: str, schema: str = CATALOGUE_SCHEMA) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=False)


def read_country_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=MASTER_SCHEMA, header=True, escape='"')


def flatten_observations(df: DataFrame) -> DataFrame:
    """Nested indicator records to (Country, Year, Series, value); '' and null are missing."""
    return df.select(
        F.col("country.value").alias(ENTITY),
        F.col("date").cast("int").alias("Year"),
        F.col("indicator.id").alias("Series"),
        F.expr("try_cast(nullif(value, '') AS DOUBLE)").alias("value"),
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return flatten_observations(spark.read.schema(OBSERVATION_SCHEMA).json(path))


def flatten_series(df: DataFrame) -> DataFrame:
    """Series documents with parallel arrays to (Country, Period, variable, value) rows.

    The country is the label of the LOCATION code; the variable is named
    SUBJECT.MEASURE.FREQUENCY.
    """
    name = F.concat_ws(".", "dimensions.SUBJECT", "dimensions.MEASURE", "dimensions.FREQUENCY")
    return (
        df.select(
            F.try_element_at("labels", F.col("dimensions.LOCATION")).alias(ENTITY),
            name.alias("variable"),
            F.explode(F.arrays_zip(F.col("period_start_day").alias("period"), F.col("value").alias("value"))).alias("o"),
        )
        .select(ENTITY, F.to_date("o.period").alias("Period"), "variable", F.nanvl("o.value", F.lit(None).cast("double")).alias("value"))
    )


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return flatten_series(spark.read.schema(SERIES_DOC_SCHEMA).json(path))


def tidy_macro_history(df: DataFrame) -> DataFrame:
    """Drop crisis columns, rename keys, date the year, recode country names."""
    df = df.drop(*[c for c in df.columns if c.startswith("crisisJST")])
    df = df.withColumnsRenamed({"year": DATE, "country": ENTITY})
    df = df.withColumn(DATE, F.make_date(F.col(DATE).cast("int"), F.lit(1), F.lit(1)))
    return df.replace(MACRO_HISTORY_NAMES, subset=[ENTITY])


def read_macro_history(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return tidy_macro_history(spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None))


def read_crises(
    spark: SparkSession, path: str, crisis_types: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """Annual crisis flags with ``is_crisis`` set when any flag is 1."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    return mark_crises(df, crisis_types if crisis_types is not None else crisis_columns(df))


def normalise_null_tokens(df: DataFrame) -> DataFrame:
    """String spellings of a missing value become NULL."""
    # Spellings of a missing value.
    tokens = ["NA", "N/A", "", "nan"]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return replace_columns(df, {c: F.when(~q(c).isin(tokens), q(c)) for c in strings})
