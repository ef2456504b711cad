"""Projections, filters and predicates on panels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.schema import DATE, ENTITY, KEYS, data_columns, null_count, numeric_columns, q, replace_columns
from chronopanel.functions.scalars import finite_or_null

# Country names that differ between sources.
COUNTRY_NAMES = {
    "Congo Dem. Rep.": "Congo, Dem. Rep.",
    "Congo Rep.": "Congo, Rep.",
    "Egypt, Arab Rep.": "Egypt",
    "Egypt Arab Rep.": "Egypt",
    "Gambia The": "Gambia, The",
    "Iran Islamic Rep.": "Iran, Islamic Rep.",
    "Taiwan China": "Taiwan, China",
    "Turkiye": "Turkey",
    "Venezuela RB": "Venezuela, RB",
    "Viet Nam": "Vietnam",
    "Yemen Rep.": "Yemen, Rep.",
    "China (People's Republic of)": "China",
    "Türkiye": "Turkey",
}

# ISO alpha-3 codes of the two market groups.
DEVELOPED_MARKETS = [
    "AUS", "BEL", "CAN", "CHE", "DEU", "DNK", "ESP", "FIN", "FRA", "GBR", "ITA", "JPN", "NLD", "NOR", "PRT", "SWE", "USA",
]
EMERGING_MARKETS = [
    "AFG", "AGO", "ATG", "AZE", "BGD", "BRB", "BLZ", "BOL", "BRA", "CAF", "TCD", "CHL", "CHN", "COL", "COD", "COG",
    "CRI", "DJI", "DOM", "ECU", "EGY", "SLV", "GNQ", "ERI", "SWZ", "GMB", "GHA", "GTM", "HTI", "HND", "IND", "IDN",
    "IRN", "KAZ", "KEN", "LAO", "LBN", "LSO", "LBR", "LBY", "MWI", "MYS", "MLI", "MUS", "MEX", "MNG", "MAR", "MMR",
    "NAM", "NPL", "NIC", "NGA", "PAK", "PRY", "PER", "PHL", "SEN", "SLE", "ZAF", "LKA", "SUR", "SYR", "TWN", "TJK",
    "THA", "TUN", "TUR", "URY", "UZB", "VEN", "VNM", "YEM", "ZMB", "ZWE",
]


def rename_values(df: DataFrame, column: str = ENTITY, mapping: Mapping[str, str] | DataFrame = COUNTRY_NAMES) -> DataFrame:
    """Harmonise the values of one column; unmapped values stay.

    A mapping table has columns (from, to); a dict becomes a constant CASE.
    """
    if isinstance(mapping, DataFrame):
        renames = mapping.select(F.col("from").alias(column), F.col("to").alias("__to"))
        joined = df.join(renames, column, "left")
        return replace_columns(joined, {column: F.coalesce("__to", q(column))}).select(*df.columns)
    return df.replace(dict(mapping), subset=[column])


def completeness_by_column(df: DataFrame) -> dict[str, float]:
    """Share of filled cells of every column: one aggregate row, whatever the table size."""
    row = df.agg(*[F.avg(q(c).isNotNull().cast("double")).alias(c) for c in df.columns]).first()
    return row.asDict()


def drop_columns(df: DataFrame, columns: Sequence[str] = (), completeness: float = 0.6) -> DataFrame:
    """Drop named columns, then every column filled less than ``completeness`` (0 disables)."""
    df = df.drop(*columns)
    if completeness > 0:
        filled = completeness_by_column(df)
        df = df.drop(*[c for c in df.columns if filled[c] is not None and filled[c] < completeness])
    return df


def drop_variables(long: DataFrame, completeness: float = 0.6) -> DataFrame:
    """Same rule on the long form, fully inside Spark: keep the well-filled variables."""
    kept = (
        long.groupBy("variable")
        .agg((F.count("value") / F.count("*")).alias("__filled"))
        .where(F.col("__filled") >= completeness)
        .select("variable")
    )
    return long.join(kept, "variable", "left_semi")


def select_columns(
    df: DataFrame,
    prefix: str = "",
    suffix: str = "",
    predicate: Callable[[str], bool] | None = None,
    max_abs_mean: float | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Keep keys and the variables whose name (or mean) qualifies."""
    chosen = [c for c in data_columns(df, keys) if c.startswith(prefix) and c.endswith(suffix)]
    if predicate is not None:
        chosen = [c for c in chosen if predicate(c)]
    if max_abs_mean is not None:
        numeric = set(numeric_columns(df, keys))
        chosen = [c for c in chosen if c in numeric]
        means = df.agg(*[F.avg(q(c)).alias(c) for c in chosen]).first() if chosen else {}
        chosen = [c for c in chosen if means[c] is not None and abs(means[c]) < max_abs_mean]
    return df.select(*keys, *[q(c) for c in chosen])


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project both frames to their shared columns, in name order."""
    shared = sorted(set(a.columns) & set(b.columns))
    names = [q(c) for c in shared]
    return a.select(*names), b.select(*names)


def filter_countries(
    df: DataFrame,
    include: Sequence[str] | DataFrame | None = None,
    exclude: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    if include is not None:
        df = (
            df.join(include.select(ENTITY).distinct(), ENTITY, "left_semi")
            if isinstance(include, DataFrame)
            else df.where(F.col(ENTITY).isin(list(include)))
        )
    if exclude is not None:
        df = (
            df.join(exclude.select(ENTITY).distinct(), ENTITY, "left_anti")
            if isinstance(exclude, DataFrame)
            else df.where(~F.col(ENTITY).isin(list(exclude)))
        )
    return df


def filter_date_range(df: DataFrame, start, end) -> DataFrame:
    """Start inclusive, end exclusive."""
    return df.where((F.col(DATE) >= F.lit(start).cast("date")) & (F.col(DATE) < F.lit(end).cast("date")))


def clip_period(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends inclusive; a missing end leaves that side open."""
    if start is not None:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(DATE) <= F.lit(end).cast("date"))
    return df


def trim_timeseries(df: DataFrame, completeness: float = 0.4, before_year: int = 2024) -> DataFrame:
    """Drop everything before the first sufficiently filled row, in (Date, Country) order."""
    limit = (1 - completeness) * len(df.columns)
    position = F.struct(DATE, ENTITY)
    first = df.where(null_count(df.columns) < F.lit(limit)).agg(F.min(position)).scalar()
    return df.where((position >= first) & (F.year(DATE) < before_year))


def drop_static_columns(df: DataFrame) -> DataFrame:
    """Drop columns with at most two distinct values, NULL counting as one.

    Distinct counts are not needed: the extremes, whether NULLs occur, and
    whether any value lies strictly between the extremes decide it. That takes
    two mergeable passes instead of one distinct set per column.
    """
    first = df.agg(
        *[F.min(q(c)).alias(f"lo_{i}") for i, c in enumerate(df.columns)],
        *[F.max(q(c)).alias(f"hi_{i}") for i, c in enumerate(df.columns)],
        *[F.max(q(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
    ).first()
    known: dict[str, int] = {}
    open_columns: list[tuple[int, str]] = []
    for i, c in enumerate(df.columns):
        lo, hi, has_null = first[f"lo_{i}"], first[f"hi_{i}"], bool(first[f"null_{i}"])
        known[c] = (0 if lo is None else 1 if lo == hi else 2) + int(has_null)
        if known[c] == 2 and lo is not None and lo != hi:
            open_columns.append((i, c))
    if open_columns:
        lits = {i: (F.lit(first[f"lo_{i}"]), F.lit(first[f"hi_{i}"])) for i, _ in open_columns}
        inner = df.agg(
            *[F.max((q(c) > lits[i][0]) & (q(c) < lits[i][1])).alias(f"mid_{i}") for i, c in open_columns]
        ).first()
        for i, c in open_columns:
            known[c] += int(bool(inner[f"mid_{i}"]))
    return df.drop(*[c for c in df.columns if known[c] <= 2])


def drop_static_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose variables hold at most one distinct non-null value."""
    values = F.array(*[q(c).cast("double") for c in data_columns(df)])
    return df.where(F.size(F.array_distinct(F.array_compact(values))) > 1)


def drop_static(df: DataFrame) -> DataFrame:
    return drop_static_rows(drop_static_columns(df))


def filter_topics(df: DataFrame, topics: Sequence[str], column: str = "topics") -> DataFrame:
    """Keep indicators naming a wanted topic; keep all when no indicator has topics."""
    text = F.coalesce(q(column), F.lit(""))
    wanted = F.lit(False)
    for t in topics:
        wanted = wanted | text.contains(t)
    any_topic = df.agg(F.coalesce(F.max(q(column) != ""), F.lit(False))).scalar()
    return df.where(wanted | ~any_topic)


def market_subset(df: DataFrame, subset: str, column: str = "alpha-3") -> DataFrame:
    """Developed or emerging markets; the emerging side also shortens Egypt's name."""
    if subset == "developed":
        return df.where(q(column).isin(DEVELOPED_MARKETS))
    out = df.where(q(column).isin(EMERGING_MARKETS))
    return out.replace({"Egypt, Arab Rep.": "Egypt"}, subset=[ENTITY]) if ENTITY in df.columns else out


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """Infinite and NaN values become missing."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return replace_columns(df, {c: finite_or_null(q(c)) for c in floats})


def drop_others(df: DataFrame, column: str = "bucket_name") -> DataFrame:
    """Drop the 'Others' bucket; rows without a bucket name stay."""
    return df.where(~q(column).eqNullSafe("Others"))


def price_pivot(df: DataFrame, fields: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """(Date, ticker, Open, High, ...) to one ``ticker.field`` column per pair."""
    long = df.unpivot([DATE, "ticker"], list(fields), "field", "value")
    named = long.withColumn("name", F.concat_ws(".", "ticker", "field"))
    wanted = [f"{t}.{f}" for t in tickers for f in fields]
    return named.groupBy(DATE).pivot("name", wanted).agg(F.first("value", ignorenulls=True))


def order_panel(df: DataFrame) -> DataFrame:
    """Rows by country and date, for output only: operators order their own series."""
    return df.orderBy(*[c for c in KEYS if c in df.columns])
