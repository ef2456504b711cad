"""Aggregations, resampling, grids, deduplication and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalars import (
    check_frequency,
    dimensions_text,
    gap_frequency,
    generic_series_code,
    name_before_dash,
    parse_dimensions,
    period_end,
    period_index,
    without_key,
)
from chronopanel.ordered import exact_quantiles
from chronopanel.schema import DATE, ENTITY, KEYS, PanelError, data_columns, null_count, q, series

RESAMPLE_STATS = ("sum", "last", "min", "max", "mean", "median")


def _keyed(operator):
    """Let an operator on panels take a single series without a country column as well."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        if ENTITY in df.columns:
            return operator(df, *args, **options)
        return operator(df.select(F.lit("N/A").alias(ENTITY), "*"), *args, **options).drop(ENTITY)

    return run


def completeness(df: DataFrame) -> DataFrame:
    """Filled and missing share of every column, from one aggregate row turned into rows."""
    shares = df.agg(*[F.avg(q(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], [f"`{c}`" for c in df.columns], "column", "completeness")
    return long.withColumn("missing_percent", 1 - F.col("completeness"))


def completeness_long(long: DataFrame) -> DataFrame:
    filled = long.groupBy(F.col("variable").alias("column")).agg((F.count("value") / F.count("*")).alias("completeness"))
    return filled.withColumn("missing_percent", 1 - F.col("completeness"))


def data_quality(df: DataFrame, countries: Sequence[str] | None = None, tag: str = "panel") -> DataFrame:
    """Countries, year range and mean filled share of the variables, in percent."""
    if countries:
        df = df.where(F.col(ENTITY).isin(list(countries)))
    values = data_columns(df)
    filled = [F.avg(q(c).isNotNull().cast("double")) for c in values]
    mean = sum(filled[1:], filled[0]) / len(filled) if filled else F.lit(0.0)
    return df.agg(
        F.lit(tag).alias("data_set"),
        F.countDistinct(ENTITY).alias("countries"),
        F.concat_ws("-", F.min(F.year(DATE)).cast("string"), F.max(F.year(DATE)).cast("string")).alias("years"),
        (mean * 100).alias("completeness"),
    )


def _statistic(kind: str, column: str) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(q(column)), F.lit(0.0))
    if kind == "mean":
        return F.avg(q(column))
    if kind == "median":
        return F.percentile(q(column), F.lit(0.5))
    return {"min": F.min, "max": F.max}[kind](q(column))


@_keyed
def resample(
    df: DataFrame, freq: str = "M", mapping: Mapping[str, Sequence[str]] | None = None, complete: bool = True
) -> DataFrame:
    """Period-end buckets per country, then the grid of all countries and period ends.

    ``mapping`` lists columns per statistic; the rest take the as-of row: the
    last row dated up to the period end, whole, its NULLs included. Periods
    without rows inside a country's range carry the as-of row on, sum to 0 and
    have no other statistic. One shuffle aggregates to periods; a second orders
    each (already small) series to fill its empty periods.
    """
    check_frequency(freq)
    values = data_columns(df)
    mapping = mapping or {"last": values}
    wrong = [k for k in mapping if k not in RESAMPLE_STATS]
    if wrong:
        raise ValueError(f"mapping keys must be among {RESAMPLE_STATS}; got {wrong}")
    kind = {c: "last" for c in values}
    for stat, columns in mapping.items():
        for c in columns:
            if c in kind:
                kind[c] = stat
    last_columns = [c for c in values if kind[c] == "last"]
    per = df.groupBy(ENTITY, period_index(F.col(DATE), freq).alias("__p")).agg(
        *([F.max_by(F.struct(*[q(c) for c in last_columns]), DATE).alias("__last")] if last_columns else []),
        *[_statistic(k, c).alias(c) for c, k in kind.items() if k != "last"],
    )
    w = Window.partitionBy(ENTITY).orderBy("__p")
    spans = per.withColumn("__next", F.coalesce(F.lead("__p").over(w) - 1, F.col("__p")))
    filled = spans.withColumn("__i", F.explode(F.sequence("__p", "__next")))
    own = F.col("__i") == F.col("__p")
    out = []
    for c in values:
        if kind[c] == "last":
            out.append(F.col("__last").getField(c).alias(c))
        elif kind[c] == "sum":
            out.append(F.when(own, q(c)).otherwise(0.0).alias(c))
        else:
            out.append(F.when(own, q(c)).alias(c))
    result = filled.select(ENTITY, period_end(F.col("__i"), freq).alias(DATE), *out)
    return complete_grid(result, freq) if complete and freq != "D" else result


@_keyed
def complete_grid(df: DataFrame, freq: str = "M") -> DataFrame:
    """All countries at all period ends from the first date of the panel to its last.

    Rows that are not dated at a period end have no place on the grid; their
    country and period still do. Every row is expanded over the empty periods
    up to its country's next row, and a country's first and last row also reach
    to the ends of the panel, so the grid needs neither a product of countries
    and dates nor a join: one shuffle by country, which later features share.
    """
    check_frequency(freq)
    if freq == "D":
        return df
    last = period_index(F.max(DATE), freq)
    # a period that the last date does not complete has no end on the grid
    complete = last - (F.max(DATE) < period_end(last, freq)).cast("int")
    extent = df.agg(F.struct(period_index(F.min(DATE), freq).alias("lo"), complete.alias("hi"))).scalar()
    w = series()
    numbered = df.withColumn("__p", period_index(F.col(DATE), freq))
    latest = numbered.withColumn("__following", F.lead("__p").over(w)).where(
        F.col("__following").isNull() | (F.col("__following") > F.col("__p"))
    )
    spans = latest.withColumns(
        {
            "__extent": extent,
            "__first": F.lag("__p").over(w).isNull(),
            "__on_grid": F.col(DATE) == period_end(F.col("__p"), freq),
        }
    ).withColumns(
        {
            "__from": F.when(F.col("__first"), F.col("__extent.lo")).otherwise(F.col("__p")),
            "__to": F.least(F.coalesce(F.col("__following") - 1, F.col("__extent.hi")), F.col("__extent.hi")),
        }
    ).where("__from <= __to").withColumn("__i", F.explode(F.sequence("__from", "__to")))
    own = (F.col("__i") == F.col("__p")) & F.col("__on_grid")
    return spans.select(
        ENTITY,
        period_end(F.col("__i"), freq).alias(DATE),
        *[F.when(own, q(c)).alias(c) for c in data_columns(df)],
    )


def gap_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per variable: does any country miss values before, after or between its valid ones?"""
    columns = list(columns or data_columns(df))
    w = Window.partitionBy(ENTITY)
    kinds = ("before", "after", "between")
    cells = []
    for i, c in enumerate(columns):
        valid = F.when(q(c).isNotNull(), F.col(DATE))
        first, last = F.min(valid).over(w), F.max(valid).over(w)
        missing = q(c).isNull()
        cells += [
            (missing & (F.col(DATE) < first)).alias(f"before_{i}"),
            (missing & (F.col(DATE) > last)).alias(f"after_{i}"),
            (missing & (F.col(DATE) > first) & (F.col(DATE) < last)).alias(f"between_{i}"),
        ]
    flags = [F.coalesce(F.max(f"{k}_{i}"), F.lit(False)).alias(f"gap_{k}") for i in range(len(columns)) for k in kinds]
    rows = [
        F.struct(F.lit(c).alias("variable"), *flags[3 * i : 3 * i + 3]) for i, c in enumerate(columns)
    ]
    return df.select(*cells).agg(F.array(*rows).alias("r")).select(F.inline("r"))


def bucket_counts(df: DataFrame, column: str = "bucket_name") -> DataFrame:
    return df.where(q(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def concurrent_crises(labels: DataFrame, at_least: int) -> DataFrame:
    """Years with crises in at least that many countries."""
    # (Country, Year) is deduplicated first, so counting is a plain mergeable sum.
    per_year = labels.select(ENTITY, "Year").distinct().groupBy("Year").agg(F.count("*").alias("countries"))
    return per_year.where(F.col("countries") >= at_least)


def crisis_years_by_country(labels: DataFrame, region: str = "region") -> DataFrame:
    """Sorted distinct crisis years of every country, with its region."""
    return labels.groupBy(region, ENTITY).agg(F.sort_array(F.collect_set("Year")).alias("years"))


def consolidate_catalogue(df: DataFrame, position: str = "position") -> DataFrame:
    """Country-free catalogue: first non-null description per generic code, in source order."""
    dims = parse_dimensions(F.col("dimensions"))
    cleaned = df.select(
        generic_series_code(F.col("series_code"), F.col("dimensions")).alias("series_code"),
        name_before_dash(F.col("series_name")).alias("series_name"),
        F.when(dims.isNotNull(), dimensions_text(without_key(dims, "LOCATION"))).otherwise(F.col("dimensions")).alias("dimensions"),
        "bucket",
        "bucket_name",
        F.col(position).alias("__at"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c)
    return cleaned.groupBy("series_code").agg(*[first(c) for c in ("series_name", "dimensions", "bucket", "bucket_name")])


def global_by_date(long: DataFrame, stat: str) -> DataFrame:
    """Cross-country statistic of a variable per date.

    A date can hold any number of entities: the mean merges, the median goes
    through distributed quantiles, and the mode counts values before comparing.
    """
    keys = [DATE, "variable"]
    valid = long.where(F.col("value").isNotNull())
    if stat == "mean":
        return valid.groupBy(*keys).agg(F.avg("value").alias("stat"))
    if stat == "median":
        return exact_quantiles(valid, keys, "value", {"stat": 0.5})
    if stat == "mode":
        counts = valid.groupBy(*keys, "value").agg(F.count("*").alias("__n"))
        return counts.groupBy(*keys).agg(F.max_by("value", F.struct("__n", -F.col("value"))).alias("stat"))
    raise ValueError(f"unsupported statistic {stat!r}")


def best_frequency(df: DataFrame, position: str = "position") -> DataFrame:
    """Per (LOCATION, SUBJECT, MEASURE) the most frequent series; the first listed wins ties.

    The smallest (rank, position) is a mergeable aggregate, so a location with
    very many series is reduced before the shuffle.
    """
    freq = F.col("dimensions.FREQUENCY")
    rank = F.when(freq == "M", 0).when(freq == "Q", 1).when(freq == "A", 2).otherwise(3)
    keys = [F.col(f"dimensions.{k}").alias(f"__{k}") for k in ("LOCATION", "SUBJECT", "MEASURE")]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(rank, F.col(position))).alias("r"))
    return best.select("r.*")


def most_complete_row(df: DataFrame, tie: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key the row with the fewest NULLs; ``tie`` columns order equal rows."""
    whole = F.struct(*[q(c) for c in df.columns])
    order = F.struct(null_count(df.columns).alias("__nulls"), *[q(c) for c in tie])
    return df.groupBy(*keys).agg(F.min_by(whole, order).alias("__r")).select("__r.*")


def dedupe(
    df: DataFrame, keys: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()
) -> DataFrame:
    """Whole-row duplicates, or one row per key: the first or last in ``order``.

    Keeping first or last is a mergeable min/max over a struct, so a key holding
    a third of all rows never reaches one task.
    """
    if keys is None:
        return df.distinct()
    if not order:
        raise PanelError("keeping the first or last row of a key needs order columns")
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*[q(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(whole, F.struct(*[q(c) for c in order])).alias("__r")).select("__r.*")


def split_info(df: DataFrame, label: str = "label") -> DataFrame:
    """Per split: date range, rows, share of rows and positive share."""
    per = df.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.min(DATE).alias("start"),
        F.max(DATE).alias("end"),
        F.count("*").alias("count"),
        F.avg(F.col(label).cast("double")).alias("label_proportion"),
    )
    total = F.sum("count").over(Window.partitionBy())  # over one row per split
    return per.withColumns({"total_periods": total, "proportion": F.col("count") / total})


def require_rows_per_country(df: DataFrame, length: int) -> DataFrame:
    """Fail when a country has fewer rows than a sequence needs."""
    shortest = min_rows_per_country(df).first()["min_rows"]
    if shortest is not None and shortest < length:
        raise PanelError(f"a country has {shortest} rows; sequences need {length}")
    return df


def min_rows_per_country(df: DataFrame) -> DataFrame:
    return df.groupBy(ENTITY).count().agg(F.min("count").alias("min_rows"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per variable."""
    from chronopanel.schema import to_long

    columns = list(columns or data_columns(df))
    long = to_long(df, columns)
    basic = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["variable"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "variable", "left")


def series_frequency(df: DataFrame, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """D, M, Q, Y or Unknown per series, from its most common day gap (larger gap on ties)."""
    w = series(by)
    gaps = df.select(*by, F.datediff(DATE, F.lag(DATE).over(w)).alias("gap"))
    counts = gaps.groupBy(*by, "gap").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(
        F.max_by("gap", F.when(F.col("gap").isNotNull(), F.struct("n", "gap"))).alias("gap")
    )
    return best.select(*by, F.when(F.col("gap").isNull(), "Unknown").otherwise(gap_frequency(F.col("gap"))).alias("frequency"))


def shape_report(sets: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """Rows, countries and positive percentage of each named set."""
    out = None
    for name, df in sets.items():
        row = df.agg(
            F.lit(name).alias("set"),
            F.count("*").alias("rows"),
            F.countDistinct(ENTITY).alias("countries"),
            (F.avg(F.col(label).cast("double")) * 100).alias("positive_percent"),
        )
        out = row if out is None else out.unionByName(row)
    return out
