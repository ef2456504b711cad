"""Merging frames onto shared keys, grids and timelines.

No join is forced to broadcast: the optimizer broadcasts a side when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and sorts and
merges otherwise, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalars import gap_frequency, year_to_date
from chronopanel.schema import DATE, ENTITY, KEYS, q, to_wide

# Fixed value: days shown around the data range of a timeline.
TIMELINE_MARGIN_DAYS = 180


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def outer_fold(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of any number of frames in one shuffle.

    Each frame is unique on ``keys``, so stacking them and taking the only
    non-null value per key and column equals the chain of outer joins.
    """
    stacked = _stack(frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(q(c), ignorenulls=True).alias(c) for c in values])


def merge_indicators(frames: Sequence[DataFrame]) -> DataFrame:
    """Annual indicator frames to one panel dated at the start of the year."""
    merged = outer_fold(frames, [ENTITY, "Year"])
    return merged.select(ENTITY, year_to_date(F.col("Year")).alias(DATE), *[q(c) for c in merged.columns if c not in (ENTITY, "Year")])


def assemble_series(long: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """(Country, Period, variable, value) rows to a panel over the union of keys."""
    return to_wide(long.withColumnRenamed("Period", DATE), variables)


def union_keys(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    return _stack([f.select(*keys) for f in frames]).distinct()


def union_dates(frames: Sequence[DataFrame]) -> DataFrame:
    return union_keys(frames, [DATE])


def merge_timeseries(frames: Sequence[DataFrame], on: str | None = ENTITY) -> DataFrame:
    """Outer alignment on the full key by date grid.

    Frames without the key apply to every key. A column found in several frames
    is taken from the first. The date axis is one array of distinct calendar
    days, exploded per key, so no pairwise join builds the grid.
    """
    if not frames:
        raise ValueError("frames must be a non-empty list")
    for f in frames:
        if DATE not in f.columns:
            raise ValueError("each frame needs a Date column")
    seen: set[str] = {DATE, *([on] if on else [])}
    keyed: list[DataFrame] = []
    unkeyed: list[DataFrame] = []
    order: list[str] = []
    for f in frames:
        names = [c for c in f.columns if c not in seen]
        seen.update(names)
        order += names
        has_key = bool(on) and on in f.columns
        trimmed = f.select(*([on] if has_key else []), DATE, *[q(c) for c in names])
        (keyed if has_key else unkeyed).append(trimmed)
    if not keyed:
        axis = union_dates(unkeyed)
        return axis.join(outer_fold(unkeyed, [DATE]), DATE, "left").select(DATE, *[q(c) for c in order])
    days = union_dates([*keyed, *unkeyed]).agg(F.sort_array(F.collect_set(DATE))).scalar()
    grid = union_keys(keyed, [on]).select(on, F.explode(days).alias(DATE))
    out = grid.join(outer_fold(keyed, [on, DATE]), [on, DATE], "left")
    if unkeyed:
        out = out.join(outer_fold(unkeyed, [DATE]), DATE, "left")
    return out.select(on, DATE, *[q(c) for c in order])


def union_panels(*panels: DataFrame) -> DataFrame:
    """Stack panels; variables one of them lacks become NULL."""
    return _stack(panels)


def left_merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return a.join(b, list(keys), "left")


def outer_merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return a.join(b, list(keys), "full")


def add_features(panel: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of feature columns; columns the panel already has are not repeated."""
    extra = [c for c in features.columns if c not in panel.columns]
    return panel.join(features.select(*keys, *[q(c) for c in extra]), list(keys), "left")


def join_country_master(df: DataFrame, master: DataFrame) -> DataFrame:
    return df.join(master, df[ENTITY] == master["name"], "left")


def enrich_region(df: DataFrame, master: DataFrame) -> DataFrame:
    """Attach the region of each country."""
    return df.join(master.select(F.col("name").alias(ENTITY), "region"), ENTITY, "left")


def countries_in_both(crises: DataFrame, panel: DataFrame) -> DataFrame:
    """Countries of the crisis table that occur in the panel."""
    return crises.select(ENTITY).distinct().join(panel.select(ENTITY).distinct(), ENTITY, "left_semi")


def except_countries(df: DataFrame, train: DataFrame) -> DataFrame:
    """Countries not used for training."""
    return df.select(ENTITY).distinct().join(train.select(ENTITY).distinct(), ENTITY, "left_anti")


def lookup_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stored predictions per row; unknown rows get class 0 and probability 0.5."""
    stored = predictions.select(*KEYS, "y_pred", "y_pred_proba")
    joined = df.join(stored, list(KEYS), "left")
    return joined.withColumns(
        {
            "y_pred": F.coalesce("y_pred", F.lit(0)),
            "y_pred_proba": F.coalesce("y_pred_proba", F.lit(0.5)),
        }
    )


def align_window_labels(window_rows: DataFrame, labelled: DataFrame, label: str = "label") -> DataFrame:
    """Labels of exactly the rows in a window, by key and never by position."""
    return window_rows.join(labelled.select(*KEYS, label), list(KEYS), "inner")


def history_join(targets: DataFrame, history: DataFrame, bucket: str = "month", parts: int = 8) -> DataFrame:
    """Every row of ``targets`` with every row of ``history`` dated the same day or earlier, itself left out.

    A history row comes in the struct ``history``. Dates fall into calendar buckets (``month``, ``quarter`` or ``year``):
    a target meets each bucket up to its own by equality, and only in its own are dates compared row by row, so no pair
    of a later bucket is ever formed. Each bucket is dealt out to ``parts`` tasks. Rows without a date have no history
    and are in none.
    """
    months = {"month": 1, "quarter": 3, "year": 12}[bucket]
    start = F.trunc(DATE, bucket)
    first = history.agg(F.min(start)).scalar()
    upto = F.sequence(first, start, F.make_ym_interval(F.lit(0), F.lit(months)))
    left = targets.withColumns({"__own": start, "__bucket": F.explode(F.when(first <= start, upto))})
    left = left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = history.select(
        start.alias("__bucket"), F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int").alias("__part"), F.struct(*[q(c) for c in history.columns]).alias("history")
    )
    past = (F.col("__bucket") < F.col("__own")) | (F.col(f"history.{DATE}") <= F.col(DATE))
    itself = (F.col(f"history.{DATE}") == F.col(DATE)) & F.col(f"history.{ENTITY}").eqNullSafe(F.col(ENTITY))
    return left.join(right, ["__bucket", "__part"]).where(past & ~itself).drop("__own", "__bucket", "__part")


def crisis_intervals(crises: DataFrame, panel: DataFrame) -> DataFrame:
    """Calendar-year intervals of crisis years, clipped to the shown range of the panel."""
    lo = panel.agg(F.date_sub(F.min(DATE), TIMELINE_MARGIN_DAYS)).scalar()
    hi = panel.agg(F.date_add(F.max(DATE), TIMELINE_MARGIN_DAYS)).scalar()
    start = F.make_date(F.col("Year"), F.lit(1), F.lit(1))
    end = F.make_date(F.col("Year"), F.lit(12), F.lit(31))
    return (
        crises.where((end >= lo) & (start <= hi))
        .withColumns({"start_date": F.greatest(start, lo), "end_date": F.least(end, hi)})
    )


def overlay_crises(rows: DataFrame, crises: DataFrame) -> DataFrame:
    """Rows dated inside a crisis interval of their country, with that interval.

    An interval is one calendar year, so the range condition is an equality on
    (Country, year) and needs no range join.
    """
    intervals = crisis_intervals(crises.select(ENTITY, "Year").distinct(), rows)
    return (
        rows.withColumn("Year", F.year(DATE))
        .join(intervals, [ENTITY, "Year"])
        .where(F.col(DATE).between(F.col("start_date"), F.col("end_date")))
    )


def flag_crisis_points(
    df: DataFrame, crises: DataFrame, columns: Sequence[str], countries: Sequence[str] | None = None
) -> DataFrame:
    """Points to mark on a series plot: rows in a crisis year of their country."""
    years = crises.select(ENTITY, "Year").distinct()
    picked = df if countries is None else df.where(F.col(ENTITY).isin(list(countries)))
    return (
        picked.withColumn("Year", F.year(DATE))
        .join(years, [ENTITY, "Year"], "left_semi")
        .select(*KEYS, *[q(c) for c in columns])
    )


def _timeline_facts(dates: DataFrame) -> Column:
    """One struct describing a date column: extent, frequency, start-of-period spacing."""
    from pyspark.sql import Window

    d = dates.select(F.to_date(DATE).alias(DATE))
    # A calendar holds a bounded number of days, so one ordered pass over the
    # distinct days is small; repeats only matter for their count.
    days = d.groupBy(DATE).agg(F.count("*").alias("n"))
    w = Window.orderBy(DATE)
    gaps = days.select(
        DATE,
        "n",
        F.lag(DATE).over(w).alias("before"),
    ).select(
        DATE,
        "n",
        F.datediff(DATE, "before").alias("gap"),
        F.months_between(DATE, "before").alias("months"),
    )
    extent = gaps.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min(DATE).alias("lo"),
        F.max(DATE).alias("hi"),
        F.max("n").alias("repeats"),
        F.bool_and(F.dayofmonth(DATE) == 1).alias("on_first"),
        F.min("months").alias("step_lo"),
        F.max("months").alias("step_hi"),
    )
    by_gap = gaps.where("gap IS NOT NULL").groupBy("gap").agg(F.sum("n").alias("c"))
    mode = by_gap.agg(F.max_by("gap", F.struct("c", "gap"))).scalar()
    facts = extent.select(
        F.struct(
            "n",
            "lo",
            "hi",
            F.when(F.col("n") < 2, "Unknown").otherwise(gap_frequency(mode)).alias("freq"),
            F.when(
                (F.col("n") >= 3) & F.col("on_first") & (F.col("repeats") == 1) & (F.col("step_lo") == F.col("step_hi")),
                F.when(F.col("step_lo").isin(1.0, 3.0, 12.0), F.col("step_lo").cast("int")),
            ).alias("start_step"),
        )
    )
    return facts.scalar()


def join_timelines(spark, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Dense date axis over both date columns at the higher of their frequencies.

    Ties go to the second. Start-of-period spacing is kept when the chosen
    column shows it; otherwise months, quarters and years end their period.
    Unknown frequencies give daily dates; no dates give no rows.
    """
    empty = spark.createDataFrame([], f"{DATE} DATE")
    a = _timeline_facts(first)
    b = _timeline_facts(second if second is not None else empty)
    base = spark.range(1).select(a.alias("a"), b.alias("b"))

    def rank(side: str) -> Column:
        f = F.col(f"{side}.freq")
        return F.when(f == "D", 4).when(f == "M", 3).when(f == "Q", 2).when(f == "Y", 1).otherwise(0)

    pick = F.when(rank("a") > rank("b"), F.col("a")).otherwise(F.col("b"))
    chosen = base.select(
        F.least("a.lo", "b.lo").alias("lo"), F.greatest("a.hi", "b.hi").alias("hi"), pick.alias("p")
    ).select("lo", "hi", F.col("p.freq").alias("freq"), F.col("p.start_step").alias("step"), F.col("p.lo").alias("anchor"))

    month0 = F.year("lo") * 12 + F.month("lo") - 1
    month1 = F.year("hi") * 12 + F.month("hi") - 1
    anchor = F.year("anchor") * 12 + F.month("anchor") - 1
    as_first = lambda m: F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))
    starts = F.filter(
        F.transform(
            F.filter(F.sequence(month0, month1), lambda m: F.pmod(m - anchor, F.col("step")) == 0), as_first
        ),
        lambda d: d >= F.col("lo"),
    )
    ends = F.filter(
        F.transform(
            F.filter(
                F.sequence(month0, month1),
                lambda m: F.when(F.col("freq") == "M", F.lit(True))
                .when(F.col("freq") == "Q", F.pmod(m + 1, F.lit(3)) == 0)
                .otherwise(F.pmod(m + 1, F.lit(12)) == 0),
            ),
            lambda m: F.last_day(as_first(m)),
        ),
        lambda d: d <= F.col("hi"),
    )
    daily = F.sequence("lo", "hi")
    axis = (
        F.when(F.col("step").isNotNull(), starts)
        .when(F.col("freq").isin("M", "Q", "Y"), ends)
        .otherwise(daily)
    )
    return chosen.where(F.col("lo").isNotNull()).select(F.explode(axis).alias(DATE))
