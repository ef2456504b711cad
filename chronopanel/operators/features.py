"""Time-series features of a panel.

Each function appends its feature columns in one projection, so all features
that share a series order share one shuffle and one sort. Feature names follow
``{column}_{suffix}[_{window}[_{stat}]]``. ``by`` names the series key: country
alone for a wide panel (and for temporal splits, whose test windows start with
training rows), country and variable for the long form, country and split when
sets must not see each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalars import ratio
from chronopanel.schema import DATE, ENTITY, KEYS, expanding, numeric_columns, q, series, spread, whole

# Guards against division by zero, season length, trading days.
EPSILON = 1e-8
SEASON = 12
YEAR_OF_DAYS = 252
MONTH_OF_DAYS = 21

ROLLING_STATS = ("mean", "std", "min", "max", "median", "skew", "kurt")


def _names(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str]) -> list[str]:
    return list(columns) if columns else numeric_columns(df, (*by, DATE, "split", "label"))


def _append(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    return df.select("*", *[e.alias(n) for n, e in features.items()])


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def split_keys(split_type: str) -> tuple[str, ...]:
    """Series key per split type: temporal splits read across the split, others do not."""
    return (ENTITY,) if split_type == "temporal" else (ENTITY, "split")


def slope(df, columns=None, window: int = 2, suffix: str = "slope", by=(ENTITY,)) -> DataFrame:
    """Relative change over ``window - 1`` rows."""
    w = series(by)
    return _append(
        df,
        {
            f"{c}_{suffix}": _zero(ratio(q(c), F.lag(q(c), window - 1).over(w)) - 1)
            for c in _names(df, columns, by)
        },
    )


def acceleration(df, columns=None, window: int = 2, suffix: str = "acc", by=(ENTITY,)) -> DataFrame:
    """Slope of the slope."""
    names = _names(df, columns, by)
    first = slope(df, names, window, "slope", by)
    second = slope(first, [f"{c}_slope" for c in names], window, suffix, by)
    return second.drop(*[f"{c}_slope" for c in names if f"{c}_slope" not in df.columns])


def corrected_skew(x: Column, spec) -> Column:
    """Sample skewness of a frame; NULL under three values."""
    n = F.count(x).over(spec)
    g1 = F.skewness(x).over(spec)
    flat = F.max(x).over(spec) == F.min(x).over(spec)
    value = g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n >= 3, F.when(flat, 0.0).otherwise(value))


def corrected_kurt(x: Column, spec) -> Column:
    """Sample excess kurtosis of a frame; NULL under four values."""
    n = F.count(x).over(spec)
    g2 = F.kurtosis(x).over(spec)
    flat = F.max(x).over(spec) == F.min(x).over(spec)
    value = ((n + 1) * g2 + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(flat, 0.0).otherwise(value))


def _rolling(x: Column, stat: str, spec, window: int) -> Column:
    if stat == "skew":
        return F.when(F.count(x).over(spec) >= min(window, 3), corrected_skew(x, spec))
    if stat == "kurt":
        return F.when(F.count(x).over(spec) >= min(window, 4), corrected_kurt(x, spec))
    if stat == "median":
        return F.percentile(x, F.lit(0.5)).over(spec)
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](x).over(spec)


def rolling(
    df,
    columns=None,
    windows: int | Sequence[int] = (3, 6),
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    suffix: str = "rolling",
    by=(ENTITY,),
) -> DataFrame:
    """Statistics over the last ``window`` rows, fewer at the start."""
    unknown = [s for s in stats if s not in ROLLING_STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}")
    windows = [windows] if isinstance(windows, int) else list(windows)
    w = series(by)
    return _append(
        df,
        {
            f"{c}_{suffix}_{n}_{s}": _zero(_rolling(q(c), s, w.rowsBetween(1 - n, 0), n))
            for c in _names(df, columns, by)
            for n in windows
            for s in stats
        },
    )


def exceedance(
    df, columns=None, window: int = 24, threshold: float = 0.9, suffix: str = "exceeds", by=(ENTITY,)
) -> DataFrame:
    """How many of two limits a value passes: near the window maximum, near its minimum."""
    spec = series(by).rowsBetween(1 - window, 0)
    features = {}
    for c in _names(df, columns, by):
        full = F.count(q(c)).over(spec) == window
        high = full & (q(c) > F.max(q(c)).over(spec) * threshold)
        low = full & (q(c) < F.min(q(c)).over(spec) * (2 - threshold))
        count = F.coalesce(high.cast("int"), F.lit(0)) + F.coalesce(low.cast("int"), F.lit(0))
        features[f"{c}_{suffix}_{threshold}"] = count.cast("double")
    return _append(df, features)


def _recursive_mean(values, alpha: float, adjust: bool, missing_to_zero: bool) -> Column:
    """Exponentially weighted means of an array in time order, one after every element, as a fold with (mean, weight).

    Both decay through gaps: a mean stays as it is while its weight shrinks, until the next value comes.
    """
    null, new = F.lit(None).cast("double"), F.lit(1.0 if adjust else float(alpha))

    def step(state: Column, now: Column) -> Column:
        weight = F.when(state["mean"].isNull(), F.lit(1.0)).otherwise(state["weight"] * F.lit(1.0 - alpha))
        mixed = (weight * state["mean"] + new * now) / (weight + new)
        mean = F.when(now.isNull(), state["mean"]).when(state["mean"].isNull(), now).otherwise(mixed)
        met = now.isNotNull() & state["mean"].isNotNull()
        shown = F.coalesce(mean, F.lit(0.0)) if missing_to_zero else mean
        after = F.when(met, weight + new if adjust else F.lit(1.0)).otherwise(weight)
        return F.struct(mean.alias("mean"), after.alias("weight"), F.array_append(state["out"], shown).alias("out"))

    start = F.struct(null.alias("mean"), F.lit(1.0).alias("weight"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step, lambda state: state["out"])


def _recursive_features(df, names, alphas: dict[str, float], adjust: bool, missing_to_zero: bool, by) -> DataFrame:
    """Every series becomes one array of rows (bounded by the calendar), each mean a fold over it, all in the JVM."""
    rest = [c for c in df.columns if c not in by]
    row = F.struct(q(DATE), *[q(c) for c in rest if c != DATE])
    series_ = df.groupBy(*[q(c) for c in by]).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    value = lambda c: F.transform("__rows", lambda r: F.nanvl(r[c].cast("double"), F.lit(None).cast("double")))
    added = {f"{c}_{label}": _recursive_mean(value(c), a, adjust, missing_to_zero) for label, a in alphas.items() for c in names}
    folded = series_.select(*[q(c) for c in by], "__rows", *[e.alias(n) for n, e in added.items()])
    zipped = F.arrays_zip("__rows", *[q(n) for n in added])
    each = folded.select(*[q(c) for c in by], F.explode(zipped).alias("__r"))
    found = each.select(*[q(c) for c in by], *[F.col("__r")["__rows"][c].alias(c) for c in rest], *[F.col("__r")[n].alias(n) for n in added])
    return found.select(*[q(c) for c in df.columns], *[q(n) for n in added])


def ewm(df, columns=None, spans: int | Sequence[int] = (3, 6, 12), suffix: str = "ewm", by=(ENTITY,)) -> DataFrame:
    """Recursive exponentially weighted mean per span, decaying through gaps.

    The recursion has no window form; each series (bounded by the calendar) is folded in time order.
    """
    spans = [spans] if isinstance(spans, int) else list(spans)
    alphas = {f"{suffix}_{s}": 2.0 / (s + 1) for s in spans}
    return _recursive_features(df, _names(df, columns, by), alphas, False, True, by)


def ewma(df, columns=None, alphas: Sequence[float] = (0.1, 0.3, 0.7), by=(ENTITY,)) -> DataFrame:
    """Normalised exponentially weighted mean per decay."""
    labels = {f"ewma_{int(a * 10)}": a for a in alphas}
    return _recursive_features(df, _names(df, columns, by), labels, True, False, by)


def dist_mean(df, columns=None, suffix: str = "dist_mean", by=(ENTITY,)) -> DataFrame:
    """Distance from the mean so far in standard deviations so far."""
    spec = expanding(series(by))
    return _append(
        df,
        {
            f"{c}_{suffix}": _zero((q(c) - F.avg(q(c)).over(spec)) / (F.stddev_samp(q(c)).over(spec) + EPSILON))
            for c in _names(df, columns, by)
        },
    )


def lag(df, columns=None, lags: int | Sequence[int] = (1, 3, 6), suffix: str = "lag", by=(ENTITY,)) -> DataFrame:
    lags = [lags] if isinstance(lags, int) else list(lags)
    w = series(by)
    return _append(
        df, {f"{c}_{suffix}_{k}": _zero(F.lag(q(c), k).over(w)) for c in _names(df, columns, by) for k in lags}
    )


def momentum(df, columns=None, window: int = 3, suffix: str = "momentum", by=(ENTITY,)) -> DataFrame:
    """Relative distance from the moving average."""
    spec = series(by).rowsBetween(1 - window, 0)
    features = {}
    for c in _names(df, columns, by):
        average = F.avg(q(c)).over(spec)
        features[f"{c}_{suffix}_{window}"] = _zero((q(c) - average) / (F.abs(average) + EPSILON))
    return _append(df, features)


def volatility(df, columns=None, window: int = 3, suffix: str = "volatility", by=(ENTITY,)) -> DataFrame:
    """Standard deviation relative to the (signed) moving average."""
    spec = series(by).rowsBetween(1 - window, 0)
    return _append(
        df,
        {
            f"{c}_{suffix}_{window}": _zero(
                ratio(F.stddev_samp(q(c)).over(spec), F.avg(q(c)).over(spec) + EPSILON)
            )
            for c in _names(df, columns, by)
        },
    )


def seasonal(
    df,
    columns=None,
    model: str = "additive",
    suffix: str = "seasonal",
    by=(ENTITY,),
    centered: bool = True,
) -> DataFrame:
    """Trend and residual of a classical period-12 decomposition.

    The trend is a 2x12 moving average, centred, and seasonal means cover the
    whole series; both read later rows. ``centered=False`` uses nothing but the
    current and earlier rows: a trailing average and the seasonal means so far.
    Series with gaps, with under 24 rows, or (multiplicative) with values that
    are not positive get zeros, as do the ends without a full window.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be additive or multiplicative")
    names = _names(df, columns, by)
    w = series(by)
    half = SEASON // 2
    shift = 0 if centered else half
    seen = whole(by) if centered else expanding(w)
    numbered = df.withColumn("__phase", (F.row_number().over(w) - 1) % SEASON)
    additive = model == "additive"
    steps, detrended = {}, {}
    for i, c in enumerate(names):
        inner = w.rowsBetween(1 - half - shift, half - 1 - shift)
        edge = lambda k, c=c: (F.lead(q(c), k) if k >= 0 else F.lag(q(c), -k)).over(w)
        usable = (F.count(q(c)).over(seen) == F.count("*").over(seen)) & (F.count("*").over(seen) >= 2 * SEASON)
        if not additive:
            usable = usable & (F.min(q(c)).over(seen) > 0)
        trend = (0.5 * edge(-half - shift) + F.sum(q(c)).over(inner) + 0.5 * edge(half - shift)) / SEASON
        steps[f"__t_{i}"] = F.when(usable, trend)
    staged = _append(numbered, steps)
    for i, c in enumerate(names):
        t = F.col(f"__t_{i}")
        detrended[f"__d_{i}"] = q(c) - t if additive else ratio(q(c), t)
    phase = Window.partitionBy(*by, "__phase")
    if not centered:
        phase = expanding(phase.orderBy(DATE))
    means = _append(_append(staged, detrended), {f"__m_{i}": F.avg(f"__d_{i}").over(phase) for i in range(len(names))})
    features = {}
    for i, c in enumerate(names):
        # Each phase weighs the same however many rows it has: average one row
        # of each, the first twelve or (looking back only) the latest twelve.
        if centered:
            center = F.avg(F.when(F.col("__first"), F.col(f"__m_{i}"))).over(whole(by))
        else:
            center = F.avg(f"__m_{i}").over(w.rowsBetween(1 - SEASON, 0))
        d, m = F.col(f"__d_{i}"), F.col(f"__m_{i}")
        residual = d - (m - center) if additive else ratio(d, ratio(m, center))
        features[f"{c}_{suffix}_trend"] = _zero(F.col(f"__t_{i}"))
        features[f"{c}_{suffix}_residual"] = _zero(residual)
    firsts = means.withColumn("__first", F.row_number().over(w) <= SEASON)
    hidden = ["__phase", "__first", *steps, *detrended, *[f"__m_{i}" for i in range(len(names))]]
    return _append(firsts, features).drop(*hidden)


def rolling_volatility(df, columns=None, window: int = 3, by=(ENTITY,)) -> DataFrame:
    """Standard deviation of full windows only."""
    spec = series(by).rowsBetween(1 - window, 0)
    return _append(
        df,
        {
            f"{c}_{window}_year_volatility": F.when(F.count(q(c)).over(spec) == window, F.stddev_samp(q(c)).over(spec))
            for c in _names(df, columns, by)
        },
    )


def ma_momentum(df, columns=None, window: int = 3, by=(ENTITY,)) -> DataFrame:
    """Short minus long moving average, full windows only."""
    w = series(by)
    features = {}
    for c in _names(df, columns, by):
        means = []
        for n in (max(1, window - 1), window + 1):
            spec = w.rowsBetween(1 - n, 0)
            means.append(F.when(F.count(q(c)).over(spec) == n, F.avg(q(c)).over(spec)))
        features[f"{c}_momentum"] = means[0] - means[1]
    return _append(df, features)


def global_average(df, columns=None, suffix: str = "global_avg", by=(ENTITY,)) -> DataFrame:
    """Mean over all countries of the same date, joined back.

    Averages are merged per date first: a window over a date would put its
    whole cross-section into one task.
    """
    names = _names(df, columns, by)
    means = df.groupBy(DATE).agg(*[F.avg(q(c)).alias(f"{c}_{suffix}") for c in names])
    return df.join(means, DATE, "left").select(*[q(c) for c in df.columns], *[q(f"{c}_{suffix}") for c in names])


def engineer_features(df, columns=None, window: int = 3) -> DataFrame:
    """Volatility, momentum, weighted means and global mean together, without the inputs."""
    names = _names(df, columns, (ENTITY,))
    out = ma_momentum(rolling_volatility(df, names, window), names, window)
    out = global_average(ewma(out, names), names)
    return out.drop(*names)


def market_features(df: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Yearly highs and lows, spreads and volatility of daily price bars."""
    w = series(by)
    year = w.rowsBetween(1 - YEAR_OF_DAYS, 0)
    month = w.rowsBetween(1 - MONTH_OF_DAYS, 0)
    bars = _append(
        df,
        {
            "52WeekHigh": F.max("Close").over(year),
            "52WeekLow": F.min("Close").over(year),
            "HighLowDiff": F.col("High") - F.col("Low"),
            "CloseOpenDiff": F.col("Close") - F.col("Open"),
            "__change": ratio(F.col("Close"), F.lag("Close").over(w)) - 1,
        },
    )
    full = F.count("__change").over(month) == MONTH_OF_DAYS
    return _append(
        bars,
        {
            "NewHigh": F.coalesce(F.col("Close") >= q("52WeekHigh"), F.lit(False)),
            "NewLow": F.coalesce(F.col("Close") <= q("52WeekLow"), F.lit(False)),
            "Volatility": F.when(full, F.stddev_samp("__change").over(month)) * F.sqrt(F.lit(float(YEAR_OF_DAYS))),
        },
    ).drop("__change")


def detrend(df, columns=None, method: str = "rolling_mean", window_size: int = 36, by=(ENTITY,)) -> DataFrame:
    """Replace columns by their deviation from a trend."""
    names = _names(df, columns, by)
    w = series(by)
    window = min(window_size // 3, 12)
    if method == "rolling_mean" and window == 1:
        method = "differencing"
    if method == "rolling_mean":
        spec = w.rowsBetween(1 - window, 0)
        exprs = {c: q(c) - F.avg(q(c)).over(spec) for c in names}
    elif method == "differencing":
        exprs = {c: _zero(q(c) - F.lag(q(c)).over(w)) for c in names}
    elif method == "linear_detrend":
        df = df.withColumn("__x", (F.row_number().over(w) - 1).cast("double"))
        df = _append(df, {f"__y_{i}": F.last(q(c), ignorenulls=True).over(expanding(w)) for i, c in enumerate(names)})
        every = whole(by)
        exprs = {
            c: q(c)
            - (
                F.regr_slope(F.col(f"__y_{i}"), F.col("__x")).over(every) * F.col("__x")
                + F.regr_intercept(F.col(f"__y_{i}"), F.col("__x")).over(every)
            )
            for i, c in enumerate(names)
        }
    else:
        raise ValueError(f"unknown trend method {method!r}")
    hidden = {"__x", *[f"__y_{i}" for i in range(len(names))]} if method == "linear_detrend" else set()
    kept = [exprs[c].alias(c) if c in exprs else q(c) for c in df.columns if c not in hidden]
    return df.select(*kept)


def deseasonalise(df, columns=None, period: int = 12, by=(ENTITY,)) -> DataFrame:
    """Subtract the mean of each position in the season; needs two full seasons."""
    names = _names(df, columns, by)
    w = series(by)
    staged = df.withColumns(
        {
            "__phase": (F.row_number().over(w) - 1) % period,
            **{f"__f_{i}": F.last(q(c), ignorenulls=True).over(expanding(w)) for i, c in enumerate(names)},
        }
    )
    phase = Window.partitionBy(*by, "__phase")
    enough = F.count("*").over(whole(by)) >= 2 * period
    exprs = {
        c: F.when(enough, F.col(f"__f_{i}") - F.avg(f"__f_{i}").over(phase)).otherwise(q(c))
        for i, c in enumerate(names)
    }
    return staged.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns])


def prepare_series(
    df,
    columns=None,
    standardise: bool = True,
    trend: str | None = "rolling_mean",
    window_size: int = 36,
    period: int | None = 12,
    by=(ENTITY,),
) -> DataFrame:
    """Fill forward then with 0, scale each series, remove trend, remove season, in that order."""
    names = _names(df, columns, by)
    w = expanding(series(by))
    every = whole(by)
    out = df.select(
        *[
            F.coalesce(F.last(q(c), ignorenulls=True).over(w), F.lit(0.0)).alias(c) if c in names else q(c)
            for c in df.columns
        ]
    )
    if standardise:
        spread = {c: F.stddev_pop(q(c)).over(every) for c in names}
        out = out.select(
            *[
                ((q(c) - F.avg(q(c)).over(every)) / F.when(spread[c] > 0, spread[c]).otherwise(1.0)).alias(c)
                if c in names
                else q(c)
                for c in out.columns
            ]
        )
    if trend:
        out = detrend(out, names, trend, window_size, by)
    if period:
        out = deseasonalise(out, names, period, by)
    return out


def prepare_windows(
    x: np.ndarray, standardise: bool = True, trend: str | None = "rolling_mean", window_size: int = 36, period: int | None = 12
) -> np.ndarray:
    """``prepare_series`` of many windows (window x row x variable) at once, each by its own values only."""
    windows, n, width = x.shape
    known = ~np.isnan(x)
    last = np.maximum.accumulate(np.where(known, np.arange(n)[None, :, None], -1), axis=1)
    x = np.where(last >= 0, np.take_along_axis(x, np.maximum(last, 0), axis=1), 0.0)
    if standardise:
        deviation = x.std(axis=1, keepdims=True)
        x = (x - x.mean(axis=1, keepdims=True)) / np.where(deviation > 0, deviation, 1.0)
    span = min(window_size // 3, 12)
    if trend == "differencing" or (trend == "rolling_mean" and span == 1):
        x = np.concatenate([np.zeros((windows, 1, width)), np.diff(x, axis=1)], axis=1)
    elif trend == "rolling_mean":
        sums = np.concatenate([np.zeros((windows, 1, width)), np.cumsum(x, axis=1)], axis=1)
        first = np.maximum(np.arange(n) + 1 - span, 0)
        x = x - (sums[:, 1:] - sums[:, first]) / (np.arange(n) + 1 - first)[None, :, None]
    elif trend == "linear_detrend":
        at = np.arange(n) - (n - 1) / 2
        slope = np.einsum("t,wtv->wv", at, x) / max((at * at).sum(), 1e-300)
        x = x - x.mean(axis=1, keepdims=True) - at[None, :, None] * slope[:, None, :]
    elif trend:
        raise ValueError(f"unknown trend method {trend!r}")
    if period and n >= 2 * period:
        out = np.empty_like(x)
        for phase in range(period):
            own = x[:, phase::period]
            out[:, phase::period] = own - own.mean(axis=1, keepdims=True)
        x = out
    return x


def sequences(df, columns=None, length: int = 12, label: str | None = None, consecutive: bool = True) -> DataFrame:
    """Every run of ``length`` rows of a country, keyed and labelled by its last row.

    Non-finite values are filled forward inside the country, then with 0. Runs
    whose dates are not evenly spaced are skipped when ``consecutive`` is set.
    """
    from chronopanel.operators.select import clean_nonfinite

    names = [c for c in _names(df, columns, (ENTITY,)) if c != label]
    w = series()
    clean = clean_nonfinite(df)
    filled = clean.select(
        *KEYS,
        *([F.col(label)] if label else []),
        F.array(
            *[
                F.coalesce(F.last(q(c), ignorenulls=True).over(expanding(w)), F.lit(0.0)).cast("double")
                for c in names
            ]
        ).alias("__x"),
    )
    frame = w.rowsBetween(1 - length, 0)
    runs = filled.select(
        *KEYS,
        *([F.col(label)] if label else []),
        F.collect_list(F.struct(DATE, F.col("__x").alias("features"))).over(frame).alias("sequence"),
    ).where(F.size("sequence") == length)
    return runs.where(consecutive_dates(F.transform("sequence", lambda r: r[DATE]))) if consecutive else runs


def day_gaps(dates: Column) -> Column:
    """Day differences between neighbours of a sorted date array."""
    later = F.slice(dates, 2, F.greatest(F.size(dates) - 1, F.lit(0)))
    earlier = F.slice(dates, 1, F.greatest(F.size(dates) - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda a, b: F.datediff(a, b))


def consecutive_dates(dates: Column) -> Column:
    """Whether all gaps of a date array stay near the most common gap (smallest on ties)."""
    from chronopanel.functions.scalars import gap_tolerance

    # each step is bound to a name once: written out, a lambda would work the array out anew for every element
    bound = lambda value, step: F.transform(F.array(value), step)[0]

    def even(gaps: Column) -> Column:
        counted = F.transform(
            F.array_distinct(gaps),
            lambda g: F.struct(F.size(F.filter(gaps, lambda h: h == g)).alias("n"), (-g).alias("neg")),
        )
        return bound(-F.array_max(counted)["neg"], lambda mode: F.forall(gaps, lambda g: F.abs(g - mode) <= gap_tolerance(mode)))

    return bound(dates, lambda d: (F.size(d) < 2) | bound(F.array_sort(day_gaps(d)), even))


def history_tail(train: DataFrame, test: DataFrame, length: int = 12) -> DataFrame:
    """Test rows preceded by the last ``length - 1`` training rows of each country."""
    newest = Window.partitionBy(ENTITY).orderBy(F.col(DATE).desc())
    tail = train.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= length - 1).drop("__r")
    return tail.unionByName(test)
