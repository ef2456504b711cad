"""Imputation across series without look-ahead: neighbours, forecasts, regressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import expanding
from chronopanel.operators.fill import imputation_mask
from chronopanel.operators.neighbours import HELD_NUMBERS, SAMPLE, BoxCells, BoxTree, cells_for, check_metric, nearest, parts_for, search
from chronopanel.operators.select import filter_countries
from chronopanel.ordered import assign_blocks, largest_group
from chronopanel.schema import DATE, ENTITY, KEYS, cut_lineage, numeric_columns, q, renewed, replace_columns, spread, to_long, to_wide

# Weight guard of the neighbour average, quantiles whose distance scales a feature (its median cancels out).
WEIGHT_EPSILON = 1e-8
SCALING_QUANTILES = (0.25, 0.75)
# History values looked up together when finding scaling statistics.
VALUES_PER_BLOCK = 100_000


def _order_positions(n: int) -> list[int]:
    """0-based ranks needed to know the quartiles of n values after removing any one of them."""
    wanted: set[int] = set()
    for p in SCALING_QUANTILES:
        low = int(np.floor(p * (n - 2))) if n >= 2 else 0
        wanted.update(range(low, min(low + 3, n)))
    return sorted(wanted)


def _quartile_without(values: Mapping[int, float], n: int, p: float, own: float) -> float:
    """Interpolated quantile of n values minus one copy of ``own``, from nearby order statistics."""
    at = p * (n - 2)
    low = int(np.floor(at))
    pick = lambda i: values[i] if values[i] < own else values[i + 1]
    first = pick(low)
    return first if at == low else first + (pick(low + 1) - first) * (at - low)


def _complete(own: Sequence[str], patterns: Sequence[str]) -> np.ndarray:
    """(pattern, row): whether a row has every feature of a pattern; both as strings of 0 and 1."""
    bits = lambda flags: np.array([list(f.encode()) for f in flags], dtype=np.uint8).reshape(len(flags), -1) - ord("0")
    if not len(own) or not len(patterns):
        return np.zeros((len(patterns), len(own)), bool)
    kinds, kind = np.unique(np.asarray(own, dtype=object).astype(str), return_inverse=True)
    have, need = bits(kinds).astype(np.float32), bits(patterns).astype(np.float32)
    return (need @ (1 - have).T == 0)[:, kind]


def _daily_sizes(rows: pd.DataFrame, asks: pd.DataFrame) -> list[tuple]:
    """(pattern, dates, rows up to each that have the pattern) of one block of values."""
    rows = rows.sort_values(DATE, kind="stable")
    day, c = rows[DATE].to_numpy(), rows["c"].to_numpy()
    out = []
    for pattern, dates, ok in zip(asks["pattern"], asks["dates"], _complete(rows["own"], list(asks["pattern"])), strict=True):
        at = np.searchsorted(day[ok], np.array(dates, dtype=object), side="right")
        out.append((pattern, dates, np.concatenate([[0], np.cumsum(c[ok])])[at]))
    return out


def _values_at(rows: pd.DataFrame, asks: pd.DataFrame) -> list[np.ndarray]:
    """For every ask (pattern, Date, local ranks) the values of these ranks in a block sorted by value."""
    rows = rows.sort_values("v", kind="stable")
    v, c, day = rows["v"].to_numpy(), rows["c"].to_numpy(), rows[DATE].to_numpy()
    patterns = list(dict.fromkeys(asks["pattern"]))
    complete = dict(zip(patterns, _complete(rows["own"], patterns), strict=True))
    out = []
    for pattern, d, local in zip(asks["pattern"], asks[DATE], asks["local"], strict=True):
        ends = np.cumsum(np.where(complete[pattern] & (day <= d), c, 0))
        out.append(v[np.searchsorted(ends, np.asarray(local), side="right")])
    return out


def _scaling_statistics(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Order statistics of every feature over the growing history of each pattern.

    ``rows`` holds (own, Date, x), ``asked`` the (pattern, Date) pairs that need scaling. A row is read once per feature
    it has, whatever the patterns: values are collapsed to counts per date and missing-value mask and cut into value
    blocks; every pattern asks every block of its features how many of its rows count by each date, and then only the
    blocks that hold a wanted rank for the value.
    """
    long = rows.select("own", DATE, F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull())
    counts = long.groupBy("own", "f", DATE, "v").agg(F.count("*").alias("c"))
    if blocks > 1:
        blocked = assign_blocks(counts, ["f"], "v", blocks).withColumnRenamed("__block", "b")
    else:
        blocked = counts.withColumn("b", F.lit(0))
    blocked = blocked.select("own", "f", DATE, "v", "c", "b")
    has = F.filter(F.sequence(F.lit(0), F.length("pattern") - 1), lambda i: F.substring("pattern", i + 1, F.lit(1)) == "1")
    asks = asked.groupBy("pattern").agg(F.sort_array(F.collect_set(DATE)).alias("dates")).withColumn("f", F.explode(has))
    schema = f"pattern string, f int, {DATE} date, n long, ranks array<long>, values array<double>"

    def alone(pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        """One block per feature: the ranks are known at once."""
        out = []
        if len(pdf):
            for pattern, dates, sizes in _daily_sizes(pdf, want):
                out += [(pattern, d, int(n), _order_positions(int(n))) for d, n in zip(dates, sizes, strict=True) if n]
        frame = pd.DataFrame(out, columns=["pattern", DATE, "n", "local"])
        if not len(frame):
            return pd.DataFrame(columns=["pattern", "f", DATE, "n", "ranks", "values"])
        values = _values_at(pdf, frame)
        f = int(pdf["f"].iloc[0])
        return frame.assign(f=f, ranks=frame["local"], values=[x.tolist() for x in values])[["pattern", "f", DATE, "n", "ranks", "values"]]

    if blocks == 1:
        found = blocked.groupBy("f").cogroup(renewed(asks).groupBy("f")).applyInPandas(alone, schema)
    else:
        found = _statistics_by_blocks(blocked, asks)
    return found.groupBy("pattern", DATE).agg(F.collect_list(F.struct("f", "n", "ranks", "values")).alias("stats"))


def _statistics_by_blocks(blocked: DataFrame, asks: DataFrame) -> DataFrame:
    """``_scaling_statistics`` where a feature has several blocks of values: sizes first, then the values of the ranks."""
    per_block = blocked.select("f", "b").distinct().join(asks, "f")

    def sizes(pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(want):
            f, b = int(pdf["f"].iloc[0]), int(pdf["b"].iloc[0])
            for pattern, dates, n in _daily_sizes(pdf, want):
                out += [(pattern, f, d, b, int(x)) for d, x in zip(dates, n, strict=True) if x]
        return pd.DataFrame(out, columns=["pattern", "f", DATE, "b", "n"])

    counted = (
        blocked.groupBy("f", "b").cogroup(renewed(per_block).groupBy("f", "b")).applyInPandas(sizes, f"pattern string, f int, {DATE} date, b int, n long")
    )
    lists = counted.groupBy("pattern", "f", DATE).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("blocks"))

    def ranks(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                number = np.array([x["b"] for x in row.blocks])
                size = np.array([x["n"] for x in row.blocks])
                ends = np.cumsum(size)
                n = int(ends[-1])
                wanted = np.array(_order_positions(n), dtype=np.int64)
                at = np.searchsorted(ends, wanted, side="right")
                for j in np.unique(at):
                    own = wanted[at == j]
                    out.append((row.pattern, row.f, getattr(row, DATE), int(number[j]), n, own.tolist(), (own - (ends[j] - size[j])).tolist()))
            yield pd.DataFrame(out, columns=["pattern", "f", DATE, "b", "n", "ranks", "local"])

    wanted = lists.mapInPandas(ranks, f"pattern string, f int, {DATE} date, b int, n long, ranks array<long>, local array<long>")

    def look_up(pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(want):
            return pd.DataFrame(columns=["pattern", "f", DATE, "n", "ranks", "values"])
        values = [x.tolist() for x in _values_at(pdf, want)]
        return want.assign(values=values)[["pattern", "f", DATE, "n", "ranks", "values"]]

    schema = f"pattern string, f int, {DATE} date, n long, ranks array<long>, values array<double>"
    return blocked.groupBy("f", "b").cogroup(renewed(wanted).groupBy("f", "b")).applyInPandas(look_up, schema)


def _spreads(stats, x: np.ndarray) -> np.ndarray:
    """Interquartile range of each feature over the history without the row itself, 1 where it is zero or unknown."""
    values: dict[int, dict[int, float]] = {}
    sizes: dict[int, int] = {}
    for s in stats:
        values.setdefault(s["f"], {}).update(zip(s["ranks"], s["values"], strict=True))
        sizes[s["f"]] = int(s["n"])
    out = np.ones(len(x))
    for f, known in values.items():
        if sizes[f] > 1:
            low, high = (_quartile_without(known, sizes[f], p, x[f]) for p in SCALING_QUANTILES)
            out[f] = (high - low) or 1.0
    return out


def _weighted_average(i: int) -> Column:
    """Inverse-distance mean of the i-th value over the neighbours that have it."""
    valid = F.filter("best", lambda b: b["y"][i].isNotNull())
    weight = F.aggregate(valid, F.lit(0.0), lambda a, b: a + 1 / (b["distance"] + WEIGHT_EPSILON))
    total = F.aggregate(valid, F.lit(0.0), lambda a, b: a + b["y"][i] / (b["distance"] + WEIGHT_EPSILON))
    return F.when(F.size(valid) > 0, total / weight)


def knn_impute(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = 5,
    mask: DataFrame | None = None,
    features: Sequence[str] | None = None,
    metric: str = "euclidean",
    normalise: bool = True,
) -> DataFrame:
    """Fill masked cells from the ``k`` nearest rows dated the same day or earlier.

    A row is compared on the features it has, with history rows that have them
    all, after scaling each feature by its interquartile range over
    exactly that history. Neighbours weigh by inverse distance. Every cell is
    computed from the panel as given, never from cells filled in the same pass.
    The panel is checkpointed first because several steps read it.

    Rows carry their gaps inside the array of their features: a row is never
    copied per pattern of gaps. Rows lie in cells of similar rows; the ranges
    of a cell bound how near it can come under the scaling of any row, so a row
    meets few cells.
    """
    if check_metric(metric) == "cosine":
        raise ValueError("neighbour imputation compares by euclidean or manhattan distance")
    return _knn_pass(cut_lineage(df), columns, k, mask, features, metric, normalise)


def _cells(rows_: DataFrame, targets: DataFrame) -> tuple[BoxCells, DataFrame, dict[int, int]]:
    """Cells with what is known of them, the rows with their cell, and rows per cell."""
    sample = rows_.orderBy(F.xxhash64(*KEYS)).limit(SAMPLE).select("x").collect()
    if not sample:
        return BoxCells((), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)), rows_.withColumn("cell", F.lit(0)), {}
    x = np.array([r["x"] for r in sample], dtype=float)
    used = targets.agg(*[F.avg(F.substring("pattern", i + 1, 1).cast("double")).alias(f"u{i}") for i in range(x.shape[1])]).first()
    cut = BoxCells.cut(x, cells_for(rows_.count()), np.array([u or 0.0 for u in used]))
    empty = BoxCells(cut)
    schema = rows_.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def place(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=empty.assign(np.array(batch["x"].tolist(), dtype=float)))

    placed = cut_lineage(rows_.mapInPandas(place, f"{schema}, cell int"))

    def ranges(batches):
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("cell", kind="stable")
            number, start, n = np.unique(batch["cell"].to_numpy(), return_index=True, return_counts=True)
            x = np.array(batch["x"].tolist(), dtype=float)
            there = ~np.isnan(x)
            low = np.minimum.reduceat(np.where(there, x, np.inf), start, axis=0)
            high = np.maximum.reduceat(np.where(there, x, -np.inf), start, axis=0)
            first = np.minimum.reduceat(np.array([d.toordinal() for d in batch[DATE]]), start)
            yield pd.DataFrame(
                {
                    "low": low.tolist(),
                    "high": high.tolist(),
                    "n": n,
                    "first": [date.fromordinal(int(d)) for d in first],
                    "cell": number.astype(np.int32),
                }
            )

    def merge(key, own: pd.DataFrame) -> pd.DataFrame:
        stack = lambda c: np.array(own[c].tolist(), dtype=float)
        low, high = stack("low").min(axis=0), stack("high").max(axis=0)
        return pd.DataFrame({"low": [low.tolist()], "high": [high.tolist()], "n": [own["n"].sum()], "first": [min(own["first"])], "cell": [key[0]]})

    kind = "low array<double>, high array<double>, n long, first date, cell int"
    found = placed.select(DATE, "x", "cell").mapInPandas(ranges, kind).groupBy("cell").applyInPandas(merge, kind).collect()
    size = 1 + max(r["cell"] for r in found)
    width = len(found[0]["low"])
    low, high, first = np.full((size, width), np.inf), np.full((size, width), -np.inf), np.full(size, np.inf)
    for r in found:
        low[r["cell"]], high[r["cell"]], first[r["cell"]] = r["low"], r["high"], r["first"].toordinal()
    return BoxCells(cut, low, high, first), placed, {r["cell"]: r["n"] for r in found}


def _knn_pass(df: DataFrame, columns, k: int, mask: DataFrame | None, features=None, metric="euclidean", normalise=True) -> DataFrame:
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns and c not in KEYS]
    features = list(features or numeric_columns(df))
    flags = mask if mask is not None else df.select(*KEYS, *[q(c).isNull().alias(c) for c in columns])
    masked = [c for c in columns if c in flags.columns]
    wanted = F.array(*[F.coalesce(q(c), F.lit(False)) for c in masked])
    asks = flags.select(*KEYS, wanted.alias("want")).where(F.exists("want", lambda b: b))

    rows_ = df.select(
        *KEYS,
        F.array(*[q(c).cast("double") for c in features]).alias("x"),
        F.array(*[q(c).cast("double") for c in masked]).alias("y"),
        F.concat(*[F.when(q(c).isNotNull(), "1").otherwise("0") for c in features]).alias("own"),
    )
    targets = rows_.join(asks, list(KEYS)).where(F.col("own").contains("1")).select(*KEYS, "x", F.col("own").alias("pattern"))
    # Equal rows of a date ask once, for one neighbour more, as each leaves out itself: where few values occur, very many
    # rows are equally near, and every one of them would meet all cells that hold these values.
    alike = [DATE, "pattern", "x"]
    members, together = targets, largest_group(rows_, KEYS) <= 1
    if together:
        targets = members.groupBy(*alike).agg(F.min(ENTITY).alias(ENTITY)).select(*KEYS, "x", "pattern")
    wanted_k = k + 1 if together else k
    if normalise:
        stats = _scaling_statistics(rows_.select("own", DATE, "x"), targets.select("pattern", DATE), parts_for(df.count(), VALUES_PER_BLOCK))
        targets = targets.join(stats, ["pattern", DATE], "left")

    def scaled(batches):
        for pdf in batches:
            x = [np.array(r, dtype=float) for r in pdf["x"]]
            stats = pdf["stats"] if normalise else [None] * len(pdf)
            spreads = [_spreads(s, own).tolist() if s is not None else [1.0] * len(own) for s, own in zip(stats, x, strict=True)]
            yield pd.DataFrame({ENTITY: pdf[ENTITY], DATE: pdf[DATE], "x": pdf["x"], "pattern": pdf["pattern"], "scale": spreads})

    kind = f"{ENTITY} string, {DATE} date, x array<double>, pattern string, scale array<double>"
    targets = cut_lineage(targets.mapInPandas(scaled, kind))
    cells, placed, sizes = _cells(rows_.select(*KEYS, "x", "y"), targets)

    schema = f"{ENTITY} string, {DATE} date, n_country string, n_date date, distance double, y array<double>"

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values([ENTITY, DATE])
            every = np.array(candidates["x"].tolist(), dtype=float)
            country, day = candidates[ENTITY].to_numpy(), candidates[DATE].to_numpy()
            ordinal = np.array([d.toordinal() for d in day])
            y = candidates["y"].to_numpy()
            for pattern, own in queries.groupby("pattern", sort=False):
                used = np.flatnonzero(np.frombuffer(pattern.encode(), np.uint8) == ord("1"))
                usable = np.flatnonzero(~np.isnan(every[:, used]).any(axis=1))
                if not len(usable):
                    continue
                points = every[np.ix_(usable, used)]
                step = max(1, HELD_NUMBERS // len(usable))
                for at in range(0, len(own), step):
                    part = own.iloc[at : at + step]
                    x, scale = (np.array(part[c].tolist(), dtype=float)[:, used] for c in ("x", "scale"))
                    d = np.zeros((len(part), len(usable)))
                    for f in range(len(used)):
                        gap = np.abs(points[:, f][None, :] - x[:, f][:, None]) / scale[:, f][:, None]
                        d += gap if metric == "manhattan" else gap * gap
                    d = d if metric == "manhattan" else np.sqrt(d)
                    asked = np.array([t.toordinal() for t in part[DATE]])
                    d[ordinal[usable][None, :] > asked[:, None]] = np.inf
                    if not together:
                        d[(part[ENTITY].to_numpy()[:, None] == country[usable][None, :]) & (asked[:, None] == ordinal[usable][None, :])] = np.inf
                    row, column = nearest(d, wanted_k)
                    found = usable[column]
                    out.append(
                        pd.DataFrame(
                            {
                                ENTITY: part[ENTITY].to_numpy()[row],
                                DATE: part[DATE].to_numpy()[row],
                                "n_country": country[found],
                                "n_date": day[found],
                                "distance": d[row, column],
                                "y": y[found],
                            }
                        )
                    )
        if out:
            return pd.concat(out, ignore_index=True)
        return pd.DataFrame({c: pd.Series(dtype="object") for c in (ENTITY, DATE, "n_country", "n_date", "distance", "y")}).astype({"distance": "float64"})

    near = search(targets, placed, list(KEYS), wanted_k, sizes, BoxTree(cells, metric), meet, schema)
    best = near.groupBy(*KEYS).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "n_country", "n_date", "y"))), 1, wanted_k).alias("best")
    )
    if together:
        shared = best.join(targets, list(KEYS)).select(*alike, "best")
        others = F.filter("best", lambda b: (b["n_country"] != F.col(ENTITY)) | (b["n_date"] != F.col(DATE)))
        best = members.join(shared, alike).select(*KEYS, F.slice(others, 1, k).alias("best"))
    averages = [_weighted_average(i).alias(f"__v_{i}") for i in range(len(masked))]
    filled = df.join(asks, list(KEYS), "left").join(best.select(*KEYS, *averages), list(KEYS), "left")
    exprs = {
        c: F.when(F.coalesce(F.col("want")[i], F.lit(False)) & F.col(f"__v_{i}").isNotNull(), F.col(f"__v_{i}")).otherwise(q(c))
        for i, c in enumerate(masked)
    }
    return replace_columns(filled, exprs).select(*[q(c) for c in df.columns])


STAGES = ("interior", "trailing", "leading", "all")


def knn_impute_staged(
    df: DataFrame,
    stages: Sequence[tuple[str, int]],
    columns: Sequence[str] | None = None,
    donors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Several neighbour passes, each for one kind of gap with its own ``k``.

    Donor rows are appended for the passes and removed again. Every pass reads
    the result of the one before from a checkpoint, which also bounds the plan.
    """
    own = df.select(ENTITY).distinct()
    panel = df.unionByName(donors, allowMissingColumns=True).select(*df.columns) if donors is not None else df
    for kind, k in stages:
        if kind not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}")
        panel = cut_lineage(panel)
        if kind == "all":
            mask = None
        else:
            mask = imputation_mask(panel, columns, include_before=kind == "leading", include_after=kind == "trailing")
        panel = _knn_pass(panel, columns, k, mask, **options)
    return filter_countries(panel, include=own) if donors is not None else panel


def _unit_root(x: np.ndarray) -> bool:
    """Regression test for a unit root with a constant; 5 % critical value for its t-ratio."""
    d = np.diff(x)
    if len(d) < 4 or np.ptp(d) == 0:
        return False
    design = np.column_stack([np.ones(len(d)), x[:-1]])
    beta, *_ = np.linalg.lstsq(design, d, rcond=None)
    resid = d - design @ beta
    var = resid @ resid / max(len(d) - 2, 1)
    inverse = np.linalg.pinv(design.T @ design)
    se = np.sqrt(max(var * inverse[1, 1], 1e-300))
    return bool(beta[1] / se > -2.86)


@dataclass(frozen=True)
class Arma:
    """x[t] = constant + sum ar[i] x[t-1-i] + e[t] + sum ma[j] e[t-1-j], with the errors of the series it was fitted to."""

    constant: float
    ar: np.ndarray
    ma: np.ndarray
    errors: np.ndarray

    def ahead(self, x: np.ndarray, steps: int) -> np.ndarray:
        """What follows the series, later errors taken as zero."""
        values, errors = list(x), list(self.errors)
        for _ in range(steps):
            value = self.constant
            value += sum(c * values[-1 - i] for i, c in enumerate(self.ar))
            value += sum(c * errors[-1 - j] for j, c in enumerate(self.ma))
            values.append(value)
            errors.append(0.0)
        return np.array(values[len(x) :])


def _lags(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """Columns of x one to ``n`` steps back, for the rows from ``start`` on, zero before the series."""
    padded = np.concatenate([np.zeros(n), x])
    return np.column_stack([padded[n + start - i : n + len(x) - i] for i in range(1, n + 1)]) if n else np.zeros((len(x) - start, 0))


def _errors(z: np.ndarray, beta: np.ndarray, p: int, q_: int) -> np.ndarray:
    """One-step errors of a standardised series under coefficients (constant, ar, ma), zero before row p."""
    out = np.zeros(len(z) + q_)
    plain = np.zeros(len(z))
    plain[p:] = z[p:] - beta[0] - _lags(z, p, p) @ beta[1 : 1 + p]
    for t in range(p, len(z)):
        out[t + q_] = plain[t] - sum(beta[1 + p + j] * out[t + q_ - 1 - j] for j in range(q_))
    return out[q_:]


# Share of the variance that counts as none, so that series that fit exactly take the fewest terms.
EXACT_FIT = 1e-12


def fit_arma(x: np.ndarray, max_p: int = 5, max_q: int = 5) -> Arma:
    """Two-stage least squares with the orders of the lowest AIC.

    A long autoregression estimates the errors; the series is then regressed on its own lags and on lagged errors. The
    cross products of all lags are formed once, and every pair of orders solves its part of them. Orders whose errors
    would grow without bound are left out. A series too short for a term goes without it.
    """
    n, centre = len(x), x.mean()
    scale = x.std() or 1.0
    z = (x - centre) / scale
    long = min(max(max_p, max_q) + 3, (n - 2) // 3)
    design = np.column_stack([np.ones(n - long), _lags(z, long, long)])
    errors = np.zeros(n)
    errors[long:] = z[long:] - design @ np.linalg.lstsq(design, z[long:], rcond=None)[0]
    max_p, max_q = min(max_p, (n - 2) // 3), min(max_q, (n - 2 - long) // 4)
    start = min(max(max_p, long), n - 2)
    every = np.column_stack([np.ones(n - start), _lags(z, max_p, start), _lags(errors, max(max_q, 0), start), z[start:]])
    gram = every.T @ every
    orders = [(p, q_) for p in range(max_p + 1) for q_ in range(max(max_q, 0) + 1) if p + q_ + 2 <= n - start]
    columns = lambda p, q_: [0, *range(1, 1 + p), *range(1 + max_p, 1 + max_p + q_)]
    used = np.zeros((len(orders), len(gram) - 1), bool)
    for i, order in enumerate(orders):
        used[i, columns(*order)] = True
    # all pairs of orders at once: what an order does not use is replaced by the identity
    systems = np.where(used[:, :, None] & used[:, None, :], gram[:-1, :-1], 0.0)
    systems += np.where(used, EXACT_FIT * n, 1.0)[:, :, None] * np.eye(len(gram) - 1)
    right = np.where(used, gram[:-1, -1], 0.0)
    betas = np.linalg.solve(systems, right[:, :, None])[:, :, 0]
    left = gram[-1, -1] - 2 * (betas * right).sum(axis=1) + np.einsum("oi,ij,oj->o", betas, gram[:-1, :-1], betas)
    aic = (n - start) * np.log(np.maximum(left / (n - start), EXACT_FIT)) + 2 * (used.sum(axis=1) + 1)
    for i in sorted(range(len(orders)), key=lambda i: (round(aic[i], 6), sum(orders[i]), orders[i][1])):
        p, q_ = orders[i]
        beta = np.linalg.lstsq(every[:, columns(p, q_)], every[:, -1], rcond=None)[0]
        roots = np.abs(np.roots(np.concatenate([[1.0], beta[1 + p :]]))) if q_ else np.zeros(1)
        if roots.max(initial=0.0) < 1.0:
            ar = beta[1 : 1 + p]
            return Arma(centre + scale * beta[0] - centre * ar.sum(), ar, beta[1 + p :], scale * _errors(z, beta, p, q_))
    return Arma(centre, np.zeros(0), np.zeros(0), x - centre)


def forecast(x: np.ndarray, steps: int, max_p: int = 5, max_d: int = 2, max_q: int = 5) -> np.ndarray:
    """Forecast of a series by autoregressive and moving-average terms on its differences."""
    if np.ptp(x) == 0:
        return np.full(steps, x[0])
    levels = [x]
    while len(levels) <= max_d and len(levels[-1]) > 6 and _unit_root(levels[-1]):
        levels.append(np.diff(levels[-1]))
    out = fit_arma(levels[-1], max_p, max_q).ahead(levels[-1], steps)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    return out


MIN_OBSERVATIONS = 6


def _fill_series(x: np.ndarray) -> np.ndarray:
    """Fill the gaps after the first value, each from all values before it, filled ones included."""
    known = ~np.isnan(x)
    if not known.any():
        return x
    x = x.copy()
    first = int(known.argmax())
    edges = np.flatnonzero(np.diff(np.concatenate([known[first:], [True]]).astype(np.int8)))
    for start, end in (edges.reshape(-1, 2) + first + 1).tolist():  # a gap opens where known turns to unknown
        ahead = forecast(x[first:start], end - start) if start - first >= MIN_OBSERVATIONS else np.array([np.nan])
        if not np.isfinite(ahead).all():
            break
        x[start:end] = ahead
    return x


def forecast_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps of every series by forecasting from its own past.

    Series are independent and bounded by the calendar: one group per (Country,
    variable), all columns at once.
    """
    columns = list(columns or numeric_columns(df))
    long = to_long(df, columns)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        return pdf.assign(value=_fill_series(pdf["value"].to_numpy(dtype=float, na_value=np.nan)))

    filled = spread(long, ENTITY, "variable").groupBy(ENTITY, "variable").applyInPandas(one, long.schema)
    filled = filled.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    wide = to_wide(filled, columns)
    rest = [c for c in df.columns if c not in columns and c not in KEYS]
    if rest:
        wide = df.select(*KEYS, *[q(c) for c in rest]).join(wide, list(KEYS))
    return wide.select(*[q(c) for c in df.columns])


MIN_TRAINING_ROWS = 10
# Matrix cells a task holds before it passes its sums on.
MAX_HELD_CELLS = 4_000_000


def regression_impute(
    df: DataFrame,
    columns: Sequence[str],
    mask: DataFrame | None = None,
    ridge: float = 1e-6,
    estimator=None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Predict masked cells of a date from a regression on all earlier dates.

    Inputs are the other variables, or those of ``features`` (missing ones as
    0), the days since the first date, year and month. The default linear fit needs no loop: each date contributes its
    cross-product matrix, matrices are summed over earlier dates, and every
    date solves its own small system. ``estimator="trees"`` grows the regression
    trees of all dates together instead, without a loop over dates as well. Any
    MLlib regressor can be passed and is fitted once per date and column with
    masked cells.
    """
    from chronopanel.operators.encode import label_encode

    columns = list(columns)
    df = cut_lineage(df)  # read by every step below
    flags = mask if mask is not None else df.select(*KEYS, *[q(c).isNull().alias(c) for c in columns])
    coded = label_encode(df, ENTITY, "__code")
    first = df.agg(F.min(DATE)).scalar()
    variables = numeric_columns(df) if features is None else list(features)
    most = max(sum(v != c for v in variables) for c in columns)
    base = coded.withColumns(
        {"__days": F.datediff(DATE, first).cast("double"), "__year": F.year(DATE).cast("double"), "__month": F.month(DATE).cast("double")}
    )

    def inputs(c: str) -> list:
        others = [F.coalesce(q(v).cast("double"), F.lit(0.0)) for v in variables if v != c]
        others += [F.lit(0.0)] * (most - len(others))  # all targets' systems have one size
        return [*others, F.col("__code").cast("double"), F.col("__days"), F.col("__year"), F.col("__month")]

    joined = base.join(flags.select(*KEYS, *[q(c).alias(f"__w_{i}") for i, c in enumerate(columns)]), list(KEYS), "left")
    if estimator == "trees":
        return _regression_by_trees(joined, df, columns, inputs)
    if estimator is not None:
        return _regression_by_estimator(joined, df, columns, inputs, estimator)
    rows_ = joined.select(
        *KEYS,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"),
                        F.array(F.lit(1.0), *inputs(c)).alias("x"),
                        q(c).cast("double").alias("y"),
                        F.coalesce(F.col(f"__w_{i}"), F.lit(False)).alias("want"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("r"),
    ).select(*KEYS, "r.*")

    width = most + 5

    def products(batches):
        """Cross products per variable and date, summed inside the task before the shuffle."""
        sums: dict[tuple, np.ndarray] = {}

        def emit():
            keys = list(sums)
            frame = pd.DataFrame(
                {"variable": [v for v, _ in keys], DATE: [d for _, d in keys], "g": [sums[key].tolist() for key in keys]}
            )
            sums.clear()
            return frame

        for pdf in batches:
            every_x, every_y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(dtype=float)
            known = ~np.isnan(every_y)
            for key, at in pdf.groupby(["variable", DATE]).indices.items():
                at = at[known[at]]
                x, y = every_x[at], every_y[at]
                gram = np.concatenate([(x.T @ x).ravel(), x.T @ y, [float(len(y))]])
                sums[key] = sums[key] + gram if key in sums else gram
            if len(sums) * length > MAX_HELD_CELLS:
                yield emit()
        if sums:
            yield emit()

    length = width * width + width + 1
    partial = rows_.select("variable", DATE, "x", "y").mapInPandas(products, f"variable string, {DATE} date, g array<double>")
    cells = partial.select("variable", DATE, F.posexplode("g").alias("i", "v"))
    daily = cells.groupBy("variable", DATE, "i").agg(F.sum("v").alias("v"))
    # One row per calendar day and matrix cell.
    before = Window.partitionBy("variable", "i").orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = daily.select("variable", DATE, "i", F.sum("v").over(before).alias("v"))
    systems = earlier.groupBy("variable", DATE).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g")
    )

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series) -> pd.Series:
        out = []
        for cell in g:
            a = np.array([np.nan if v is None else v for v in cell], dtype=float)
            if len(a) != length or np.isnan(a).any() or a[-1] < MIN_TRAINING_ROWS:
                out.append(None)
                continue
            gram, xty = a[: width * width].reshape(width, width), a[width * width : -1]
            size = np.sqrt(np.maximum(np.diag(gram), 1e-12))
            scaled = gram / np.outer(size, size) + ridge * np.eye(width)
            out.append((np.linalg.solve(scaled, xty / size) / size).tolist())
        return pd.Series(out)

    fits = systems.select("variable", DATE, solve("g").alias("beta"))
    asked = rows_.where("want AND y IS NULL").join(fits, ["variable", DATE]).where("beta IS NOT NULL")
    predicted = asked.select(
        *KEYS, "variable", F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("value")
    )
    wide = to_wide(predicted, columns).select(*KEYS, *[q(c).alias(f"__p_{c}") for c in columns])
    return replace_columns(df.join(wide, list(KEYS), "left"), {c: F.coalesce(q(c), q(f"__p_{c}")) for c in columns}).select(
        *[q(c) for c in df.columns]
    )


def _regression_by_trees(joined: DataFrame, df: DataFrame, columns, inputs) -> DataFrame:
    """The trees of a date learn from all rows of earlier dates, those of all dates grow at once."""
    days = [r[0] for r in df.select(DATE).where(F.col(DATE).isNotNull()).distinct().orderBy(DATE).collect()]  # calendar days
    place = joined.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days)], f"{DATE} DATE, __day INT")
    placed = cut_lineage(joined.join(place, DATE))
    pieces = None
    for i, c in enumerate(columns):
        names = [f"__x{j}" for j in range(len(inputs(c)))]
        rows_ = placed.select(
            *KEYS, *[e.alias(n) for e, n in zip(inputs(c), names, strict=True)], q(c).cast("double").alias("label"),
            (F.col("__day") + 1).alias("first"), F.lit(len(days)).alias("until"), "__day", F.col(f"__w_{i}").alias("want"),
        )
        forest = expanding.fit(rows_.drop("want"), names, len(days), least_rows=MIN_TRAINING_ROWS // 2)
        asked = rows_.where("want AND label IS NULL")
        part = expanding.predict(asked, forest, "__day", list(KEYS)).select(*KEYS, F.lit(c).alias("variable"), F.col("prediction").alias("value"))
        pieces = part if pieces is None else pieces.unionByName(part)
    wide = to_wide(pieces, columns).select(*KEYS, *[q(c).alias(f"__p_{c}") for c in columns])
    return replace_columns(df.join(wide, list(KEYS), "left"), {c: F.coalesce(q(c), q(f"__p_{c}")) for c in columns}).select(
        *[q(c) for c in df.columns]
    )


def _regression_by_estimator(joined: DataFrame, df: DataFrame, columns, inputs, estimator) -> DataFrame:
    """One MLlib fit per date and column with masked cells."""
    from pyspark.ml.functions import array_to_vector

    pieces = None
    for i, c in enumerate(columns):
        rows_ = joined.select(
            *KEYS, array_to_vector(F.array(*inputs(c))).alias("features"), q(c).cast("double").alias("label"), F.col(f"__w_{i}").alias("want")
        )
        asked = rows_.where("want AND label IS NULL")
        days = [r[0] for r in asked.select(DATE).distinct().orderBy(DATE).collect()]  # calendar days
        for day in days:
            train = rows_.where((F.col(DATE) < F.lit(day)) & F.col("label").isNotNull())
            if train.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
                continue
            found = estimator.fit(train).transform(asked.where(F.col(DATE) == F.lit(day)))
            part = found.select(*KEYS, F.lit(c).alias("variable"), F.col("prediction").alias("value"))
            pieces = part if pieces is None else pieces.unionByName(part)
    if pieces is None:
        return df
    wide = to_wide(pieces, columns).select(*KEYS, *[q(c).alias(f"__p_{c}") for c in columns])
    return replace_columns(df.join(wide, list(KEYS), "left"), {c: F.coalesce(q(c), q(f"__p_{c}")) for c in columns}).select(
        *[q(c) for c in df.columns]
    )
