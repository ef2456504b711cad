"""Trees for many growing training sets at once.

Every group (a date, a window) trains on the rows that are active in it: a row is so from one group on, and possibly up to
another. Features are binned once. Trees of all groups grow together, level by level: wherever the trees of several groups
have taken the same splits so far, they share that path, and one histogram of the rows on it, by the group from which on
(or up to which) a row counts, gives each of them its own by a running sum over groups. Rows are read once per level,
copied for no group, and the number of jobs depends on the depth alone. What reaches the driver are splits: groups, trees
and 2^depth bound them.

A forest weighs rows by a hash of row and tree, as drawing with replacement would, and gives each node a share of the
features. Bin edges are quantiles over all rows, later ones too: they limit where splits can be and carry no label.
Missing values have a bin of their own, below all others. Equal gains go to the first feature and the lowest edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.schema import cut_lineage, q

BINS = 32
# Smallest gain that is worth a split, as a share of the node's sum of squares about zero.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Forest:
    """Per group, tree and node (children of i at 2i + 1 and 2i + 2): feature or -1, last bin that goes left, mean label."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def predict(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mean over trees of the leaves that rows of these groups fall into; NaN where a group has no trees."""
        b, out = self.bins(x), np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.feature.shape[1]):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[group, t, node]
                if (f < 0).all():
                    break
                right = b[rows, np.maximum(f, 0)] > self.cut[group, t, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out += self.value[group, t, node]
        return out / max(self.feature.shape[1], 1)

    def importances(self, group: int) -> np.ndarray:
        """Share of each feature in the gains of a group."""
        total = np.zeros(len(self.features))
        used = self.feature[group] >= 0
        np.add.at(total, self.feature[group][used], self.gain[group][used])
        return total / total.sum() if total.sum() > 0 else total


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for missing values, then 1 + the number of edges below a value."""
    out = np.zeros(x.shape, dtype=np.int16)
    for f, own in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(own, x[:, f], side="left"))
    return out


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


# Chances of at most 0, 1, 2, 3, 4 draws of a row when as many rows as there are are drawn with replacement.
DRAWS = np.cumsum(np.exp(-1.0) / np.array([1.0, 1.0, 2.0, 6.0, 24.0]))


def draws(keys: np.ndarray, tree: int, trees: int) -> np.ndarray:
    """How often a tree draws each row; once if there is only one tree."""
    if trees == 1:
        return np.ones(len(keys))
    return np.searchsorted(DRAWS, _hash(keys, tree + 1) / 2.0**64).astype(float)


def best_split(n: np.ndarray, s: np.ndarray, least_rows: int, allowed: np.ndarray) -> tuple:
    """(feature, cut, gain, left n, left s) of a node's histograms (feature x bin); feature -1 if no split is worth it."""
    total_n, total_s = n[0].sum(), s[0].sum()
    left_n, left_s = np.cumsum(n, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    right_n, right_s = total_n - left_n, total_s - left_s
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - total_s**2 / total_n
    gain[~((left_n >= least_rows) & (right_n >= least_rows)) | ~allowed[:, None]] = -np.inf
    gain = np.where(np.isfinite(gain), np.round(gain, 9), -np.inf)
    at = int(gain.argmax())
    f, cut = divmod(at, gain.shape[1])
    if not gain[f, cut] > LEAST_GAIN * max(total_s**2 / max(total_n, 1e-300), 1e-300):
        return -1, 0, 0.0, 0.0, 0.0
    return f, cut, float(gain[f, cut]), float(left_n[f, cut]), float(left_s[f, cut])


def allowed_features(n: int, share: float, tree: int, node: int) -> np.ndarray:
    """The features a node may split on: at least one, chosen by a hash of tree and node."""
    rank = np.argsort(_hash(np.arange(n), 1 + tree * 4096 + node))
    out = np.zeros(n, bool)
    out[rank[: max(1, round(share * n))]] = True
    return out


def fit(
    rows: DataFrame,
    features: Sequence[str],
    groups: int,
    label: str = "label",
    first: str = "first",
    until: str = "until",
    depth: int = 4,
    trees: int = 1,
    feature_share: float = 1.0,
    least_rows: int = 5,
) -> Forest:
    """Trees of all groups from rows with a label, active in the groups from ``first`` up to but not with ``until``."""
    features = tuple(features)
    width, size = len(features), 2 ** (depth + 1) - 1
    ready = cut_lineage(
        rows.where(q(label).isNotNull()).select(
            *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
            q(label).cast("double").alias("y"), q(first).cast("int").alias("first"), q(until).cast("int").alias("until"),
            F.xxhash64(*[q(c) for c in rows.columns]).alias("h"),
        )
    )
    names = [f"x{i}" for i in range(width)]
    shares = [i / BINS for i in range(1, BINS)]
    cuts = ready.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names]).approxQuantile(names, shares, 0.001)
    edges = tuple(np.unique(np.array(c, dtype=float)) for c in cuts)
    most = 1 + max(len(e) + 1 for e in edges) if edges else 1
    shape = (groups, trees, size)
    feature, cut = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    value, gain = np.full(shape, np.nan), np.zeros(shape)
    # a path is a tree with the splits taken so far; the groups that have taken them and the node they are at
    paths: dict[tuple, list[int]] = {(t, 0, ()): list(range(groups)) for t in range(trees)}

    def counter(known: list[tuple]):
        """Histograms of a task's rows on every path, by the group from which on they count or no longer do."""

        def count(batches):
            for batch in batches:
                b = binned(batch[names].to_numpy(dtype=float, na_value=np.nan), edges)
                y, h = batch["y"].to_numpy(float), batch["h"].to_numpy(np.int64)
                turns = ((batch["first"].to_numpy(np.int64), 1.0), (batch["until"].to_numpy(np.int64), -1.0))
                for number, (t, _, splits) in enumerate(known):
                    on = draws(h, t, trees)
                    for f, c, right in splits:
                        on = np.where((b[:, f] > c) == right, on, 0.0)
                    for at, sign in turns:
                        live = np.flatnonzero((on > 0) & (at < groups))
                        if not len(live):
                            continue
                        cell = ((at[live][:, None] * width + np.arange(width)) * most + b[live]).reshape(-1)
                        weight = np.repeat(sign * on[live], width)
                        cells, place = np.unique(cell, return_inverse=True)
                        n = np.bincount(place, weight)
                        s = np.bincount(place, weight * np.repeat(y[live], width))
                        yield pd.DataFrame({"path": number, "cell": cells, "n": n, "s": s})

        return count

    def chooser(known: list[tuple], members: list[list[int]], last: bool):
        """The best split of every group on a path, from its own running sums."""

        def choose(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
            t, node, _ = known[key[0]]
            table = np.zeros((2, groups * width * most))
            table[:, cells["cell"].to_numpy()] = cells[["n", "s"]].to_numpy().T
            n, s = np.cumsum(table.reshape(2, groups, width, most), axis=1)
            allowed = allowed_features(width, feature_share, t, node)
            out = []
            for g in members[key[0]]:
                found = (-1, 0, 0.0) if last else best_split(n[g], s[g], least_rows, allowed)[:3]
                out.append((key[0], g, *found, n[g, 0].sum(), s[g, 0].sum()))
            return pd.DataFrame(out, columns=["path", "g", "feature", "cut", "gain", "n", "s"])

        return choose

    for level in range(depth + 1):
        known = list(paths)
        cells = ready.mapInPandas(counter(known), "path int, cell long, n double, s double")
        cells = cells.groupBy("path", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        chosen = "path int, g int, feature int, cut int, gain double, n double, s double"
        found = cells.groupBy("path").applyInPandas(chooser(known, list(paths.values()), level == depth), chosen).collect()
        grown: dict[tuple, list[int]] = {}
        for r in sorted(found, key=lambda r: (r["path"], r["g"])):
            t, node, splits = known[r["path"]]
            at = r["g"], t, node
            value[at] = r["s"] / r["n"] if r["n"] >= least_rows else np.nan
            if r["feature"] >= 0:
                feature[at], cut[at], gain[at] = r["feature"], r["cut"], r["gain"]
                for right in (0, 1):
                    child = (t, 2 * node + 1 + right, (*splits, (r["feature"], r["cut"], bool(right))))
                    grown.setdefault(child, []).append(r["g"])
        paths = grown
        if not paths:
            break
    return Forest(features, edges, feature, cut, value, gain)


def predict(rows: DataFrame, forest: Forest, group: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the prediction of each row by the trees of its group, null where there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    names = [f"x{i}" for i in range(len(forest.features))]
    inputs = rows.select(*[q(c) for c in keep], q(group).cast("int").alias("__g"), *[q(c).cast("double").alias(n) for c, n in zip(forest.features, names, strict=True)])

    @F.pandas_udf("double")
    def apply(g: pd.Series, x: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.predict(x.to_numpy(dtype=float, na_value=np.nan), g.to_numpy(np.int64)))

    found = inputs.withColumn("prediction", apply("__g", F.struct(*names)))
    return found.select(*[q(c) for c in keep], F.nanvl("prediction", F.lit(None).cast("double")).alias("prediction"))
