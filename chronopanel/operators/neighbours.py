"""Exact nearest neighbours that visit few cells.

Points are put into cells of points that lie together. Of every cell a little is known exactly: the range of every
feature (``BoxCells``) or the distances to its pivot (``PivotCells``), from which follows how near a query could be to
anything in it. Cells are visited best first: each query meets its nearest cell, which gives a distance its ``k``
neighbours cannot exceed, then in rounds of growing size the next ones, as long as they could hold something as near.
Cells of a tree are found by going down it (``BoxTree``), so their number does not count.
Where that would be many cells a query, as on data without structure, whole groups of cells are visited instead: then a
query is copied once per group of ``POINTS_PER_BLOCK`` points and not once per cell.
Where cells are cut follows a bounded sample; what is known of them, and so the result, covers all points. Cells and
queries meet in tasks of bounded size that compute distances with numpy and emit the best ``k`` per query; no pair of
rows is ever materialised. Points of graphs are first compared by a bound that costs a fraction of a distance (``closest``). On data without any structure every cell has to be visited.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.schema import DATE, cut_lineage, renewed, spread

# Points and queries that one task holds at once.
POINTS_PER_BLOCK = 50_000
QUERIES_PER_BATCH = 50_000
LEAST_BATCH = 4096
# Cells aim at this many points, within a range of cells that is small enough for every task.
POINTS_PER_CELL = 1024
LEAST_CELLS, MOST_CELLS = 8, 4096
# Rows that decide where cells are cut.
SAMPLE = 20_000
# Numbers a task works on at once.
HELD_NUMBERS = 2_000_000
# Rows and columns of distances computed together, few enough to stay in a core's cache.
TILE = (32, 4096)
# A round of a search visits so many times the cells visited before.
ROUND = 8
# Cells that a query may still have to visit, on average, after the second round; above, groups of cells are visited.
MOST_VISITS = 16
# Rows a task passes on at once: what it holds does not grow with the cells a query visits.
ROWS_AT_ONCE = 16_384
# What rounding may add to a bound.
SLACK = 1e-9
# Queries and points whose pairs are screened together.
SCREEN = {"euclidean": (256, 4096), "manhattan": (64, 4096)}
# Where a screen leaves more than one of so many pairs, or no limit is known, so many points are compared in full.
SCREENED, IN_FULL = 4, 512
# Levels of a feature in a screen, features whose levels add up in 8 bits, and the shares of values between which levels lie.
LEVELS, LEVELS_ADDED, ENDS = 127, 2, (0.005, 0.995)

METRICS = ("euclidean", "manhattan", "cosine")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    return metric


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def cells_for(points: int) -> int:
    return min(max(parts_for(points, POINTS_PER_CELL), LEAST_CELLS), MOST_CELLS)


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest finite distances of every row, equal ones by column."""
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((d <= limit) & np.isfinite(d))
    else:
        row, column = np.nonzero(np.isfinite(d))
    order = np.lexsort([column, d[row, column], row])
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


@dataclass(frozen=True)
class BoxCells:
    """Cells of rows with missing features, cut by a tree; what all rows of a cell lie in, per feature.

    ``tree`` has (feature, threshold, below, above, missing) per node, a leaf its number as -1 - number.
    """

    tree: tuple[tuple[int, float, int, int, int], ...]
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    first: np.ndarray | None = None

    @staticmethod
    def cut(x: np.ndarray, cells: int, use: np.ndarray) -> tuple:
        """Tree over sample rows: the widest feature, by its own scale and by how many queries ``use`` it, is cut at its
        median; rows without it go apart."""
        with np.errstate(all="ignore"):
            some = ~np.isnan(x).all(axis=0)
            scale = np.ones(x.shape[1])
            scale[some] = np.maximum(np.nanstd(x[:, some], axis=0), 1e-300)
        size = max(len(x) / cells, 1)
        tree: list = []
        leaves = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            own = x[rows]
            there = ~np.isnan(own)
            width = np.zeros(x.shape[1])
            for f in np.flatnonzero(there.sum(axis=0) > 1):
                width[f] = own[there[:, f], f].std() / scale[f] * there[:, f].mean() * use[f]
            f = int(width.argmax()) if len(width) else 0
            if len(rows) <= size or not len(width) or width[f] <= 1e-12:
                leaves += 1
                return -leaves
            at = float(np.median(own[there[:, f], f]))
            if not (own[there[:, f], f] > at).any():
                at = float(own[own[:, f] < at, f].max())
            node = len(tree)
            tree.append(None)
            below, above = rows[there[:, f] & (own[:, f] <= at)], rows[there[:, f] & (own[:, f] > at)]
            tree[node] = (f, at, grow(below), grow(above), grow(rows[~there[:, f]]))
            return node

        root = grow(np.arange(len(x)))
        return tuple(tree) if root >= 0 else ()

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)

        def go(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node < 0:
                out[rows] = -1 - node
                return
            f, at, below, above, missing = self.tree[node]
            v = x[rows, f]
            gone = np.isnan(v)
            go(below, rows[~gone & (v <= at)])
            go(above, rows[~gone & (v > at)])
            go(missing, rows[gone])

        if self.tree:
            go(0, np.arange(len(x)))
        return out


class BoxTree:
    """The boxes of cells and of the nodes above them: a query goes down only where something could be as near as it needs.

    The least distance to a node's box is one to each box below it, so what a query does not follow holds no cell for it, and
    the work follows the cells that are found and not all there are.
    """

    def __init__(self, cells: BoxCells, metric: str):
        leaves = max([len(cells.low), *(-c for node in cells.tree for c in node[2:])])
        n, width = leaves + len(cells.tree), cells.low.shape[1]
        self.metric, self.leaves, self.root = metric, leaves, leaves if cells.tree else 0
        self.low, self.high, self.first = np.full((width, n), np.inf), np.full((width, n), -np.inf), np.full(n, np.inf)
        here = len(cells.low)
        self.low[:, :here], self.high[:, :here], self.first[:here] = cells.low.T, cells.high.T, cells.first
        self.below = np.array([[-1 - c if c < 0 else leaves + c for c in node[2:]] for node in cells.tree], np.int64).reshape(-1, 3)
        for i in reversed(range(len(self.below))):  # what is below a node comes after it
            own, at = self.below[i], leaves + i
            self.low[:, at], self.high[:, at] = self.low[:, own].min(axis=1), self.high[:, own].max(axis=1)
            self.first[at] = self.first[own].min()

    def bounds(self, x: np.ndarray, scale: np.ndarray, day: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least distance of each query ``row`` to anything in ``node`` beside it; inf where that has nothing it could use."""
        out = np.zeros(len(row))
        with np.errstate(invalid="ignore"):
            for f in np.flatnonzero(~np.isnan(x).all(axis=0)):
                v = x[row, f]
                gap = np.maximum(np.maximum(self.low[f, node] - v, v - self.high[f, node]), 0) / scale[row, f]
                out += np.where(np.isnan(v), 0, gap * gap if self.metric == "euclidean" else gap)
        out[self.first[node] > day[row]] = np.inf
        return (np.sqrt(out) if self.metric == "euclidean" else out) * (1 - SLACK)

    def _downwards(self, x: np.ndarray, scale: np.ndarray, day: np.ndarray) -> np.ndarray:
        """Bound of the cell each query comes to by the nearest node at every step: its nearest cell is no farther."""
        node, limit = np.full(len(x), self.root), np.full(len(x), np.inf)
        row = np.arange(len(x))
        while len(row):
            leaf = node < self.leaves
            limit[row[leaf]] = self.bounds(x, scale, day, row[leaf], node[leaf])
            row, node = row[~leaf], node[~leaf]
            if len(row):
                below = self.below[node - self.leaves]
                low = self.bounds(x, scale, day, np.repeat(row, 3), below.ravel()).reshape(-1, 3)
                node = below[np.arange(len(row)), np.where(np.isnan(low), np.inf, low).argmin(axis=1)]
        return np.where(np.isnan(limit), np.inf, limit)

    def _within(self, x: np.ndarray, scale: np.ndarray, day: np.ndarray, limit: np.ndarray):
        """(query, cell, bound) of all cells within each query's limit; None if those are too many to hold at once."""
        row, node = np.arange(len(x)), np.full(len(x), self.root)
        found, held = [], 0
        while len(row):
            low = self.bounds(x, scale, day, row, node)
            near = np.isfinite(low) & (low <= limit[row])
            row, node, low = row[near], node[near], low[near]
            leaf = node < self.leaves
            found.append((row[leaf], node[leaf], low[leaf]))
            held += int(leaf.sum())
            row, node = np.repeat(row[~leaf], 3), self.below[node[~leaf] - self.leaves].ravel()
            if len(x) > 1 and held + len(row) > HELD_NUMBERS:
                return None
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def pairs(self, asked: pd.DataFrame, limit: np.ndarray, hi: int | None):
        """As ``EveryCell.pairs``; ``asked`` has the arrays x and scale, and the date."""
        day = np.array([d.toordinal() for d in asked[DATE]], dtype=float)
        x, scale = (np.array(asked[c].tolist(), dtype=float).reshape(len(asked), -1) for c in ("x", "scale"))
        if hi == 1:
            limit = np.minimum(limit, self._downwards(x, scale, day))
        open_ = [slice(0, len(asked))]
        while open_:
            own = open_.pop()
            found = self._within(x[own], scale[own], day[own], limit[own])
            if found is None:
                middle = (own.start + own.stop) // 2
                open_ += [slice(middle, own.stop), slice(own.start, middle)]
                continue
            row, cell, low = found
            order = np.lexsort([cell, low, row])
            row, cell = row[order], cell[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            near = place < (hi or np.inf)
            yield asked.iloc[own], row[near], cell[near], place[near]


@dataclass(frozen=True)
class PivotCells:
    """Cells of complete points around pivots; how near and far its points are from the pivot.

    Under ``cosine`` points and queries have length one and distances are compared through euclidean ones; points
    without a direction have a cell of their own at distance one.
    """

    pivots: np.ndarray
    metric: str
    near: np.ndarray | None = None
    far: np.ndarray | None = None

    def between(self, x: np.ndarray) -> np.ndarray:
        """Distances of points to pivots."""
        if self.metric == "manhattan":
            out = np.zeros((len(x), len(self.pivots)))
            for f in range(x.shape[1]):
                out += np.abs(x[:, f][:, None] - self.pivots[None, :, f])
            return out
        middle = self.pivots.mean(axis=0)
        x, pivots = x - middle, self.pivots - middle
        square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        d = self.between(x)
        # distances through products carry an error of about the root of the machine precision times the lengths
        middle = self.pivots.mean(axis=0)
        reach = np.linalg.norm(x - middle, axis=1).max(initial=0) + np.linalg.norm(self.pivots - middle, axis=1).max(initial=0)
        loose = 1e-6 * (reach + self.far[None, :])
        low = np.maximum(np.maximum(d - self.far[None, :], self.near[None, :] - d) - loose, 0)
        return low * low / 2 if self.metric == "cosine" else low


class EveryCell:
    """Cells whose bounds, one per query and cell, are all computed."""

    def __init__(self, bounds: Callable[[pd.DataFrame], np.ndarray], sizes: dict[int, int]):
        self.bounds, self.numbers = bounds, np.array(sorted(sizes), np.int64)

    def pairs(self, asked: pd.DataFrame, limit: np.ndarray, hi: int | None):
        """Pieces of the queries, each with (query, cell, number of the cell by bound from 0 on) for all cells that could
        hold something within the query's limit, or for the first ``hi`` of them."""
        step = max(1, HELD_NUMBERS // max(len(self.numbers), 1))
        for at in range(0, len(asked), step):
            part = asked.iloc[at : at + step]
            low = self.bounds(part)[:, self.numbers]
            order = np.argsort(low, axis=1, kind="stable")[:, :hi]
            near_first = np.take_along_axis(low, order, axis=1)
            row, place = np.nonzero(np.isfinite(near_first) & (near_first <= limit[at : at + step, None]))
            yield part, row, self.numbers[order[row, place]], place


def search(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    k: int,
    sizes: dict[int, int],
    cells: EveryCell | BoxTree,
    meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    found: str,
) -> DataFrame:
    """What ``meet`` finds, with ``found`` as schema, for each query in all cells that could hold one of its ``k`` nearest.

    ``queries`` are unique by ``keys``, ``points`` carry their ``cell``; ``sizes`` are points per cell. ``found`` has the
    keys and ``distance``; of what comes back each query's ``k`` smallest distances are its nearest. Queries come to
    ``meet`` with the ``limit`` above which nothing of use to them lies.
    """
    spark = queries.sparkSession
    schema = queries.schema.simpleString().removeprefix("struct<").removesuffix(">")
    numbers = np.array(sorted(sizes), np.int64)
    several = 1 + max(sizes, default=-1)

    def pairs(batches, hi: int | None):
        for batch in batches:
            if len(batch):
                limit = batch["limit"].to_numpy(dtype=float)
                limit = np.where(np.isnan(limit), np.inf, limit)
                yield from cells.pairs(batch.assign(limit=limit), limit, hi)

    def passed_on(part: pd.DataFrame, row: np.ndarray, cell: np.ndarray):
        for at in range(0, len(row), ROWS_AT_ONCE):
            own = slice(at, at + ROWS_AT_ONCE)
            yield part.iloc[row[own]].assign(cell=cell[own].astype(np.int32))

    def routed(asked: DataFrame, lo: int, hi: int | None) -> DataFrame:
        """Queries with their cells number ``lo`` to ``hi`` by bound, as far as those could hold a nearest one."""

        def route(batches):
            for part, row, cell, place in pairs(batches, hi):
                yield from passed_on(part, row[place >= lo], cell[place >= lo])

        return asked.mapInPandas(route, f"{schema}, limit double, cell int")

    def loads(asked: DataFrame, lo: int, hi: int | None, ahead: int | None) -> tuple[int, dict[int, int], dict[int, int]]:
        """Queries in all, and by cell those it is number ``lo`` to ``hi``, or to ``ahead``, of the cells for by bound."""

        def count(batches):
            n, next_, later = 0, np.zeros(several, np.int64), np.zeros(several, np.int64)
            for part, _, cell, place in pairs(batches, ahead):
                n += len(part)
                later += np.bincount(cell[place >= lo], minlength=several)
                next_ += np.bincount(cell[(place >= lo) & (place < (hi or np.inf))], minlength=several)
            some = np.flatnonzero(later)
            yield pd.DataFrame({"cell": [-1, *some], "next": [n, *next_[some]], "later": [0, *later[some]]})

        counted = asked.mapInPandas(count, "cell int, next long, later long").groupBy("cell").agg(F.sum("next"), F.sum("later")).collect()
        n = sum(r[1] for r in counted if r[0] < 0)
        return n, {r[0]: r[1] for r in counted if r[0] >= 0 and r[1]}, {r[0]: r[2] for r in counted if r[0] >= 0}

    def routed_to_groups(asked: DataFrame, group: np.ndarray) -> tuple[DataFrame, dict[int, int]]:
        """Queries with every group of cells of which any could hold a nearest one, and queries per group."""
        groups = int(group.max()) + 1

        def met_(batches):
            for part, row, cell, _ in pairs(batches, None):
                both = np.unique(row * groups + group[cell])
                yield part, both // groups, both % groups

        def route(batches):
            for own in met_(batches):
                yield from passed_on(*own)

        def count(batches):
            total = np.zeros(groups, np.int64)
            for _, _, g in met_(batches):
                total += np.bincount(g, minlength=groups)
            yield pd.DataFrame({"cell": np.arange(groups, dtype=np.int32), "n": total})

        counted = asked.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
        return asked.mapInPandas(route, f"{schema}, limit double, cell int"), {r[0]: r[1] for r in counted if r[1]}

    def met(asked: DataFrame, load: dict[int, int], stored: DataFrame = points, held: dict[int, int] = sizes, per_batch: int = QUERIES_PER_BATCH) -> DataFrame:
        """``load`` has the queries, ``held`` the points of every cell: at most ``MOST_CELLS`` and those without a value."""
        table = [(int(c), parts_for(n, per_batch), parts_for(held[c], POINTS_PER_BLOCK)) for c, n in load.items()]
        sent = F.broadcast(spark.createDataFrame(table, "cell int, batches int, parts int"))
        range_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(sent, "cell").withColumn("batch", F.pmod(F.xxhash64(*keys), "batches").cast("int"))
        right = stored.join(sent, "cell").withColumn("part", F.pmod(F.xxhash64(*stored.columns[:1], F.lit(1)), "parts").cast("int"))
        group = ["cell", "batch", "part"]
        left = left.withColumn("part", range_("parts")).drop("batches", "parts")
        right = right.withColumn("batch", range_("batches")).drop("batches", "parts")
        return spread(left, *group).groupBy(*group).cogroup(spread(renewed(right), *group).groupBy(*group)).applyInPandas(meet, found)

    def met_by_groups(asked: DataFrame, n: int) -> DataFrame:
        """All that the queries' groups of cells hold: visited cells are met once more, so this stands for the rounds before."""
        group = np.zeros(several, np.int64)
        held: dict[int, int] = {}
        at = 0
        for c in numbers:
            at += bool(held.get(at)) and held[at] + sizes[c] > POINTS_PER_BLOCK
            group[c], held[at] = at, held.get(at, 0) + sizes[c]
        of = spark.createDataFrame([(int(c), int(group[c])) for c in numbers], "cell int, g int")
        together = points.join(F.broadcast(of), "cell").withColumn("cell", F.col("g")).select(points.columns)
        # few groups are met by more batches of queries, so that every core has some; each copies the points once more
        tasks = 8 * spark.sparkContext.defaultParallelism
        per_batch = min(QUERIES_PER_BATCH, max(LEAST_BATCH, n * len(held) // tasks))
        return met(*routed_to_groups(asked, group), together, held, per_batch)

    first = queries.withColumn("limit", F.lit(None).cast("double"))
    near = met(routed(first, 0, 1), loads(first, 0, 1, 1)[1])
    by_distance = Window.partitionBy(*keys).orderBy("distance")
    done = 1
    while done < len(numbers):
        near = cut_lineage(near)
        limits = near.select(*keys, "distance", F.row_number().over(by_distance).alias("place")).where(F.col("place") == k)
        limited = cut_lineage(queries.join(limits.select(*keys, F.col("distance").alias("limit")), list(keys), "left"))
        asking, load, later = loads(limited, done, done * ROUND, None)
        wanted = sum(later.values())
        if not wanted:
            break
        if done >= ROUND and wanted > MOST_VISITS * asking:
            return met_by_groups(limited, asking)
        if wanted <= asking:  # less than a cell a query: all that are left at once
            return near.unionByName(met(routed(limited, done, None), later))
        near = near.unionByName(met(routed(limited, done, done * ROUND), load))
        done *= ROUND
    return near


def distances(points: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all points (columns) to all queries (rows), by differences feature by feature."""
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(points, axis=1))
        return 1.0 - (queries @ points.T) / np.where(norms > 0, norms, 1.0)
    out = np.zeros((len(queries), len(points)))
    for at in range(0, len(points), TILE[1]):
        columns = np.ascontiguousarray(points[at : at + TILE[1]].T)
        for top in range(0, len(queries), TILE[0]):
            own, tile = queries[top : top + TILE[0]], out[top : top + TILE[0], at : at + TILE[1]]
            for f in range(len(columns)):
                delta = columns[f][None, :] - own[:, f][:, None]
                tile += np.abs(delta, out=delta) if metric == "manhattan" else np.multiply(delta, delta, out=delta)
    return out if metric == "manhattan" else np.sqrt(out)


class _ByProducts:
    """Which pairs could be within a euclidean limit, by products of 32 bits and what their rounding may add."""

    def __init__(self, x: np.ndarray, qx: np.ndarray):
        middle = x.mean(axis=0)
        self.x, self.q = (x - middle).astype(np.float32), (qx - middle).astype(np.float32)
        half, own = ((v.astype(float) ** 2).sum(axis=1) / 2 for v in (self.x, self.q))
        self.points = np.ascontiguousarray(np.column_stack([self.x, -half]).T.astype(np.float32))
        self.queries = np.column_stack([self.q, np.ones(len(qx), np.float32)])
        self.own, self.error = own, 1e-6 * (x.shape[1] + 8) * (np.sqrt(own) + np.sqrt(half.max())) ** 2 + 1e-36

    def usable(self) -> bool:
        """Whether all numbers keep clear of the ends of 32 bits."""
        return bool(np.isfinite(self.error).all() and self.error.max() < 1e30)

    def near(self, rows: slice, columns: slice, limit: np.ndarray) -> np.ndarray:
        least = self.own[rows] - limit * limit / 2 - self.error[rows]
        return self.queries[rows] @ self.points[:, columns] >= np.maximum(least, -3e38).astype(np.float32)[:, None]


class _ByLevels:
    """Which pairs could be within a manhattan limit, by features of few levels, whose sums fit small integers.

    Cutting off at the ends only brings points together, and rounding changes each difference by a level at most.
    """

    def __init__(self, x: np.ndarray, qx: np.ndarray):
        low, high = np.quantile(x[:: max(1, len(x) // LEAST_BATCH)], ENDS, axis=0)
        self.step = float((high - low).max() / LEVELS)
        level = lambda v: np.rint((np.clip(v, low, low + LEVELS * self.step) - low) / self.step).astype(np.int8)
        if self.usable():
            points, queries = level(x).T, level(qx).T
            both = np.column_stack([points, queries])
            some = np.flatnonzero(both.min(axis=1) < both.max(axis=1))  # a feature of one level adds no difference
            self.points, self.queries = np.ascontiguousarray(points[some]), np.ascontiguousarray(queries[some])[:, :, None]

    def usable(self) -> bool:
        return 0 < self.step < np.inf

    def near(self, rows: slice, columns: slice, limit: np.ndarray) -> np.ndarray:
        shape = (len(limit), self.points[0, columns].size if len(self.points) else columns.stop - columns.start)
        total = np.zeros(shape, np.uint16 if len(self.points) * LEVELS < 2**16 else np.uint32)
        delta, few = np.empty(shape, np.int8), np.empty(shape, np.int8)
        added = few.view(np.uint8)
        for f in range(0, len(self.points), LEVELS_ADDED):
            np.absolute(np.subtract(self.points[f, columns], self.queries[f, rows], out=few), out=few)
            for g in range(f + 1, min(f + LEVELS_ADDED, len(self.points))):
                np.absolute(np.subtract(self.points[g, columns], self.queries[g, rows], out=delta), out=delta)
                np.add(added, delta.view(np.uint8), out=added)
            np.add(total, added, out=total)
        most = limit / self.step * (1 + SLACK) + len(self.points) * (1 + 1e-6)
        return total <= np.minimum(most, np.iinfo(total.dtype).max).astype(total.dtype)[:, None]


def closest(x: np.ndarray, ids: np.ndarray, qx: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int, metric: str):
    """(row, column, distance) of the ``k`` points nearest to every query, none with its own id, equal ones by column.

    Of what lies above a query's ``limit`` nothing has to be found. Distances are those of ``distances``. Under euclidean
    and manhattan ones most pairs are left out by a bound that costs less; the limit falls with what is found.
    """
    screen = None
    if metric != "cosine" and x.shape[1] and np.isfinite(x).all() and np.isfinite(qx).all():
        with np.errstate(over="ignore", invalid="ignore"):
            screen = (_ByProducts if metric == "euclidean" else _ByLevels)(x, qx)
        screen = screen if screen.usable() else None
    if screen is None:
        for at in range(0, len(qx), max(1, HELD_NUMBERS // len(x))):
            own = slice(at, at + max(1, HELD_NUMBERS // len(x)))
            d = distances(x, qx[own], metric)
            d[asked[own][:, None] == ids[None, :]] = np.inf
            row, column = nearest(d, k)
            yield row + at, column, d[row, column]
        return
    features, own_features = np.ascontiguousarray(x.T), np.ascontiguousarray(qx.T)
    queries, width = SCREEN[metric]
    for top in range(0, len(qx), queries):
        rows = slice(top, min(top + queries, len(qx)))
        own, at = limit[rows] * (1 + SLACK), 0
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        while at < len(x):
            columns = slice(at, min(at + width, len(x)))
            near = screen.near(rows, columns, own) if np.isfinite(own).all() else None
            if near is not None and np.count_nonzero(near) <= near.size // SCREENED:
                row, column = np.divmod(np.flatnonzero(near), near.shape[1])
                column += at
                # summed in any order first; what is left, in that of ``distances``
                about, many = np.empty(len(row)), max(1, HELD_NUMBERS // x.shape[1])
                for i in range(0, len(row), many):
                    delta = x[column[i : i + many]] - qx[row[i : i + many] + top]
                    delta = np.abs(delta, out=delta) if metric == "manhattan" else np.multiply(delta, delta, out=delta)
                    total = delta.sum(axis=1)
                    about[i : i + many] = total if metric == "manhattan" else np.sqrt(total)
                other = (about <= own[row] * (1 + SLACK)) & (asked[rows][row] != ids[column])
                row, column = row[other], column[other]
                d = np.zeros(len(row))
                for v, q in zip(features, own_features[:, rows], strict=True):
                    delta = v[column] - q[row]
                    d += np.abs(delta, out=delta) if metric == "manhattan" else np.multiply(delta, delta, out=delta)
                d = d if metric == "manhattan" else np.sqrt(d)
            else:
                columns = slice(at, min(at + IN_FULL, len(x)))
                every = distances(x[columns], qx[rows], metric)
                every[asked[rows][:, None] == ids[columns][None, :]] = np.inf
                row, column = nearest(every, k)
                d = every[row, column]
                column = column + at
            at = columns.stop
            if len(row):
                row, column, d = (np.concatenate(c) for c in zip(best, (row, column, d), strict=True))
                order = np.lexsort([column, d, row])
                row, column, d = row[order], column[order], d[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best = row[place < k], column[place < k], d[place < k]
                last = place == k - 1
                own[row[last]] = np.minimum(own[row[last]], d[last])
        yield best[0] + top, best[1], best[2]


def _direction(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


def _spread_out(sample: np.ndarray, n: int, metric: str) -> np.ndarray:
    """``n`` pivots of a sample: half of them each the farthest from all before, which finds every cluster, half at random."""
    if not len(sample):
        return sample
    chosen = [0]
    away = PivotCells(sample[:1], metric).between(sample)[:, 0]
    while len(chosen) < min(n // 2, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, PivotCells(sample[chosen[-1:]], metric).between(sample)[:, 0])
    others = np.setdiff1d(np.arange(len(sample)), chosen)
    return sample[[*chosen, *others[: n - len(chosen)]]]


def _placed(points: DataFrame, cells: PivotCells) -> DataFrame:
    """Points with their cell and how far they are from its pivot; those without a direction in the cell after the last."""

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(float)
            d = cells.between(_direction(x) if cells.metric == "cosine" else x)
            cell = d.argmin(axis=1)
            away = d[np.arange(len(x)), cell]
            if cells.metric == "cosine":
                none = ~x.any(axis=1)
                cell[none], away[none] = len(cells.pivots), 1.0
            yield batch.assign(cell=cell.astype(np.int32), away=away)

    return points.mapInPandas(place, f"id long, x {points.schema['x'].dataType.simpleString()}, cell int, away double")


def knn_edges(df: DataFrame, id_column: str, vector: str, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """(id, neighbour, distance, rank) of the ``k`` nearest other points of every point.

    Pivots come from a bounded, hash-ordered sample; every point belongs to its nearest one, and the triangle inequality
    bounds how near a cell can come.
    """
    check_metric(metric)
    # floats stay floats where they are stored and sent, and are doubles wherever they are computed with
    kind = "array<float>" if df.select(vector).dtypes[0][1] == "array<float>" else "array<double>"
    points = cut_lineage(df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("x")))
    n = points.count()
    k = min(k, max(n - 1, 1))
    sample = points.orderBy(F.xxhash64("id")).limit(4 * cells_for(n)).collect()
    width = len(sample[0]["x"]) if sample else 1
    drawn = np.array([r["x"] for r in sample], dtype=float).reshape(len(sample), width)
    cells = PivotCells(_spread_out(_direction(drawn) if metric == "cosine" else drawn, cells_for(n), metric), metric)
    placed = cut_lineage(_placed(points, cells)) if sample else points.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    known = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()
    near, far = np.zeros(len(cells.pivots) + 1), np.zeros(len(cells.pivots) + 1)
    for r in known:
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    cells = PivotCells(cells.pivots, metric, near[:-1], far[:-1])

    def bounds(batch: pd.DataFrame) -> np.ndarray:
        x = np.stack(batch["x"].to_numpy()).astype(float)
        low = cells.bounds(_direction(x) if metric == "cosine" else x)
        if metric == "cosine":
            low[~x.any(axis=1)] = 0.0  # everything is at distance one from a query without direction
        return np.column_stack([low, np.ones(len(x))])

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("id")
            ids, asked, limit = candidates["id"].to_numpy(), queries["id"].to_numpy(), queries["limit"].to_numpy()
            x, qx = (np.stack(v["x"].to_numpy()).astype(float) for v in (candidates, queries))
            for row, column, d in closest(x, ids, qx, asked, limit, k, metric):
                found.append(pd.DataFrame({"id": asked[row], "neighbour": ids[column], "distance": d}))
        empty = pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "distance": np.zeros(0)})
        return pd.concat(found, ignore_index=True) if found else empty

    sizes = {r["cell"]: r["n"] for r in known}
    near_ = search(points, placed.select("id", "x", "cell"), ["id"], k, sizes, EveryCell(bounds, sizes), meet, "id long, neighbour long, distance double")
    # k rows per cell a point visits: a bounded list per point
    merged = near_.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("best"))
    return merged.select("id", F.posexplode("best").alias("pos", "b")).select(
        "id", F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"), (F.col("pos") + 1).alias("rank")
    )


def graph_properties(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices, edges of the symmetric graph and their density."""
    # both directions of an edge from one reading of the edges
    both = F.explode(F.array(F.struct("id", "neighbour"), F.struct(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))))
    pairs = edges.select(both.alias("pair")).select("pair.*")
    n_edges = pairs.distinct().agg(F.count("*")).scalar()
    return vertices.agg(F.count("*").alias("n_vertices")).select(
        "n_vertices", n_edges.alias("n_edges"), (n_edges / (F.col("n_vertices") * F.col("n_vertices"))).alias("edge_density")
    )
