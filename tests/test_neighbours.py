"""Neighbour search through cells: exact, and most cells are never visited on clustered data."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import impute, neighbours
from chronopanel.schema import DATE, ENTITY, KEYS


def brute_edges(ids, x, k, metric):
    out = {}
    for i, a in zip(ids, x, strict=True):
        scored = []
        for j, b in zip(ids, x, strict=True):
            if i == j:
                continue
            if metric == "cosine":
                norms = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1 - a @ b / norms if norms > 0 else 1.0
            else:
                d = np.abs(a - b).sum() if metric == "manhattan" else np.sqrt(((a - b) ** 2).sum())
            scored.append((round(float(d), 9), j))
        out[i] = sorted(scored)[:k]
    return out


def clustered(n, width=6, clusters=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 50
    x = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, width))
    x[: n // 50] = 0  # points without a direction, all alike
    return x


@pytest.mark.parametrize("metric", neighbours.METRICS)
@pytest.mark.parametrize("scattered", [False, True])
def test_edges_are_exact(spark, monkeypatch, metric, scattered):
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 16)
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", 20)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BATCH", 30)
    x = np.random.default_rng(3).normal(size=(300, 4)) + 1e4 * (metric != "cosine") if scattered else clustered(400)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id LONG, v ARRAY<DOUBLE>")
    found = {}
    for r in neighbours.knn_edges(df, "id", "v", 5, metric).collect():
        found.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"], r["rank"]))
    want = brute_edges(range(len(x)), x, 5, metric)
    for i, own in want.items():
        got = [(d, j) for d, j, _ in sorted(found[i], key=lambda r: r[2])]
        assert [d for d, _ in got] == pytest.approx([d for d, _ in own], abs=1e-6)
        if len({d for d, _ in own}) == 5 and metric != "cosine":
            assert [j for _, j in got] == [j for _, j in own]


def test_few_points(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "id LONG, v ARRAY<DOUBLE>")
    assert [(r["id"], r["neighbour"]) for r in neighbours.knn_edges(df, "id", "v", 5).orderBy("id").collect()] == [(1, 2), (2, 1)]
    assert neighbours.knn_edges(df.limit(1), "id", "v", 5).collect() == []
    assert neighbours.knn_edges(df.limit(0), "id", "v", 5).collect() == []


def visits(monkeypatch, module):
    """(queries met, cells) of every round of the next searches."""
    seen = []
    real = module.search

    def counting(queries, points, keys, k, sizes, bounds, meet, found):
        def met(asked, candidates):
            if len(asked) and len(candidates):
                with open(log, "a") as f:
                    f.write(f"{len(asked)} {len(candidates)}\n")
            return meet(asked, candidates)

        seen.append((queries.count(), len(sizes), points.count()))
        return real(queries, points, keys, k, sizes, bounds, met, found)

    import tempfile

    log = tempfile.mktemp()
    open(log, "w").close()
    monkeypatch.setattr(module, "search", counting)
    return seen, lambda: [tuple(map(int, line.split())) for line in open(log)]


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_clustered_points_skip_cells(spark, monkeypatch, metric):
    """Of the comparisons of all with all, few are made."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 20)
    seen, log = visits(monkeypatch, neighbours)
    x = clustered(1000, clusters=40)[20:]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id LONG, v ARRAY<DOUBLE>")
    assert neighbours.knn_edges(df, "id", "v", 5, metric).count() == 5 * len(x)
    queries, cells, points = seen[0]
    assert cells > 20 and sum(a * b for a, b in log()) < 0.25 * queries * points


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_scattered_points_are_copied_per_group_of_cells(spark, monkeypatch, metric):
    """Without structure a query visits groups of cells, not every cell by itself; the edges are those of all pairs."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 8)
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", 200)
    seen, log = visits(monkeypatch, neighbours)
    x = np.random.default_rng(6).normal(size=(600, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id LONG, v ARRAY<DOUBLE>")
    found = {}
    for r in neighbours.knn_edges(df, "id", "v", 5, metric).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert {i: [j for _, j in sorted(f)] for i, f in found.items()} == {i: [j for _, j in f] for i, f in brute_edges(range(600), x, 5, metric).items()}
    queries, cells, _ = seen[0]
    assert cells > 60 and sum(a for a, _ in log()) < 16 * queries


def test_graph_properties_read_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rows = [(1, 2), (2, 1), (3, 1), (1, 2), (4, 3)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "id LONG, neighbour LONG")
    found = neighbours.graph_properties(edges, spark.range(5)).first()
    assert (found["n_vertices"], found["n_edges"], found["edge_density"]) == (5, 6, 6 / 25)
    assert read.value == len(rows)


SCREENED = ["manhattan", "euclidean"]


@pytest.mark.parametrize("metric", SCREENED)
@pytest.mark.parametrize("kind", ["even", "far", "tails", "whole"])
def test_screens_keep_all_near_pairs(monkeypatch, metric, kind):
    """The nearest are those of all distances, bit for bit; on even data few distances are computed in full."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 30))
    x = {"even": x, "far": x + 1e5, "tails": x * np.exp(3 * rng.normal(size=x.shape)), "whole": np.rint(x / 2)}[kind]
    x[100:140] = x[0]  # copies
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 10)
    d = neighbours.distances(x, x[asked], metric)
    d[np.arange(len(asked)), asked] = np.inf
    row, column = neighbours.nearest(d, 5)
    want = {(r, c, d[r, c]) for r, c in zip(row, column, strict=True)}
    in_full = []
    real = neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda points, queries, m: in_full.append(len(points) * len(queries)) or real(points, queries, m))
    limit = d[row, column].reshape(-1, 5)[:, 4]
    for start in (np.full(len(asked), np.inf), limit, limit * 1.05):
        in_full.clear()
        found = [np.concatenate(c) for c in zip(*neighbours.closest(x, ids, x[asked], asked, start, 5, metric), strict=True)]
        assert set(zip(*found, strict=True)) == want and len(found[0]) == len(want)
        if kind == "even":
            assert sum(in_full) < 0.5 * d.size


def brute_imputation(rows, columns, k, metric="euclidean"):
    """{(Country, Date): values} of every row, from rows of (Country, Date, {column: value})."""
    out = {}
    for country, day, own in rows:
        filled = dict(own)
        gaps = [c for c in columns if own[c] is None]
        used = [c for c in own if own[c] is not None]
        history = [r for r in rows if r[1] <= day and (r[0], r[1]) != (country, day) and all(r[2][c] is not None for c in used)]
        if gaps and used and history:
            x = np.array([[r[2][c] for c in used] for r in history])
            spread = np.subtract(*np.quantile(x, [0.75, 0.25], axis=0))
            gap = np.abs(x - np.array([own[c] for c in used])) / np.where(spread == 0, 1, spread)
            d = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
            order = sorted(range(len(history)), key=lambda i: (d[i], history[i][0], history[i][1]))[:k]
            for c in gaps:
                near = [(d[i], history[i][2][c]) for i in order if history[i][2][c] is not None]
                if near:
                    weight = [1 / (a + 1e-8) for a, _ in near]
                    filled[c] = sum(w * v for w, (_, v) in zip(weight, near, strict=True)) / sum(weight)
        out[country, day] = filled
    return out


def panel(spark, countries, months, columns, missing, seed=5):
    rng = random.Random(seed)
    first = datetime.date(2000, 1, 31)
    rows = []
    for c in range(countries):
        for m in range(months):
            day = (pd.Timestamp(first) + pd.offsets.MonthEnd(m)).date()
            own = {v: None if rng.random() < missing else round(rng.gauss(c % 5 * 3, 1), 3) for v in columns}
            rows.append((f"C{c:03d}", day, own))
    df = spark.createDataFrame([(c, d, *o.values()) for c, d, o in rows], f"{ENTITY} STRING, {DATE} DATE, " + ", ".join(f"{v} DOUBLE" for v in columns))
    return rows, df


@pytest.mark.parametrize(("cell", "values"), [(1024, 100_000), (12, 100_000), (12, 40)])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_imputation_is_exact(spark, monkeypatch, cell, values, metric):
    """In one cell and in many, with scaling statistics from one block of values and from several."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", cell)
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", max(cell // 2, 5))
    monkeypatch.setattr(impute, "VALUES_PER_BLOCK", values)
    columns = ["a", "b", "c", "d"]
    rows, df = panel(spark, 12, 14, columns, 0.3)
    got = {(r[ENTITY], r[DATE]): r for r in impute.knn_impute(df, columns, 3, metric=metric).collect()}
    want = brute_imputation(rows, columns, 3, metric)
    assert len(got) == len(want)
    for key, own in want.items():
        for c in columns:
            assert got[key][c] == (None if own[c] is None else pytest.approx(own[c], rel=1e-6, abs=1e-6)), (key, c)


def test_a_pattern_of_gaps_per_row(spark):
    """A thousand rows of a hundred variables, each with gaps of its own."""
    columns = [f"v{i}" for i in range(100)]
    rows, df = panel(spark, 20, 50, columns, 0.01)
    done = impute.knn_impute(df, columns[:3], 5).collect()
    want = brute_imputation(rows, columns[:3], 5)
    for r in done:
        for c in columns[:3]:
            w = want[r[ENTITY], r[DATE]][c]
            assert r[c] == (None if w is None else pytest.approx(w, rel=1e-6, abs=1e-6))


def test_imputation_visits_few_cells(spark, monkeypatch):
    """On clustered rows twice the panel makes about twice the comparisons, not four times."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 20)
    seen, log = visits(monkeypatch, impute)
    made = []
    for countries in (20, 40):
        rng = np.random.default_rng(2)
        days = [(pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(m)).date() for m in range(30)]
        data = [
            (f"C{c:03d}", d, float(c % 40 * 100 + rng.normal()), float(c % 40 * -70 + rng.normal()), None if rng.random() < 0.2 else float(rng.normal()))
            for c in range(countries)
            for d in days
        ]
        df = spark.createDataFrame(data, f"{ENTITY} STRING, {DATE} DATE, a DOUBLE, b DOUBLE, c DOUBLE")
        before = len(log())
        impute.knn_impute(df, ["c"], 5).select(F.count("c")).collect()
        made.append(sum(a * b for a, b in log()[before:]))
    assert made[1] < 3 * made[0]
    queries, _, points = seen[-1]
    assert made[1] < 0.3 * queries * points


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_queries_go_down_to_few_cells(monkeypatch, metric):
    """The cells within a limit, nearest first, are those of all bounds; few boxes are looked at for them."""
    rng = np.random.default_rng(8)
    x, day = rng.normal(size=(4000, 3)) * [1, 10, 1], rng.integers(1, 50, size=4000)
    x[rng.random(x.shape) < 0.15] = np.nan
    cut = neighbours.BoxCells.cut(x, 400, np.array([1.0, 1.0, 0.0]))
    cell = neighbours.BoxCells(cut).assign(x)
    n = cell.max() + 1
    low, high, first = np.full((n, 3), np.inf), np.full((n, 3), -np.inf), np.full(n, np.inf)
    np.minimum.at(low, cell, np.where(np.isnan(x), np.inf, x))
    np.maximum.at(high, cell, np.where(np.isnan(x), -np.inf, x))
    np.minimum.at(first, cell, day)
    tree = neighbours.BoxTree(neighbours.BoxCells(cut, low, high, first), metric)
    asked = x[:300].copy()
    asked[:, 2] = np.nan
    asked = asked[~np.isnan(asked).all(axis=1)]
    scale, days = rng.uniform(0.5, 2, size=asked.shape), rng.integers(1, 50, size=len(asked))
    gap = np.maximum(np.maximum(low[None] - asked[:, None], asked[:, None] - high[None]), 0) / scale[:, None]
    gap = np.where(np.isnan(asked)[:, None], 0, gap * gap if metric == "euclidean" else gap).sum(axis=2)
    every = np.where(first[None] > days[:, None], np.inf, np.sqrt(gap) if metric == "euclidean" else gap)

    looked = []
    real = neighbours.BoxTree.bounds
    monkeypatch.setattr(neighbours.BoxTree, "bounds", lambda self, *a: looked.append(len(a[3])) or real(self, *a))
    frame = pd.DataFrame({DATE: [datetime.date.fromordinal(int(d)) for d in days], "x": list(asked), "scale": list(scale), "at": range(len(asked))})
    for limit, hi in ((np.full(len(asked), np.inf), 1), (np.full(len(asked), 0.05), None), (np.full(len(asked), np.inf), None)):
        looked.clear()
        got = {}
        for part, row, found, place in tree.pairs(frame, limit, hi):
            for r, c, p in zip(part["at"].to_numpy()[row], found, place, strict=True):
                got.setdefault(r, []).append((p, c))
        for i, own in enumerate(every):
            wanted = own[np.isfinite(own) & (own <= limit[i])]
            found = [c for _, c in sorted(got.get(i, []))]
            assert own[found] == pytest.approx(np.sort(wanted)[:hi], rel=1e-6) and len(set(found)) == len(found)
        if hi or np.isfinite(limit).all():
            assert sum(looked) < 0.2 * len(asked) * len(low)


def test_history_join(spark):
    from chronopanel.operators import joins

    rng = random.Random(4)
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(days=rng.randrange(900)) for _ in range(60)]
    rows = list({(f"C{rng.randrange(6)}", d): (f"C{rng.randrange(6)}", d, float(i)) for i, d in enumerate(days)}.values())
    rows = list({(c, d): (c, d, v) for c, d, v in rows}.values())
    df = spark.createDataFrame(rows + [("none", None, 1.0)], f"{ENTITY} STRING, {DATE} DATE, v DOUBLE")
    asked = df.where(F.col("v") % 3 == 0)
    for bucket in ("month", "year"):
        met = joins.history_join(asked, df, bucket)
        got = sorted((r[ENTITY], r[DATE], r["history"][ENTITY], r["history"][DATE], r["history"]["v"]) for r in met.collect())
        want = sorted((c, d, oc, od, ov) for c, d, v in rows if v % 3 == 0 for oc, od, ov in rows if od <= d and (oc, od) != (c, d))
        assert got == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert list(KEYS) == [ENTITY, DATE]
