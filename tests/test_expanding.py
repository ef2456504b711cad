"""Trees of all groups together against one tree after the other."""

import datetime
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import expanding, impute


def one_tree(b, y, w, width, most, depth, least_rows, share=1.0, t=0):
    """(feature, cut, value) per node of a tree grown by itself on binned rows."""
    out = {}

    def grow(node, rows, level):
        n = np.zeros((width, most))
        s = np.zeros((width, most))
        for f in range(width):
            np.add.at(n[f], b[rows, f], w[rows])
            np.add.at(s[f], b[rows, f], w[rows] * y[rows])
        total = n[0].sum() if width else 0
        out[node] = (-1, 0, s[0].sum() / total if total >= least_rows else np.nan)
        if level == depth or not len(rows):
            return
        f, cut, *_ = expanding.best_split(n, s, least_rows, expanding.allowed_features(width, share, t, node))
        if f < 0:
            return
        out[node] = (f, cut, out[node][2])
        right = b[rows, f] > cut
        grow(2 * node + 1, rows[~right], level + 1)
        grow(2 * node + 2, rows[right], level + 1)

    grow(0, np.flatnonzero(w > 0), 0)
    return out


@pytest.mark.parametrize(("trees", "share"), [(1, 1.0), (3, 0.6)])
def test_equals_a_fit_per_group(spark, trees, share):
    rng = np.random.default_rng(3)
    n, width, groups = 400, 4, 9
    x = rng.normal(size=(n, width)).round(2)
    x[rng.random((n, width)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0] > 0.3).astype(float) * 2 + np.nan_to_num(x[:, 1]) * 0.5 + rng.normal(size=n) * 0.1
    first, until = rng.integers(0, groups, n), np.where(rng.random(n) < 0.2, rng.integers(0, groups, n), groups)
    until = np.maximum(first, until)
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), int(a), int(u)) for r, t, a, u in zip(x, y, first, until, strict=True)]
    columns = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in columns) + ", label DOUBLE, first INT, until INT")
    forest = expanding.fit(df.repartition(3), columns, groups, depth=3, trees=trees, feature_share=share)
    keyed = df.select("*", F.xxhash64(*df.columns).alias("h")).collect()
    h = np.array([r["h"] for r in keyed])
    x = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in keyed])
    y, first, until = (np.array([r[c] for r in keyed]) for c in ("label", "first", "until"))
    b = forest.bins(x)
    for g in range(groups):
        for t in range(trees):
            w = expanding.draws(h, t, trees) * ((first <= g) & (g < until))
            want = one_tree(b, y, w, width, int(b.max()) + 2, 3, 5, share, t)
            for node, (f, cut, value) in want.items():
                assert forest.feature[g, t, node] == f
                assert f < 0 or forest.cut[g, t, node] == cut
                assert forest.value[g, t, node] == pytest.approx(value, nan_ok=True)
    asked = df.withColumn("g", F.pmod(F.xxhash64("c0"), F.lit(groups)))
    got = expanding.predict(asked, forest, "g", ["label", "g"]).collect()
    direct = forest.predict(np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in asked.collect()]), np.array([r["g"] for r in asked.collect()]))
    assert sorted(-1e9 if r["prediction"] is None else r["prediction"] for r in got) == pytest.approx(sorted(np.where(np.isnan(direct), -1e9, direct)))


def jobs_of(spark, work):
    group = f"count-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return n


def step_panel(spark, months):
    rows = []
    for c in range(8):
        for m in range(months):
            day = datetime.date(2000 + m // 12, m % 12 + 1, 28)
            a = float((c * 7 + m * 3) % 11)
            rows.append((f"C{c}", day, a, None if m % 5 == 4 and m > 12 else (10.0 if a > 5 else 2.0)))
    return spark.createDataFrame(rows, "Country STRING, Date DATE, a DOUBLE, v DOUBLE")


def test_imputation_by_trees(spark):
    """A step is learned from earlier dates alone; later rows change nothing; jobs do not grow with dates."""
    df = step_panel(spark, 30)
    done = impute.regression_impute(df, ["v"], features=["a"], estimator="trees").collect()
    assert all(r["v"] == (10.0 if r["a"] > 5 else 2.0) for r in done)
    known = df.where("v IS NOT NULL").count()
    assert known < len(done) == df.count()
    jobs = [jobs_of(spark, lambda m=m: impute.regression_impute(step_panel(spark, m), ["v"], features=["a"], estimator="trees").collect()) for m in (20, 40)]
    assert jobs[0] == jobs[1]
