"""Distributed order statistics against numpy, with one value or key holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import ordered
from chronopanel.operators import evaluate, split


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else f"g{i % 7}"
        value = 5.0 if i % 3 == 1 else float(np.round(rng.normal(), 3))
        rows.append((i, group, value, int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "id LONG, g STRING, v DOUBLE, y INT").cache()


@pytest.mark.parametrize("block_rows", [100_000, 700, 40])
def test_quantiles(skewed, block_rows):
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 1.0}
    pdf = skewed.toPandas()
    for r in ordered.exact_quantiles(skewed, ["g"], "v", probs, block_rows).collect():
        v = pdf[pdf.g == r["g"]].v
        np.testing.assert_allclose([r[n] for n in probs], v.quantile(list(probs.values())))
    whole = ordered.exact_quantiles(skewed, [], "v", probs, block_rows).first()
    np.testing.assert_allclose([whole[n] for n in probs], pdf.v.quantile(list(probs.values())))


def test_running_totals(skewed):
    counts = skewed.groupBy("v").agg(F.count("*").alias("n"))
    got = ordered.running_totals(counts, [], "v", {"cum": "n"}).toPandas().sort_values("v")
    assert (got["cum"].to_numpy() == got["n"].cumsum().to_numpy()).all()


def test_one_hot_group_among_many_small_ones(spark):
    """Only the large group is cut, over two levels; all totals are exact."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 7000).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n")
    )
    got = ordered.running_totals(df, ["g"], "v", {"cum": "n"}, block_rows=8).toPandas().sort_values(["g", "v"])
    assert (got["cum"] == got.groupby("g").cumcount() + 1).all() and len(got) == 30_000


def test_shuffled_rank_is_a_permutation(skewed):
    ranked = ordered.shuffled_rank(skewed, ["g"], ["id"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part["shuffle_rank"]) == list(range(1, len(part) + 1))
    again = ordered.shuffled_rank(skewed.repartition(3), ["g"], ["id"]).toPandas()
    assert dict(zip(ranked.id, ranked.shuffle_rank)) == dict(zip(again.id, again.shuffle_rank))


def test_rank_distinct(spark):
    words = [f"Customer#{i:06d}" for i in range(0, 3000, 7)] + ["", "é", "Z", "a"]
    got = ordered.rank_distinct(spark.createDataFrame([(w,) for w in words], "w STRING"), "w", "r").collect()
    want = {w: i for i, w in enumerate(sorted(words, key=lambda s: s.encode()))}
    assert {r["w"]: r["r"] for r in got} == want


def test_auc_with_ties(skewed):
    pdf = skewed.toPandas()
    pos, neg = pdf[pdf.y == 1].v.to_numpy(), pdf[pdf.y == 0].v.to_numpy()
    want = (np.greater.outer(pos, neg).sum() + 0.5 * np.equal.outer(pos, neg).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(skewed, true="y", score="v").first()[0] == pytest.approx(want)
    assert evaluate.roc_auc(skewed.where("y = 1"), true="y", score="v").first()[0] == 0.5


def test_samples_are_exact(skewed):
    down = split.downsample_majority(skewed, "y", ["id"]).groupBy("y").count().collect()
    assert len({r["count"] for r in down}) == 1
    held = split.random_holdout(skewed, 0.8, ["id"])
    assert held.where("split = 'train'").count() == 4800
    folds = split.stratified_kfold(skewed, 5, "y", ["id"]).groupBy("y", "fold").count().toPandas()
    for _, part in folds.groupby("y"):
        assert part["count"].max() - part["count"].min() <= 1
