"""Train/test splits, samples and rolling windows. A split is a column, never a held frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.aggregate import dedupe
from chronopanel.operators.select import clip_period
from chronopanel.ordered import running_totals, shuffled_rank
from chronopanel.schema import DATE, ENTITY, KEYS, PanelError


def split_cutoff(df: DataFrame, cutoff) -> DataFrame:
    """Train up to and including the cutoff day, test after it."""
    day = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")
    return df.withColumn("split", F.when(F.to_date(DATE) <= day, "train").otherwise("test"))


apply_stored_split = split_cutoff


def balanced_cutoff(df: DataFrame, train_prop: float = 0.8, beta: float = 0.8, label: str = "label") -> DataFrame:
    """One row with the cutoff whose two sides look most alike.

    Rows are reduced to one line per date; candidates are then scored from
    cumulative counts, so the cost is one aggregation plus a pass over the
    calendar.
    """
    per_date = df.groupBy(DATE).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    # One row per calendar day from here on.
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    every = Window.partitionBy(F.lit(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    scored = per_date.select(
        DATE,
        (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(every).alias("dates"),
        F.sum("n").over(upto).alias("n_a"),
        F.sum("pos").over(upto).alias("p_a"),
        F.sum("n").over(every).alias("n"),
        F.sum("pos").over(every).alias("p"),
    ).where((F.col("i") >= F.floor(F.col("dates") / 2)) & (F.col("i") <= F.floor(F.col("dates") * 0.95)))
    n_b, p_b = F.col("n") - F.col("n_a"), F.col("p") - F.col("p_a")
    share_a = F.try_divide("p_a", "n_a")
    share_b = F.try_divide(p_b, n_b)
    share = F.col("p") / F.col("n")
    size_a = F.col("n_a") / F.col("n")
    size_b = n_b / F.col("n")
    score = beta * (F.pow(share_a - share, 2) + F.pow(share_b - share, 2)) + (1 - beta) * (
        F.pow(size_a - train_prop, 2) + F.pow(size_b - (1 - train_prop), 2)
    )
    usable = (
        (F.col("n_a") >= 0.05 * F.col("dates"))
        & (n_b >= 0.05 * F.col("dates"))
        & (share_a > 1e-8)
        & (share_b > 1e-8)
        & (score <= 1)
    )
    best = F.max_by(DATE, F.when(usable, F.struct((-score).alias("s"), F.col(DATE).alias("d"))))
    return scored.agg(F.coalesce(best, F.min(DATE)).alias("cutoff"), F.min("p").alias("p"), F.min("n").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("cutoff")).alias("cutoff")
    )


def split_balanced(
    df: DataFrame, train_prop: float = 0.8, beta: float = 0.8, label: str = "label", start=None, end=None
) -> DataFrame:
    """Temporal split at the balanced cutoff; fails when only one class is present."""
    clipped = clip_period(df, start, end)
    cutoff = balanced_cutoff(clipped, train_prop, beta, label).first()["cutoff"]
    if cutoff is None:
        raise PanelError("cannot split with fewer than two classes")
    return split_cutoff(clipped, cutoff)


def split_date(df: DataFrame) -> DataFrame:
    """Last training date."""
    return df.where(F.col("split") == "train").agg(F.max(DATE).alias("split_date"))


# Countries whose sets are chosen exactly, and the share of all rows that sums of them are told apart by.
LARGEST = 64
SHARE_UNITS = 100_000


def reachable(sizes: list[int], limit: int) -> np.ndarray:
    """For every sum up to ``limit`` the number of the last item of one subset with this sum: -1 for none, -2 if unreachable."""
    last = np.full(limit + 1, -2, dtype=np.int64)
    last[0] = -1
    for i, size in enumerate(sizes):
        if 0 < size <= limit:
            new = (last[:-size] > -2) & (last[size:] == -2)
            last[size:][new] = i
    return last


def subsets_near(sizes: list[int], aim: float, spare: int, choices: int = 1) -> list[tuple[float, list[int]]]:
    """(miss, items): sets whose sum, with up to ``spare`` more from elsewhere, comes nearest to ``aim``.

    Of sums that are as good but for a two-thousandth of all, ``choices`` evenly spaced ones are given.
    """
    last = reachable(sizes, int(sum(sizes)))
    sums = np.flatnonzero(last > -2)
    miss = np.maximum(sums - aim, 0) + np.maximum(aim - sums - spare, 0)
    order = np.lexsort([sums, miss])
    good = order[miss[order] <= miss[order[0]] + SHARE_UNITS // 2000]
    good = good[np.unique(np.linspace(0, len(good) - 1, choices).astype(int))]
    out = []
    for i in good:
        left, items = int(sums[i]), []
        while last[left] >= 0:
            items.append(int(last[left]))
            left -= sizes[items[-1]]
        out.append((float(miss[i]), items))
    return out


def _two_sets(units: list[int], train: float, test: float, spare: int) -> tuple[list[int], list[int]]:
    """Items for training and for testing that miss both aims by least, in units; ``spare`` can be given to either."""
    found = []
    for missed, chosen in subsets_near(units, train, spare, 32):
        rest = [i for i in range(len(units)) if i not in chosen]
        used = min(max(train - sum(units[i] for i in chosen), 0), spare)
        again, own = subsets_near([units[i] for i in rest], test, int(spare - used))[0]
        found.append((missed + again, chosen, [rest[i] for i in own]))
    return min(found)[1:]


def split_geographic(df: DataFrame, train_prop: float = 0.8, test_prop: float | None = None, seed: int = 1) -> DataFrame:
    """Disjoint country sets as near to the wanted row totals as countries allow; leftovers have no split.

    Of the ``LARGEST`` countries, which reach the driver with their row counts, every sum that some of them have is found
    by a table of subset sums in units of a hundred-thousandth of the rows; the sets for training and for testing are
    those that come nearest to their aims once smaller countries fill them up. All other countries are laid end to end in
    a seeded hash order, by running totals in blocks, and fill what is missing.
    """
    test_prop = 1 - train_prop if test_prop is None else test_prop
    counts = df.groupBy(ENTITY).agg(F.count("*").alias("n")).withColumn("__h", F.xxhash64(ENTITY, F.lit(seed)))
    total = counts.agg(F.sum("n")).first()[0] or 0
    head = counts.orderBy(F.desc("n"), "__h").limit(LARGEST)
    large = sorted(head.collect(), key=lambda r: r["__h"])
    units = [round(r["n"] / total * SHARE_UNITS) for r in large]
    spare = max(SHARE_UNITS - sum(units), 0) if len(large) == LARGEST else 0
    everything = train_prop + test_prop > 1 - 1e-9
    if everything:
        train = subsets_near(units, train_prop * SHARE_UNITS, spare)[0][1]
        test = [i for i in range(len(large)) if i not in train]
    else:
        train, test = _two_sets(units, train_prop * SHARE_UNITS, test_prop * SHARE_UNITS, spare)
    missing = lambda chosen, prop: max(round(prop * total) - sum(large[i]["n"] for i in chosen), 0)
    fill_train = missing(train, train_prop)
    fill_test = total if everything else missing(test, test_prop)
    named = [(large[i][ENTITY], side) for side, chosen in (("train", train), ("test", test)) for i in chosen]
    sets = df.sparkSession.createDataFrame(named, f"{ENTITY} STRING, split STRING")
    if spare:
        # hashes tie for no two countries in practice; the name settles it
        others = counts.join(head.select(ENTITY), ENTITY, "left_anti").withColumn("__one", F.lit(1))
        middle = F.col("__cum") - F.col("n") / 2
        side = F.when(middle <= fill_train, "train").when(middle <= fill_train + fill_test, "test")
        small = running_totals(others, ["__one"], "__h", {"__cum": "n"}).select(ENTITY, side.alias("split"))
        sets = sets.unionByName(small.where(F.col("split").isNotNull()))
    return df.join(sets, ENTITY, "left")


def downsample_majority(df: DataFrame, label: str = "label", keys: Sequence[str] = KEYS, seed: int = 42) -> DataFrame:
    """All positives and as many negatives, drawn without replacement."""
    wanted = df.where(F.col(label) == 1).agg(F.count("*")).scalar()
    ranked = shuffled_rank(df, [label], keys, seed)
    return ranked.where((F.col(label) == 1) | (F.col("shuffle_rank") <= wanted)).drop("shuffle_rank")


def stratified_holdout(
    df: DataFrame, test_share: float = 0.2, label: str = "label", keys: Sequence[str] = KEYS, seed: int = 42
) -> DataFrame:
    """Hold out the same share of every class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    ranked = shuffled_rank(df, [label], keys, seed).join(sizes, label)
    held = F.col("shuffle_rank") <= F.round(F.col("__n") * test_share)
    return ranked.withColumn("split", F.when(held, "test").otherwise("train")).drop("shuffle_rank", "__n")


def stratified_kfold(
    df: DataFrame, folds: int = 5, label: str = "label", keys: Sequence[str] = KEYS, seed: int = 42
) -> DataFrame:
    """Shuffled fold number per row, every class spread evenly."""
    ranked = shuffled_rank(df, [label], keys, seed)
    return ranked.withColumn("fold", ((F.col("shuffle_rank") - 1) % folds).cast("int")).drop("shuffle_rank")


def random_holdout(df: DataFrame, train_share: float = 0.8, keys: Sequence[str] = KEYS, seed: int = 42) -> DataFrame:
    """Exactly ``int(share * rows)`` training rows at random."""
    wanted = df.agg(F.floor(F.count("*") * F.lit(train_share))).scalar()
    ranked = shuffled_rank(df, [], keys, seed)
    return ranked.withColumn("split", F.when(F.col("shuffle_rank") <= wanted, "train").otherwise("test")).drop("shuffle_rank")


def rolling_windows(test: DataFrame, test_months: int = 12, step_months: int = 3, include_last: bool = False) -> DataFrame:
    """Windows (window, start_date, end_date) over the test period; the end is exclusive.

    The last test date closes the last window and is not inside it, unless
    ``include_last`` extends the ends by a day.
    """
    extent = test.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).where("lo < hi")
    steps = F.sequence(F.lit(0), F.floor(F.months_between("hi", "lo") / step_months).cast("int") + 1)
    starts = extent.select("lo", "hi", F.posexplode(steps).alias("i", "k")).select(
        "hi", (F.col("i") + 1).alias("window"), F.add_months("lo", F.col("k") * step_months).alias("start_date")
    )
    end = F.least(F.add_months("start_date", test_months), F.col("hi"))
    end = F.when(F.lit(include_last) & (end == F.col("hi")), F.date_add(end, 1)).otherwise(end)
    return starts.where(F.col("start_date") < F.col("hi")).select("window", "start_date", end.alias("end_date"))


def expanding_train(train: DataFrame, test: DataFrame, start, keys: Sequence[str] = KEYS) -> DataFrame:
    """Training rows plus test rows dated before the window start; test rows win on equal keys."""
    earlier = test.where(F.col(DATE) < F.lit(start).cast("date")).withColumn("__src", F.lit(1))
    stacked = train.withColumn("__src", F.lit(0)).unionByName(earlier)
    return dedupe(stacked, keys, keep="last", order=["__src"]).drop("__src")
