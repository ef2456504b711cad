"""Jaccard join of word n-gram sets with prefix filters under several global token orders.

A text is lower-cased (A-Z), cut into words, and its set are the distinct shingles of ``words`` words (with fewer words
the whole sequence is the one shingle). Two texts link when 100 * intersection >= ``percent`` * union; links through
others count, so groups are connected components.

*Orders.* If two sets of n and m shingles link, then under any order of all shingles the first n - ceil(percent * n /
100) + 1 of the one and the like of the other share a shingle. ``ORDERS`` orders are used: each puts shingles that very
many texts hold last and otherwise goes by a hash of its own. Two texts are compared only if they meet under every one.
*Candidates.* The first order's prefixes are the postings. There a prefix is longer by a tenth of the set, of which a
partner, which may be a fifth smaller, then has almost that tenth: texts too few of whose postings occur in any other
text are out, which are those that merely quote a passage, and every text leaves out the groups it meets by fewest
shingles, up to less than half of that. Every posting list is named by its smallest text, its leader, and a text joins the group of
each leader it meets: two texts that share a prefix shingle are in one group, and the hundreds of lists that a few near
copies share are one group only. A group of more than ``BLOCK`` texts (or ``BLOCK_SHINGLES`` shingles) is cut into
blocks, each pair of blocks one task's tile. Before that all its texts are compared with one of them, its centre, and
blocks of texts that link with the centre need not meet each other, so that a huge group of near copies costs its size
and not its square. No list, group or prefix is capped.
*Verification.* A tile holds the whole texts of its blocks. It intersects the filters of all orders and of the sizes,
counts the shingles common to what is left by products of 0/1 matrices, exact in single precision, and emits links that
connect what belongs together, not all pairs.

Texts are numbered by 64 bits of hash of their words, shingles likewise: of 10^9 distinct texts some two share a number
with odds of 3 %. Null and empty texts have an empty set and are linked with nothing, not with each other. Equal texts,
also repeated rows, are one point. A group is named by its smallest id; rows with a null id get their group's name (null
if all of it are). An empty table gives an empty one. Very long texts are read whole. Other columns are not read.

Scale: what is shuffled is about three tenths of the shingles as two numbers, and the texts left as candidates. Shingles held by more than one part in 2^18 of all are found by counts in the tasks, those seen under ``LOSS``
times in a chunk left out there, so there are at most 2^18 of them and their list is broadcast (which ones they are
changes the work, never the result); their postings are merged map-side. The numbers of texts to be fetched are
broadcast as a bit table of at most 8 MB, which when full only lets more texts through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept, remove, shared_folder
from chronopanel.llm.graph import components
from chronopanel.llm.hashing import SEED, WordHashes, bit_table, mix

ORDERS = 3
BLOCK = 512
BLOCK_SHINGLES = 400_000
HOT_PARTS = 18
LOSS = 4
SHARED = 10
CHUNK = 1 << 22
_COLUMNS = 4096


class Shingler:
    """Sets of texts."""

    def __init__(self, words: int):
        self.words = words
        self.factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of the text (signed) and its sorted distinct shingles."""
        h = self.hashes.of_bytes((text or "").encode("utf-8", "surrogatepass"))
        if not len(h):
            return 0, h
        width, n = min(self.words, len(h)), max(1, len(h) - self.words + 1)
        with np.errstate(over="ignore"):
            total = np.full(n, width, np.uint64)
            for i in range(width):
                total += h[i : i + n] * self.factors[i]
        tokens = np.sort(mix(total))
        number = xxhash.xxh64_intdigest(h.tobytes(), SEED)
        return number - (number >> 63 << 64), tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]


class Orders:
    """Global orders of shingles: hot ones last, otherwise by one hash per order."""

    def __init__(self, hot: np.ndarray, percent: int):
        self.hot, self.percent = np.sort(hot), percent
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hot >> np.uint64(44)).astype(np.int64)] = True

    def is_hot(self, tokens: np.ndarray) -> np.ndarray:
        found = self.maybe[(tokens >> np.uint64(44)).astype(np.int64)]
        if found.any():
            at = np.flatnonzero(found)
            place = np.minimum(np.searchsorted(self.hot, tokens[at]), len(self.hot) - 1)
            found[at] = self.hot[place] == tokens[at]
        return found

    def keys(self, tokens: np.ndarray, order: int, hot: np.ndarray) -> np.ndarray:
        return (mix(tokens ^ mix(np.uint64([order + 1]))) >> np.uint64(1)) | (hot.astype(np.uint64) << np.uint64(63))

    def first(self, keys: np.ndarray, share: int = 1) -> np.ndarray:
        """Places of the prefix of a set with these keys, of which a partner has at least ``share``."""
        size = len(keys) - -(-self.percent * len(keys) // 100) + share
        return np.argpartition(keys, size - 1)[:size] if size < len(keys) else np.arange(len(keys))


def shared_at_least(n: int, percent: int) -> int:
    """How many shingles of a set's prefix in the first order its partners must have; the prefix is that much longer."""
    return min(-(-n // SHARED), -(-percent * n // 100))


def _distinct_texts(texts, shingler, seen):
    for text in texts:
        number, tokens = shingler(text)
        if len(tokens) and number not in seen:
            seen.add(number)
            yield number, text, tokens


def profiles(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, point, n): the number of every text and the size of its set."""

    @F.pandas_udf("point long, n long")
    def profile(texts: pd.Series) -> pd.DataFrame:
        shingler = Shingler(words)
        return pd.DataFrame([(p, len(s)) for p, s in map(shingler, texts)], columns=["point", "n"])

    done = df.select(F.col(id_col).alias("id"), profile(F.col(text_col).cast("string")).alias("p"))
    return done.select("id", "p.point", "p.n")


def hot_shingles(texts: DataFrame, words: int, total: int) -> np.ndarray:
    """Shingles in about more than one part in 2^18 of all places, at most 2^18."""

    def count(batches):
        shingler, seen, held, size = Shingler(words), set(), [], 0

        def out():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= LOSS
            return pd.DataFrame({"token": found[often].view(np.int64), "times": times[often]})

        for batch in batches:
            for _, _, tokens in _distinct_texts(batch["text"], shingler, seen):
                held.append(tokens)
                size += len(tokens)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield out()

    found = texts.mapInPandas(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rows = found.where(F.col("times") > max(64, total >> HOT_PARTS)).select("token").collect()
    return np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)


def postings(texts: DataFrame, words: int, orders, hot: bool) -> DataFrame:
    """(token, point): prefixes under the first order, either of the hot shingles or of all others."""

    def emit(batches):
        shingler, seen, known = Shingler(words), set(), orders.value
        for batch in batches:
            tokens_out, points_out = [], []
            for number, _, tokens in _distinct_texts(batch["text"], shingler, seen):
                marks = known.is_hot(tokens)
                own = known.first(known.keys(tokens, 0, marks), shared_at_least(len(tokens), known.percent))
                own = own[marks[own] == hot]
                tokens_out.append(tokens[own])
                points_out.append(np.full(len(own), number, np.int64))
            if tokens_out:
                tokens_all = np.concatenate(tokens_out).view(np.int64)
                yield pd.DataFrame({"token": tokens_all, "point": np.concatenate(points_out)})

    return texts.mapInPandas(emit, "token long, point long")


def _wanted_texts(texts: DataFrame, words: int, table) -> DataFrame:
    """(point, text) of the distinct texts in the bit table."""

    def fetch(batches):
        shingler, seen, wanted = Shingler(words), set(), table.value
        for batch in batches:
            found = [
                (p, t) for p, t, _ in _distinct_texts(batch["text"], shingler, seen) if wanted[p & (len(wanted) - 1)]
            ]
            if found:
                yield pd.DataFrame(found, columns=["point", "text"])

    return texts.mapInPandas(fetch, "point long, text string").dropDuplicates(["point"])


def _common(sets_of: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    """How many columns each two of m sets share, from (set, column) incidences; exact while below 2^24."""
    total = np.zeros((m, m), np.float32)
    order = np.argsort(columns, kind="stable")
    sets_of, columns = sets_of[order], columns[order]
    last = int(columns[-1]) if len(columns) else -1
    for start in range(0, last + 1, _COLUMNS):
        lo, hi = np.searchsorted(columns, [start, start + _COLUMNS])
        x = np.zeros((m, min(_COLUMNS, last + 1 - start)), np.float32)
        x[sets_of[lo:hi], columns[lo:hi] - start] = 1
        total += x @ x.T
    return total


def linked(sets: list[np.ndarray], sides: np.ndarray | None, known: Orders) -> np.ndarray:
    """Which two of a tile's sets link; with ``sides`` only sets of different sides are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    open_ = 100 * np.minimum.outer(sizes, sizes) >= known.percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(open_, False)
    if sides is not None:
        open_ &= sides[:, None] != sides[None, :]
    owner = np.repeat(np.arange(m), sizes)
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # shingles of one set only have no column
    shared = (times > 1)[place]
    hot = known.is_hot(tokens)
    ends = np.cumsum(sizes)
    for order in range(ORDERS):
        keys = known.keys(tokens, order, hot)[place]
        prefix = np.concatenate([e - n + known.first(keys[e - n : e]) for e, n in zip(ends, sizes, strict=True)])
        prefix = prefix[shared[prefix]]
        open_ &= _common(owner[prefix], column[place[prefix]], m) > 0
        if not open_.any():
            return open_
    left = np.flatnonzero(open_.any(axis=1))
    number = np.full(m, -1)
    number[left] = np.arange(len(left))
    use = shared & (number[owner] >= 0)
    both = np.zeros((m, m), np.int64)
    both[np.ix_(left, left)] = _common(number[owner[use]], column[place[use]], len(left))
    return open_ & (100 * both >= known.percent * (sizes[:, None] + sizes[None, :] - both))


def _spanning(near: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links than points, enough to connect what ``near`` connects."""
    left = near.any(axis=1)
    a, b = [], []
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            at = front.pop()
            reached = np.flatnonzero(near[at] & left)
            left[reached] = False
            a.append(np.full(len(reached), points[at]))
            b.append(points[reached])
            front.extend(reached)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compare(tiles: DataFrame, texts: DataFrame, words: int, orders) -> DataFrame:
    """(a, b): links found in tiles (leader, i, j, side, point); a tile with i = j compares all its texts."""

    def run(batches):
        shingler, known = Shingler(words), orders.value
        current, points, sides, sets = None, [], [], []

        def solve():
            if len(points) < 2:
                return none
            _, i, j = current
            near = linked(sets, np.array(sides) if i != j else None, known)
            a, b = _spanning(near, np.array(points, np.int64))
            return pd.DataFrame({"a": a, "b": b})

        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        for batch in batches:
            found = []
            for leader, i, j, side, point, text in batch.itertuples(index=False):
                if (leader, i, j) != current:
                    found.append(solve())
                    current, points, sides, sets = (leader, i, j), [], [], []
                points.append(point)
                sides.append(side)
                sets.append(shingler(text)[1])
            yield pd.concat(found) if found else none
        yield solve()

    rows = tiles.join(texts, "point").select("leader", "i", "j", "side", "point", "text")
    key = ["leader", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def members(texts: DataFrame, sizes: DataFrame, words: int, orders, percent: int) -> DataFrame:
    """(leader, point, n): candidate groups of two texts and more; a checkpoint."""
    met = postings(texts, words, orders, hot=False).repartition("token").distinct()
    in_list = Window.partitionBy("token").orderBy("point")
    first = F.first("point").over(in_list.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("leader")
    cold = met.select("point", first, F.lead("point").over(in_list).alias("next"))
    cold = cold.where("point <> leader OR next IS NOT NULL").select("point", "leader")
    often = kept(postings(texts, words, orders, hot=True).distinct())
    leaders = often.groupBy("token").agg(F.min("point").alias("leader"))
    shared = cold.unionByName(often.join(F.broadcast(leaders), "token").select("point", "leader"))
    # one row per text and leader, with how many of the text's shingles they stand for
    shared = kept(shared.groupBy("point", "leader").agg(F.count("*").alias("times")))
    need = F.ceil(F.col("n") * percent / 100)
    least = F.least(F.ceil(need / SHARED), F.ceil(need * percent / 100))  # of the smallest partner
    able = shared.groupBy("point").agg(F.sum("times").alias("all")).join(sizes, "point").where(F.col("all") >= least)
    # partners still meet when each leaves out groups for less than half of what they share
    rarest = Window.partitionBy("point").orderBy("times", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = shared.join(able.select("point", "n", least.alias("least")), "point").withColumn("upto", F.sum("times").over(rarest))
    left = left.where(2 * F.col("upto") >= F.col("least")).select("leader", "point", "n")
    some = left.groupBy("leader").count().where("count > 1").select("leader")
    return kept(left.join(some, "leader").select("leader", "point", "n"))


def links(texts: DataFrame, sizes: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): numbers of linked texts, enough to connect all that belong together; a checkpoint."""
    spark = texts.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    orders = spark.sparkContext.broadcast(Orders(hot_shingles(texts, words, total), percent))
    inside = members(texts, sizes, words, orders, percent)
    wanted = inside.select("point").distinct()
    table = spark.sparkContext.broadcast(bit_table(wanted, wanted.count()))
    folder = shared_folder(spark, "ngram-join")
    _wanted_texts(texts, words, table).write.parquet(folder)
    fetched = spark.read.parquet(folder)

    cut = inside.groupBy("leader").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"), F.min("point").alias("centre")
    )
    inside = kept(inside.join(cut, "leader").drop("n"))
    small = inside.where("parts = 1").select("leader", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "point")
    large = inside.where("parts > 1")
    found = kept(_compare(small, fetched, words, orders))
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("point"), "parts").cast("int")
        own = large.where("point <> centre").select("leader", salt.alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("side"), "point")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        heads = large.where("point = centre").select("leader", every.alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "point")
        stars = kept(_compare(own.unionByName(heads), fetched, words, orders))
        # a link of a star may be written from either end
        ends = stars.select(F.col("a").alias("centre"), F.col("b").alias("point")).union(stars.select("b", "a")).distinct()
        marked = large.join(ends.withColumn("near", F.lit(1)), ["centre", "point"], "left")
        near = F.col("near").isNotNull() | (F.col("point") == F.col("centre"))
        block = salt + F.when(near, F.col("parts")).otherwise(0)
        other = F.explode(F.sequence(F.lit(0), 2 * F.col("parts") - 1)).alias("other")
        tiles = marked.select("leader", "point", "parts", block.alias("block"), other)
        tiles = tiles.where("block < parts OR other < parts").select(
            "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "point"
        )
        found = kept(found.unionByName(stars).unionByName(_compare(tiles, fetched, words, orders)))
    remove(spark, folder)
    return found


def join(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for every row: the size of its set and the smallest id of its group."""
    rows = kept(profiles(df, words, id_col, text_col))
    points = kept(rows.where("n > 0").groupBy("point").agg(F.min("id").alias("first"), F.max("n").alias("n")))
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    found = links(texts, points.select("point", "n"), words, percent)
    roots = components(found)
    inside = kept(points.join(roots, F.col("point") == F.col("node")).select("point", "first", "root"))
    lowest = kept(inside.groupBy("root").agg(F.min("first").alias("lowest")))
    named = inside.join(lowest, "root").select(F.col("point").alias("linked"), "lowest")
    component = kept(
        points.join(named, F.col("point") == F.col("linked"), "left").select(
            F.col("point").alias("at"), F.coalesce("lowest", "first").alias("component")
        )
    )
    joined = rows.join(component, (F.col("point") == F.col("at")) & (F.col("n") > 0), "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
