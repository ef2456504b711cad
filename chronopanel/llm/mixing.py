"""Mix sources to target weights by fixed-length blocks and index permutations.

Each source's documents form one stream of words, in an order fixed by hashes, cut into blocks of ``block_words``. The
output is a row of slots in shards of ``shard_slots``. Every shard draws how many slots each source gets: its slots take
sources by weight from a seeded hash stream, which makes the counts multinomial. What the draws of all shards miss of the
sources' quotas by chance is corrected at the end: the last draws of a source drawn too often go to those drawn too
rarely, so that the whole meets its targets to the word. The j-th slot of a source
takes block ``perm(j mod blocks)``, ``perm`` being the source's own affine permutation: a full round takes every block
once, and of the last round the final slot takes only the words the target still asks for. Blocks meet documents by
index. Everything follows from hashes, counts and the seed, so reruns agree.

Sources are ordered by code point with null last and weigh 5, 2, 1, repeating. They share all words there are; a target
stops at ``most`` times its source's words, and the excess goes to the others by weight until none is above. Null and
empty texts have size 0 and nothing is taken of them; a source without words has target 0. Repeated rows are documents
of their own and lie side by side in the stream. An empty table gives an empty one. Only the id, source and text columns
are read, and the results have names of their own, so other columns cannot clash.

Scale: the stream order needs running sums within a source, which may hold a third of all rows. They are taken in two
steps, within hash buckets of a source and over its buckets, so no window holds a source. Sizes are counted once and
checkpointed without the text. One row per source reaches the driver and its bounds stand in expressions: the sources
are what a mixture is configured by, some thousands at most. Very long texts are only counted, and their blocks are rows
like any other's.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import WORD, kept

WEIGHTS = (5, 2, 1)
BUCKET_DOCS = 4096
CHUNK_SLOTS = 1 << 16
SHARD_GROUP = 4096

ROW = ("d1", "d2", "id", "source_no", "start", "size")


def fill_targets(sizes: list[int], weights: list[float], most: int = 3) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``most`` times its size."""
    left, below = float(sum(sizes)), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while below:
        total = sum(weights[i] for i in below)
        full = {i for i in below if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in below:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left = max(left - sum(targets[i] for i in full), 0.0)
        below -= full
    return targets


def _step(n: int) -> int:
    """A multiplier near the golden section of n and coprime to it, so that multiplying permutes 0..n-1."""
    a = max(1, int(n * 0.6180339887498949))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _permuted(x: Column, n: Column, step: Column, shift: Column) -> Column:
    """(step * x + shift) mod n, in decimals because the product may pass 64 bits."""
    wide = x.cast("decimal(18,0)") * step.cast("decimal(18,0)") + shift.cast("decimal(18,0)")
    return F.pmod(wide, n.cast("decimal(18,0)")).cast("long")


def _section(at: Column, ends: list[int]) -> Column:
    """Number of the section that holds a place, of sections laid end to end; one comparison per source."""
    past = [(at >= F.lit(int(e)).cast("long")).cast("int") for e in ends]
    return reduce(lambda a, b: a + b, past, F.lit(0))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash over whole rows: rows of equal key are equal."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*cells), F.xxhash64(F.lit("row"), *reversed(cells))


class Mixture:
    """The sources with their targets, the documents' places in the streams, and the slots of one mixture."""

    def __init__(self, placed: DataFrame, sources: DataFrame, facts: list[dict], block_words: int, shard_slots: int, seed: int):
        self.placed, self.sources, self.facts = placed, sources, facts
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        self.total_slots = sum(f["n_slots"] for f in facts)

    def drawn(self) -> DataFrame:
        """(shard, slot, drawn): for every output slot a source drawn by weight, from a hash stream of its own.

        The counts of a shard are so a multinomial draw with the sources' slots as weights.
        """
        ends, total = self._ends([s["n_slots"] for s in self.facts]), max(self.total_slots, 1)
        slots = self.sources.sparkSession.range(0, self.total_slots, 1, max(1, -(-self.total_slots // CHUNK_SLOTS)))
        point = F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(total))
        return slots.select(
            F.floor(F.col("id") / self.shard_slots).alias("shard"), F.pmod("id", F.lit(self.shard_slots)).alias("slot"), _section(point, ends).alias("drawn")
        )

    def shards(self) -> DataFrame:
        """(shard, drawn, n, before): slots that a shard drew of a source, and that earlier shards did.

        Running sums are taken within groups of shards and over groups, so that no window holds all shards.
        """
        counts = self.drawn().groupBy("shard", "drawn").agg(F.count("*").alias("n"))
        counts = counts.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
        earlier = lambda *keys: Window.partitionBy("drawn", *keys).rowsBetween(Window.unboundedPreceding, -1)
        groups = counts.groupBy("drawn", "group").agg(F.sum("n").alias("n"))
        groups = groups.select("drawn", "group", F.coalesce(F.sum("n").over(earlier().orderBy("group")), F.lit(0)).alias("start"))
        inside = F.coalesce(F.sum("n").over(earlier("group").orderBy("shard")), F.lit(0))
        return counts.withColumn("inside", inside).join(groups, ["drawn", "group"]).select(
            "shard", "drawn", "n", (F.col("start") + F.col("inside")).alias("before")
        )

    def assigned(self) -> DataFrame:
        """(shard, slot, drawn, source_no, j): the source that fills each slot, for the j-th time.

        Draws meet the sources' quotas but for chance. Of a source drawn too often the last draws are given to those drawn
        too rarely, in order, so that the whole meets its targets; all other slots keep what they drew.
        """
        shards = kept(self.shards())
        totals = {r["drawn"]: r["n"] for r in shards.groupBy("drawn").agg(F.sum("n").alias("n")).collect()}  # one row per source
        quota = [s["n_slots"] for s in self.facts]
        got = [totals.get(i, 0) for i in range(len(quota))]
        over = self._ends([max(g - n, 0) for g, n in zip(got, quota, strict=True)])
        under = self._ends([max(n - g, 0) for g, n in zip(got, quota, strict=True)])
        number = F.row_number().over(Window.partitionBy("shard", "drawn").orderBy("slot")) - 1
        each = self.drawn().withColumn("number", number).join(shards.select("shard", "drawn", "before"), ["shard", "drawn"])
        each = each.withColumn("k", (F.col("number") + F.col("before")).cast("long"))
        list_ = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in [*values, 0]])
        own = F.get(list_(quota), F.col("drawn"))
        spare = F.col("k") - own + F.get(list_([0, *over[:-1]]), F.col("drawn"))  # place among all that is given away
        taker = _section(spare, under)
        taken = F.get(list_(got), taker) + spare - F.get(list_([0, *under[:-1]]), taker)
        keeps = F.col("k") < own
        return each.select(
            "shard", "slot", "drawn", F.when(keeps, F.col("drawn")).otherwise(taker).alias("source_no"), F.when(keeps, F.col("k")).otherwise(taken).alias("j")
        )

    @staticmethod
    def _ends(sizes: list[int]) -> list[int]:
        """Where sections of these sizes end, laid end to end."""
        return list(accumulate(sizes))

    def slots(self) -> DataFrame:
        """(shard, slot, source_no, block, whole, words): one row per output slot; ``whole`` if it takes all its block."""
        s = self.sources.where("n_slots > 0")
        each = self.assigned().join(s, "source_no")
        at, last = F.pmod("j", "blocks"), F.col("blocks") - 1
        # the last block of a stream may be short: it comes last in each round, the others are permuted before it
        block = F.when(at == last, last).otherwise(_permuted(at, F.greatest(last, F.lit(1)), F.col("step"), F.col("shift")))
        length = F.when(at == last, F.col("source_size") - last * self.block_words).otherwise(F.lit(self.block_words))
        final = F.col("j") >= F.col("rounds") * F.col("blocks")
        words = F.when(final, F.least(length, F.col("rest") - at * self.block_words)).otherwise(length)
        return each.select(
            "shard", "slot", "source_no", block.cast("long").alias("block"), (words == length).alias("whole"), words.cast("long").alias("words")
        )

    def runs(self) -> DataFrame:
        """Per document and block it touches: its words from ``low`` to ``high`` are taken ``times`` times, and once more up to ``part``."""
        b = self.block_words
        taken = self.slots().groupBy("source_no", "block").agg(
            F.sum(F.col("whole").cast("long")).alias("times"),
            F.max(F.when(~F.col("whole"), F.col("words"))).alias("extra"),
        )
        end = F.col("start") + F.col("size")
        touched = self.placed.where("size > 0").select(
            *ROW, F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block")
        )
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(end, (F.col("block") + 1) * b)
        part = F.greatest(low, F.least(high, F.col("block") * b + F.coalesce(F.col("extra"), F.lit(0))))
        return touched.join(taken, ["source_no", "block"]).select(
            *ROW,
            (low - F.col("start")).alias("low"),
            (high - F.col("start")).alias("high"),
            (part - F.col("start")).alias("part"),
            "times",
        )

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken), one row per document."""
        words = (F.col("high") - F.col("low")) * F.col("times") + F.col("part") - F.col("low")
        some = self.runs().groupBy(*ROW).agg(F.sum(words).alias("taken"))
        none = self.placed.where("size = 0").select(*ROW, F.lit(0).cast("long").alias("taken"))
        # a document of which no block is drawn has no run: its places come along with nothing taken
        idle = self.placed.where("size > 0").select(*ROW, F.lit(0).cast("long").alias("taken"))
        each = some.unionByName(idle).groupBy(*ROW).agg(F.sum("taken").alias("taken")).unionByName(none)
        return each.join(self.sources.select("source_no", "source_size", "target"), "source_no").select(
            "id", "size", "source_size", "target", "taken"
        )


def mix(
    df: DataFrame,
    block_words: int = 512,
    shard_slots: int = 1024,
    seed: int = 17,
    most: int = 3,
    weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d1, d2 = row_key(df)
    sized = kept(
        df.select(
            d1.alias("d1"), d2.alias("d2"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        )
    )
    found = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"]) for r in found]
    targets = fill_targets(words, [weights[i % len(weights)] for i in range(len(found))], most)
    rows = []
    for i, (r, size, target) in enumerate(zip(found, words, targets, strict=True)):
        blocks = -(-size // block_words)
        rounds, rest = divmod(int(target), size) if size else (0, 0)
        n_slots = rounds * blocks + -(-rest // block_words)
        full = max(blocks - 1, 1)
        rows.append((i, r["source"], -(-int(r["docs"]) // BUCKET_DOCS), size, target, blocks, rounds, rest, n_slots, _step(full), (i * 7919 + seed + full // 2) % full))
    sources = spark.createDataFrame(
        rows,
        "source_no INT, source STRING, buckets LONG, source_size LONG, target DOUBLE, blocks LONG, rounds LONG, rest LONG, n_slots LONG, step LONG, shift LONG",
    )
    named = sources.select("source_no", F.col("source").alias("name"), "buckets")
    numbered = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "d1", "d2", "id", "size", "source_no", F.pmod(F.xxhash64("d2"), "buckets").alias("bucket")
    )
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_starts = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select(
        "source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start")
    )
    inside = Window.partitionBy("source_no", "bucket").orderBy("d1", "d2").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        numbered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bucket_starts, ["source_no", "bucket"])
        .select("d1", "d2", "id", "source_no", (F.col("bucket_start") + F.col("inside")).alias("start"), "size")
    )
    facts = [{"source": r[1], "n_slots": r[8]} for r in rows]
    return Mixture(kept(placed), sources, facts, block_words, shard_slots, seed)
