"""Pack documents into sequences: dominance reduction first, best fit for the remainder.

A document's tokens end with id 0. Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` tokens
of which the last may be shorter. What is packed then are counts of pieces per length, at most ``capacity`` numbers
whatever the corpus, so choosing patterns is small work and does not grow with the rows.

*Reduction* (after Martello and Toth): for the longest open length, find a set of at most three pieces that dominates
every other set a sequence with that piece could hold, and fix as many such sequences as the counts allow. A piece that
nothing fits beside is alone. If at most one more piece can join it, the longest fitting one dominates, as it can take
the place of any other. A pair that fills the sequence exactly dominates too, as does a pair whose partner is at least
as long as any two pieces that fit together. What no rule covers is left.
*Best fit* decreasing packs the remainder: a length at a time, each piece into the fullest open sequence that takes it;
sequences with equal contents are handled together, as a pattern and a number.

Every pattern says, for each of its lengths, which ranks of that length it takes. Pieces get ranks within their length
in two steps, in hash buckets and over buckets, since one length may hold a third of all rows, and look up their
sequence and offset by binary search. No text, id or piece passes the driver.

Null and empty texts are one piece of one token. Repeated rows are documents of their own. An empty table gives an empty
result. Input columns come back inside the struct ``doc``, so names cannot clash. Very long texts are tokenised whole and
become as many pieces as they fill.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept, partitions
from chronopanel.llm.tokens import encoder

BUCKET_ROWS = 20_000

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(
    df: DataFrame, capacity: int = 2048, tokenizer: str | None = None, text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]) of every document; ids as little-endian 32-bit numbers."""
    path = tokenizer or default_tokenizer()
    row = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    @F.pandas_udf(f"array<struct<{row.replace(' int', ': int').replace(' long', ': long').replace(' binary', ': binary')}>>")
    def cut(texts: pd.Series) -> pd.Series:
        own = encoder(path)
        out: list[list[dict]] = []
        for text in texts:
            ids = own.encode(text or "") + b"\0\0\0\0"
            rows = []
            for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                r = {"piece": i, "start": start // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                rows.append(r | {"ids": part} if with_ids else r)
            out.append(rows)
        return pd.Series(out)

    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # called non-deterministic lest the optimiser evaluate it a second time to filter empty arrays
    return df.select(doc.alias("doc"), cut.asNondeterministic()(F.col(text_col).cast("string")).alias("cut")).select("doc", F.inline("cut"))


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance and the counts that remain."""
    left = {w: n for w, n in counts.items() if n}
    lengths = sorted(left)
    fixed: list[Pattern] = []

    def use(items: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for w in items:
            need[w] += 1
        n = min(left[w] // k for w, k in need.items())
        fixed.append((items, n))
        for w, k in need.items():
            left[w] -= n * k
            if not left[w]:
                del left[w]
                lengths.pop(bisect_left(lengths, w))

    def longest(room: int, but: dict[int, int]) -> int | None:
        """The longest length within ``room`` that is left beside the pieces in ``but``."""
        i = bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= but.get(lengths[i], 0):
            i -= 1
        return lengths[i] if i >= 0 else None

    def smallest(many: int, but: dict[int, int]) -> list[int]:
        out: list[int] = []
        for w in lengths:
            out += [w] * min(many - len(out), left[w] - but.get(w, 0))
            if len(out) == many:
                break
        return out

    passed: list[int] = []  # lengths no rule covers, taken out of the search for a longest piece
    while True:
        top = next((w for w in reversed(lengths) if w not in passed), None)
        if top is None:
            break
        room = capacity - top
        partner = longest(room, {top: 1})
        if partner is None:
            fixed_before = left[top]
            fixed.append(((top,), fixed_before))
            del left[top]
            lengths.pop(bisect_left(lengths, top))
            continue
        small = smallest(3, {top: 1})
        pair_fits = len(small) >= 2 and sum(small[:2]) <= room
        if partner == room or not pair_fits:
            use((top, partner))
            continue
        if len(small) == 3 and sum(small) <= room:  # three that fit can be worth more than one at least as long as any two
            passed.append(top)
            continue
        # two more pieces can join, not three: the longest fitting one still dominates if no two that fit exceed it
        best_two = 0
        for w in reversed(lengths[: bisect_right(lengths, room)]):
            other = longest(room - w, {top: 1, w: 1} if w != top else {top: 2})
            if other is not None:
                best_two = max(best_two, w + other)
            if best_two == room or 2 * w <= best_two:
                break
        if partner >= best_two:
            use((top, partner))
            continue
        passed.append(top)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first, over patterns with numbers of sequences."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(items: tuple[int, ...], n: int) -> None:
        room = capacity - sum(items)
        if not room:
            done.append((items, n))
            return
        if not open_[room]:
            insort(rooms, room)
        open_[room].append((items, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = min(capacity // w, n)
                many = n // each
                put((w,) * each, many)
                n -= many * each
                continue
            room = rooms[i]
            items, have = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            each = min(room // w, n)
            many = min(have, n // each)
            if have > many:
                put(items, have - many)
            put(items + (w,) * each, many)
            n -= many * each
    return done + [p for patterns in open_.values() for p in patterns]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the sequence of that rank and the offset in it."""
    rank: dict[int, int] = defaultdict(int)
    keys, sequences, offsets = [], [], []
    first = 0
    for items, n in patterns:
        offset = 0
        for w in items:
            keys.append((w << 44) + rank[w])
            sequences.append(first)
            offsets.append(offset)
            rank[w] += n
            offset += w
        first += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    pick = lambda x: np.array(x, dtype=np.int64)[order]
    return pick(keys), pick(sequences), pick(offsets)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset in addition."""
    cut = kept(cut)
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    most = max(counts.values(), default=1)
    buckets = max(partitions(spark), -(-most // BUCKET_ROWS))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("ids_crc32", "doc", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # a whole order, so that a recomputed task deals out the same places
    inside = Window.partitionBy("length", "bucket").orderBy("ids_crc32", F.xxhash64("doc", "piece"), "piece")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("nth"))
        .drop("bucket", "nth", "first")
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = shared.value
        wanted = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        i = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[i] + (wanted - keys[i]), "offset": offsets[i]})

    return ranked.withColumn("at", place("length", "rank")).select(*cut.columns, "at.sequence_id", "at.offset")
