"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

A text is lower-cased (A-Z), cut into words, and its shingles of ``words`` words, repeats included, are hashed by XXH64;
a bit of the fingerprint is 1 if it is set in over half of the hashes. Fingerprints that differ in at most ``bits`` bits
are linked; links through others count, so groups are connected components.

*Candidates.* Equal fingerprints are one point. The 64 bits are put into ``bits + 1`` partitions, bits that go together
in the data into the same one, so that what repeats elsewhere does not repeat in every partition. Each partition i gets a
threshold t_i, -1 (not probed) or more, with sum 0: then of two fingerprints within ``bits`` bits at least one partition
differs in at most t_i bits. A dynamic program chooses the thresholds with the fewest estimated candidate pairs and
probes, from the measured number of pairs equal in a partition and the measured share of ones of each bit. A partition
with threshold t is probed by its value under every choice of t masked bits.
*Hot buckets.* A bucket of more than ``MOST`` points is split: its free bits are partitioned again in the same way and
its points probed anew within it. Each level fixes a third of the free bits, and points are distinct, so after a few
levels no bucket can hold more than ``MOST``; none is capped and no link is lost.
*Verification* compares the points of a bucket in numpy and emits links that connect what belongs together, not all
pairs, so a group of thousands of near copies gives as many rows as it has members.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are copies of each other. A group
is named by its smallest id; rows with a null id get their group's name as well (null if all of it are). An empty table
gives an empty one. Input columns come back inside the struct ``doc``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept
from chronopanel.llm.graph import components

SEED = 42
MOST = 2048
SALTS = 64
_CHUNK = 1 << 16
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[i] += np.bincount(octets[:, i], minlength=256) @ _BITS_OF_BYTE
    bits = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, axis=1).reshape(-1).view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, text_col: str = "text") -> DataFrame:
    """(doc, fp) with the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(doc.alias("doc"), signed(F.col(text_col).cast("string")).alias("fp"))


def _bit_counts(points: DataFrame) -> tuple[int, np.ndarray]:
    """Number of points, and how many have bits i and j both set."""

    def count(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            for at in range(0, len(batch), 1 << 16):
                fps = batch["fp"].to_numpy(np.int64)[at : at + (1 << 16)]
                x = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(fps)
        yield pd.DataFrame({"cell": np.arange(4097), "n": np.append(total.reshape(-1), n).astype(np.int64)})

    rows = points.select("fp").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of equal size (within one bit) of bits that correlate: each takes its strongest pair and grows from it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, -1)
    left = list(range(64))
    groups: list[list[int]] = []
    for p in range(parts):
        size = -(-len(left) // (parts - p))
        own = [max(left, key=lambda i: (max((tie[i, j] for j in left if j != i), default=0.0), -i))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda i: (tie[i, own].mean(), -i))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds, one per partition from -1 on, with this sum and the least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, own in enumerate(options, start=-1):
                if done + t not in after or cost + own < after[done + t][0]:
                    after[done + t] = (cost + own, [*chosen, t])
        best = after
    return best[total][1]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _probe(points: DataFrame, free: int, masks: list[int]) -> DataFrame:
    """First level: (fp, key, free) for every mask of bits that a key fixes."""

    def keys(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for i, m in enumerate(masks):
                key = _mix((fps.view(np.uint64) & np.uint64(m)) ^ _mix(np.uint64([i + 1])))
                yield pd.DataFrame({"fp": fps, "key": key.view(np.int64), "free": np.uint64([free & ~m]).view(np.int64)[0]})

    return points.select("fp").mapInPandas(keys, "fp long, key long, free long")


def _thirds(free: int, parts: int) -> list[int]:
    own = [b for b in range(64) if free >> b & 1]
    return [_mask(own[p::parts]) for p in range(parts)]


def _probe_again(rows: DataFrame, parts: int) -> DataFrame:
    """A level below: each point by each part of its bucket's free bits, within the bucket."""

    def keys(batches):
        for batch in batches:
            for free, own in batch.groupby("free"):
                fps, parents = own["fp"].to_numpy(np.int64), own["key"].to_numpy(np.int64).view(np.uint64)
                open_ = int(free) & (2**64 - 1)
                for i, m in enumerate(_thirds(open_, parts)):
                    key = _mix(_mix((fps.view(np.uint64) & np.uint64(m)) ^ _mix(np.uint64([i + 1]))) ^ parents)
                    rest = np.uint64([open_ & ~m]).view(np.int64)[0]
                    yield pd.DataFrame({"fp": fps, "key": key.view(np.int64), "free": rest})

    return rows.mapInPandas(keys, "fp long, key long, free long")


def _links_of_bucket(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect all points of one bucket that belong together, fewer than points: each group's first with the rest."""
    n = len(fps)
    near = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= bits
    left = np.ones(n, dtype=bool)
    out = []
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & left)
            left[reached] = False
            out.append((np.full(len(reached), fps[i]), fps[reached]))
            front = reached
    return out


def _verify(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) of linked points, from rows (key, fp) that lie together by key."""

    def links(batches):
        held_key, held = None, np.zeros(0, np.uint64)

        def solve(keys, fps):
            out = []
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            small = np.repeat(sizes <= 8, sizes)
            for d in range(1, 8):  # small buckets all at once, by distance in the sorted order
                a, b = fps[:-d], fps[d:]
                hit = (keys[:-d] == keys[d:]) & small[d:] & (np.bitwise_count(a ^ b) <= bits)
                out.append((a[hit], b[hit]))
            for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
                out += _links_of_bucket(fps[s : s + n], bits)
            a, b = (np.concatenate(x).view(np.int64) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True))
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            keys = batch["key"].to_numpy(np.int64)
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            if held_key is not None:
                keys = np.concatenate([np.full(len(held), held_key), keys])
                fps = np.concatenate([held, fps])
            if not len(keys):
                continue
            held_key = keys[-1]
            cut = int(np.searchsorted(keys, held_key, side="left"))  # the last bucket may go on in the next batch
            held = fps[cut:]
            if cut:
                yield solve(keys[:cut], fps[:cut])
        if held_key is not None and len(held):
            yield solve(np.full(len(held), held_key), held)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(links, "a long, b long")


def links(points: DataFrame, bits: int = 2, most: int = MOST) -> DataFrame:
    """(a, b): pairs of distinct fingerprints of one group, enough to connect all that are within ``bits`` bits."""
    parts = bits + 1
    n, both = _bit_counts(points)
    groups = group_bits(n, both, parts)
    share = np.diag(both) / max(n, 1)
    agree = share**2 + (1 - share) ** 2
    equal = (
        _probe(points, -1 & (2**64 - 1), [_mask(g) for g in groups])
        .groupBy("key", "free").count()
        .groupBy("free").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
        .collect()
    )
    found = {int(r["free"]) & (2**64 - 1): r["pairs"] for r in equal}
    costs = []
    for g in groups:
        pairs = found.get((2**64 - 1) & ~_mask(g), 0.0) + 1
        odds = (1 - agree[g]) / agree[g]
        by_distance = np.zeros(bits + 1)  # expected pairs at each distance, relative to distance 0
        by_distance[0] = 1
        for o in odds:
            by_distance[1:] += by_distance[:-1] * o
        probes = [n * comb(len(g), t) for t in range(bits + 1)]
        costs.append([0.0, *(pairs * np.cumsum(by_distance) + probes)])
    thresholds = allocate(costs, bits - parts + 1)
    masks = [_mask(set(g) - set(c)) for g, t in zip(groups, thresholds, strict=True) if t >= 0 for c in combinations(g, t)]
    rows = _probe(points, 2**64 - 1, masks)
    final = None
    while True:
        hot = kept(rows.groupBy("key").count().where(F.col("count") > most).select("key"))
        if hot.isEmpty():
            final = rows if final is None else final.unionByName(rows)
            break
        salted = rows.withColumn("salt", F.pmod("fp", F.lit(SALTS)))
        spread = hot.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        cold = salted.join(spread, ["key", "salt"], "left_anti").select("fp", "key", "free")
        final = cold if final is None else final.unionByName(cold)
        rows = _probe_again(salted.join(spread, ["key", "salt"], "left_semi").select("fp", "key", "free"), parts)
    return _verify(final, bits)


def group(df: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row: its fingerprint and the smallest id of its group."""
    rows = kept(fingerprints(df.select(id_col, text_col), words, text_col).select(F.col(f"doc.{id_col}").alias("id"), "fp"))
    points = kept(rows.groupBy("fp").agg(F.min("id").alias("first")))
    node = F.xxhash64("fp")  # one to one for a 64-bit number
    found = links(points, bits)
    roots = components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    linked = kept(points.withColumn("node", node).join(roots, "node").select("fp", "first", "root"))
    lowest = kept(linked.groupBy("root").agg(F.min("first").alias("lowest")))
    named = linked.join(lowest, "root").select(F.col("fp").alias("linked_fp"), "lowest")
    component = kept(
        points.join(named, F.col("fp") == F.col("linked_fp"), "left").select(
            F.col("fp").alias("point"), F.coalesce("lowest", "first").alias("component")
        )
    )
    return rows.join(component, F.col("fp") == F.col("point")).select("id", "fp", "component")
