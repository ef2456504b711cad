"""Line dedup and SimHash groups against brute force, with awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from chronopanel.llm import graph, line_dedup, simhash

LINES = ["Licensed to all.", "  licensed TO all.\t", "ÉTÉ à Paris", "été à Paris", "", "   ", "x", "\x0bx\r", "own"]


def sample_texts(n, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "\n", "\n\n", "x\n" * 3000 + "y", "Licensed to all."]
    for i in range(n):
        lines = [rng.choice(LINES) if rng.random() < 0.6 else f"line {rng.randint(0, 40)} of {i % 7}" for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    return texts + texts[6:9] * 3


@pytest.mark.parametrize("hot_parts", [2000, 1])
def test_line_dedup(spark, monkeypatch, hot_parts):
    """Also with every key on the hot path's other side, and with columns that bear the operator's own names."""
    monkeypatch.setattr(line_dedup, "HOT_PARTS", hot_parts)
    texts = sample_texts(120)
    rows = [(i if i % 11 else None, t, i, "h", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, h1 LONG, n_lines STRING, pos LONG")
    got = {r["pos"]: r for r in line_dedup.dedup_lines(df).select("doc.pos", "n_lines", "n_dropped", "kept_text").collect()}
    for i, want in enumerate(brute.line_dedup(texts)):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == want, (i, texts[i])


def test_line_dedup_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same line")] * 12 + [(2, "other")], "doc_id LONG, text STRING")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r["doc"]["doc_id"], r["n_dropped"], r["kept_text"]) for r in got) == [(1, 1, "")] * 12 + [(2, 0, "other")]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_hot_lines_take_the_map_side_path(spark):
    """One line in every document is matched without a shuffle of its rows, and rare ones are not lost."""
    texts = [f"hot\nonly {i}\npair {i // 20}" for i in range(2400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r["doc"]["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: f"only {i}" for i in range(2400)}


def test_fingerprints_by_definition():
    rng = random.Random(3)
    words = ["Ab", "cd", "É", "x" * 50, "日本", "É", "a-b"]
    texts = [None, "", " \t\n", "One", "one two", "ONE two three", " ".join(rng.choice(words) for _ in range(500))]
    texts += [" \x0b".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + "\x85  y" for _ in range(50)]
    assert [simhash.fingerprint(t) for t in texts] == [brute.fingerprint(t) for t in texts]


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("most", [2048, 40])
def test_links_connect_what_belongs_together(spark, most):
    """Chains, dense groups and points that share almost all bits; with 40, buckets are split over several levels."""
    rng = random.Random(5)
    points = {0, 1, 3, 2**63, 2**64 - 1}
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            points.add(fp)
            fp = near(rng, fp, rng.choice([1, 2, 2, 3]))
    crowd = rng.getrandbits(64)
    points |= {crowd ^ rng.getrandbits(9) for _ in range(300)} | {near(rng, crowd, 5) for _ in range(80)}
    points = sorted(points)
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp LONG")
    found = simhash.links(df, 2, most).collect()
    assert len(found) <= 30 * len(points)  # some links per probe, not all pairs of the crowd
    where = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(points)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[top(where[r["a"]])] = top(where[r["b"]])
    mine, want = [top(i) for i in range(len(points))], brute.groups(points)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_unequal_thresholds_still_find_all():
    """The dynamic program keeps the sum and takes the cheapest, and skips a partition that is all alike."""
    assert simhash.allocate([[0, 9, 99, 999], [0, 1, 5, 50], [0, 1, 7, 70]], 0) in ([-1, 1, 0], [0, 0, 0])
    assert simhash.allocate([[0, 1e9, 2e9, 3e9], [0, 1, 5, 50], [0, 1, 7, 70]], 0) == [-1, 1, 0]
    assert simhash.allocate([[0, 1, 2e9, 3e9], [0, 1, 5, 50], [0, 1, 7, 70]], 0) == [0, 0, 0]


def test_skewed_bits(spark):
    """Nearly all points share two thirds of their bits: thresholds become unequal and nothing is lost."""
    rng = random.Random(8)
    head = rng.getrandbits(22) << 42
    points = sorted({head | rng.getrandbits(40) << 2 for _ in range(400)} | {head | rng.getrandbits(6) for _ in range(60)})
    points = sorted(set(points) | {near(rng, p, 2) for p in points[:100]})
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp LONG")).collect()
    graph_of = {}
    for r in found:
        graph_of.setdefault(r["a"], set()).add(r["b"])
        graph_of.setdefault(r["b"], set()).add(r["a"])
    want = brute.groups(points)
    for i, f in enumerate(signed):
        seen, todo = {f}, [f]
        while todo:
            new = graph_of.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert seen == {g for g, w in zip(signed, want, strict=True) if w == want[i]}


def test_group(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base, base + " end", None, "", "   ", "Other text", "other TEXT", "long " * 50_000]
    rows = [(10 - i, t, i, "f") for i, t in enumerate(texts)] + [(None, base, 9, "f"), (10, base, 0, "f")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, fp LONG, component STRING")
    got = simhash.group(df).collect()
    prints = [brute.fingerprint(r[1]) for r in rows]
    assert len(got) == len(rows)
    want = brute.groups(prints)
    ids = {g: min(r[0] for r, w in zip(rows, want, strict=True) if w == g and r[0] is not None) for g in set(want)}
    expected = sorted((str(r[0]), p, ids[w]) for r, p, w in zip(rows, prints, want, strict=True))
    assert sorted((str(r["id"]), r["fp"] & (2**64 - 1), r["component"]) for r in got) == expected
    assert simhash.group(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 300)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5001), (5001, 5002), (7, 7)]
    names = {x: rng.getrandbits(62) for pair in links for x in pair}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a LONG, b LONG")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    parts = [range(1, 301), range(1000, 1400), range(5000, 5003)]
    roots = [{got[names[x]] for x in part} for part in parts]
    assert all(len(r) == 1 for r in roots) and len(set.union(*roots)) == 3


def test_group_is_stable_over_partitionings(spark):
    df = spark.range(200).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h "), (F.col("id") % 9).cast("string")).alias("text")
    )
    a = sorted(map(tuple, simhash.group(df).collect()))
    assert a == sorted(map(tuple, simhash.group(df.repartition(13)).collect()))
