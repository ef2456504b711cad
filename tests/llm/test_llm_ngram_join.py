"""N-gram Jaccard join against all pairs by definition."""

import random
from collections import defaultdict

import numpy as np
import pytest

from chronopanel.llm import ngram_join
from chronopanel.llm.queries import QUERIES
from __spark_entry__ import SMOKE_DIR


def brute(rows, words=5, percent=80):
    """Sorted (id, size, component) of rows (id, text)."""
    sets = []
    for _, text in rows:
        parts = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset())
    holders = defaultdict(set)
    for at, own in enumerate(sets):
        for shingle in own:
            holders[shingle].add(at)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, own in enumerate(sets):
        for other in {o for shingle in own for o in holders[shingle] if o < at}:
            both = len(own & sets[other])
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                parent[top(at)] = top(other)
    lowest = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            lowest[top(at)] = min(i, lowest.get(top(at), i))
    named = [(i, len(s), lowest.get(top(at)) if s else i) for at, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(named, key=str)


def edited(rng, parts, edits):
    parts = list(parts)
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return parts


def sample(seed=4):
    """Near copies at many distances, a large group around the limit, a passage that many texts share, awkward rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \t\x0b", "One", "one", "one two three four", "ONE two\nthree\x0cfour", "a b c d e", "A B C D E F", "x " * 60_000]
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(200)]
    for _ in range(25):
        own = [word() for _ in range(rng.randint(6, 300))]
        texts += [" ".join(edited(rng, own, k)) for k in (0, 0, 1, 2, 4, 8)]
    texts += [" ".join(edited(rng, base, rng.randint(0, 12))) for _ in range(150)]
    texts += [" ".join([word() for _ in range(rng.randint(0, 30))] + passage) for _ in range(80)]
    for n in range(5, 60):  # exactly at the limit: n of 5 n / 4 shingles in common
        texts += [" ".join(f"l{n}.{i}" for i in range(n + 4)), " ".join(f"l{n}.{i}" for i in range(n + 4 + n // 4))]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[30]), (None, "text without an id but of its own and five words"), (7, texts[200]), (7, texts[40])]
    return rows


@pytest.mark.parametrize("block", [512, 10])
def test_join(spark, monkeypatch, block):
    """With small blocks groups are cut, compared with their leaders first, and met tile by tile."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id LONG, text STRING, point STRING, n LONG")
    got = [tuple(r) for r in ngram_join.join(df.repartition(5)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_shingles_change_nothing(spark, monkeypatch):
    """Every frequent shingle on the broadcast path."""
    rows = sample(9)
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = []
    real = ngram_join.hot_shingles

    def all_hot(texts, words, total):
        found.append(len(real(texts, words, total)))
        tokens = [ngram_join.Shingler(words)(t)[1] for _, t in rows]
        values, times = np.unique(np.concatenate(tokens), return_counts=True)
        return values[times > 2]

    monkeypatch.setattr(ngram_join, "hot_shingles", all_hot)
    assert sorted((tuple(r) for r in ngram_join.join(df).collect()), key=str) == brute(rows)
    assert found[0] > 0  # the shared passage is found by the real count too


def test_other_lengths_and_limits(spark):
    rows = sample(11)
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = ngram_join.join(df, words=3, percent=60).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 60)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert ngram_join.join(df).collect() == []


def test_filters_lose_nothing_and_do_something():
    """Every linked pair passes all orders; intersecting them leaves fewer pairs than the first alone."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    shingler, known = ngram_join.Shingler(5), ngram_join.Orders(np.zeros(0, np.uint64), 80)
    sets = [shingler(" ".join(edited(rng, base, rng.randint(0, 45))))[1] for _ in range(120)]
    near = ngram_join.linked(sets, None, known)
    passed = []
    for order in range(ngram_join.ORDERS):
        none = lambda s: np.zeros(len(s), bool)
        prefixes = [set(s[known.first(known.keys(s, order, none(s)))].tolist()) for s in sets]
        passed.append({(i, j) for i in range(120) for j in range(i) if prefixes[i] & prefixes[j]})
    links = {(i, j) for i in range(120) for j in range(i) if near[i, j]}
    want = {(i, j) for i in range(120) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert links == want and links <= set.intersection(*passed) < passed[0]


def test_registered_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_ngram_join"](spark, SMOKE_DIR)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
