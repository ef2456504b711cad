"""Collocations and source divergence against their definitions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from chronopanel.llm import collocations, divergence


def pieces(text):
    cut = re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.ASCII_LOWER))
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in cut) if w]


def brute_phrases(rows, min_count, covered=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {g: n for g, n in f.items() if len(g) > 1 and n >= min_count}
        gone = {g for c, n in candidates.items() if len(c) == 3 for g in (c[:2], c[1:]) if g in candidates and 100 * n >= covered * f[g]}
        scored = []
        for g, a in candidates.items():
            if g in gone:
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], start=1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def sample(seed=1, n=300):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ;", "? ", "\x0b"]
    rows = [(None, "en"), ("", "en"), ("...", None), ("x " * 30_000, "en"), ("One", None), ("ÉTÉ à Été à", "fr")]
    for _ in range(n):
        words = [rng.choice(["The", "the", "of", "new", "york", "é", "日本", "-", "a'b", f"w{rng.randrange(20)}"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice(ends) for w in words)
        rows.append((text + (passage if rng.random() < 0.2 else ""), rng.choice(["en", "en", "fr", None])))
    return rows + rows[20:40] * 2


@pytest.mark.parametrize("hot_parts", [2048, 8])
def test_collocations(spark, monkeypatch, hot_parts):
    """Also where many words are hot, singly and in pairs."""
    monkeypatch.setattr(collocations, "HOT_PARTS", hot_parts)
    rows = sample()
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text STRING, lang STRING, first STRING, n INT").repartition(7)
    for least, covered, top in ((10, 50, 2000), (3, 80, 40)):
        got = collocations.collocations(df, least, covered, top).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == brute_phrases(rows, least, covered, top)


def test_paths_are_the_edges(spark):
    """Every frequent run of three words lies on one path, and a passage that nothing enters or leaves is one row."""
    rows = sample(3)
    df = spark.createDataFrame(rows, "text STRING, lang STRING").select("text", F.coalesce("lang", F.lit("und")).alias("lang")).na.fill("")
    edges, pairs, _, _ = collocations.flows(df, 10)
    runs = collocations.paths(edges, collocations.nodes(edges, pairs)).collect()
    unfolded = Counter()
    for r in runs:
        for i in range(len(r["words"]) - 2):
            unfolded[(r["lang"], *r["words"][i : i + 3], r["n"])] += 1
    assert set(unfolded.values()) == {1}
    assert set(unfolded) == {(r["lang"], r["w1"], r["w2"], r["w3"], r["n"]) for r in edges.collect()}
    assert any([f"p{i}" for i in range(1, 60)] == r["words"][-59:] for r in runs)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text STRING, lang STRING")
    assert collocations.collocations(df).collect() == []


def brute_audit(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(brute.ASCII_LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        every = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (n + 1) // (sum(c.values()) + v) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(every)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            words = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", words)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, start=1)}
    return out


@pytest.mark.parametrize(("terms", "groups", "low"), [(8192, 32, 8), (16, 2, 2)])
def test_audit(spark, monkeypatch, terms, groups, low):
    """Also with many blocks of terms and of groups, and most levels on the sparse side."""
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    rng = random.Random(2)
    rows = [(None, None, None), ("", "", ""), ("only here", "xx", "s1"), ("ab ab ab " * 20_000, "en", "s1"), ("42 - 17", "yy", "s1"), ("1", "yy", "s2")]
    for i in range(250):
        words = [rng.choice(["Été", "été", "日本", "a_b", "the", "The9the", f"w{chr(97 + int(rng.expovariate(0.2)) % 26)}"]) for _ in range(rng.randrange(40))]
        rows.append((" ".join(words), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s2", "s3", f"s{i % 9}", None, "é"])))
    rows += rows[10:20]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text STRING, lang STRING, source STRING, n INT, part INT").repartition(5)
    got = divergence.audit(df, top=30).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_audit(rows, top=30)
    assert divergence.audit(df.limit(0)).collect() == []


def test_joint_tables_price_what_the_sum_prices(monkeypatch):
    """Dense and sparse products of level indicators against the plain sum over terms, also far beyond 32 bits."""
    rng = np.random.default_rng(4)
    left, right = (rng.geometric(0.3, (500, k)) - 1 for k in (4, 3))
    left[:5] += rng.integers(0, 10**12, (5, 4))
    n_left, n_right = left.sum(axis=0), right.sum(axis=0)
    for low in (1, 3, 8):
        monkeypatch.setattr(divergence, "LOW", low)
        there, back = divergence.price_block(left, right, n_left, n_right, 700)
        for g in range(4):
            for h in range(3):
                p = [1 + 10**9 * (int(c) + 1) // (int(n_left[g]) + 700) for c in left[:, g]]
                q = [1 + 10**9 * (int(c) + 1) // (int(n_right[h]) + 700) for c in right[:, h]]
                assert there[g, h] == sum((a - b) ** 2 // b for a, b in zip(p, q, strict=True))
                assert back[g, h] == sum((a - b) ** 2 // a for a, b in zip(p, q, strict=True))
