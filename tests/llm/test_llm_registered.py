"""The registered queries themselves, on an awkward table of their own, against the plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
from chronopanel.llm import packing
from chronopanel.llm.queries import QUERIES

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were".split()


def texts():
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = [None, "", "   ", "\n", "One", "ÉTÉ à 日本 " + prose(30), prose(9000), "x"]
    for i in range(60):
        body = prose(rng.randint(3, 120))
        extra = [
            f" mail a.b-{i}@mail{i}.example.com now", f" from 10.{i}.0.255 or 1.2.3.999", " card 4111 1111 1111 1111 or 4111 1111 1111 1112", " call +49 (30) 12345-678 or +1 23",
            f" api_key: {hexes(24)} and Password='{hexes(8)}'", f" AKIA{hexes(16).upper()} {hexes(40)}", "\nshared line\n Shared LINE \t\n", "",
        ]
        out.append(body + extra[i % 8] + " " + prose(5))
    return out + out[10:16] + out[12:14]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(5)
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None, "é"]), len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").repartition(3)
    df.write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(i % 2), 0) for i, r in enumerate(rows) if i % 3 == 0]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path, rows


def result(spark, folder, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder[0]).collect()}


def test_language_id(spark, folder):
    got = result(spark, folder, "op1_language_id")
    for i, text, *_ in folder[1]:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("und", "en", "de") and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("name", "kinds", "base"),
    [("op3_pii", ("email", "ip", "card", "phone"), brute.pii_base), ("op6_secrets", ("assign", "access", "hex"), brute.secret_base)],
)
def test_spans(spark, folder, name, kinds, base):
    got = result(spark, folder, name)
    found = 0
    for i, text, *_ in folder[1]:
        want = base(text or "")
        found += len(want)
        r = got[i]
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[1] == n for w in want) for n in range(len(kinds))]
        assert r["base_sha256"] == brute.sha(brute.joined(want, kinds))
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{kinds[k]}:{s}:{e}" for s, k, e in want} <= set(spans)
        order = [(int(s), kinds.index(k), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert order == sorted(order) and all(0 <= s < e <= len(text or "") for s, _, e in order)
    assert found > 20


def test_packing(spark, folder):
    rows = QUERIES["op4_packing"](spark, folder[0]).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    used = defaultdict(list)
    per_doc = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text, *_ in folder[1]:
        own = sorted(per_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(r["length"] == 2048 for r in own[:-1]) and own[-1]["length"] >= 1
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)


def test_line_dedup(spark, folder):
    got = result(spark, folder, "op5_line_dedup")
    for (i, *_), (lines, dropped, kept) in zip(folder[1], brute.line_dedup([t for _, t, *_ in folder[1]]), strict=True):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (lines, dropped, brute.sha(kept))


def test_spotsigs(spark, folder):
    got = result(spark, folder, "op7_spotsigs")
    rows = sorted(folder[1])
    sets = lambda hexes: {hexes[k : k + 16] for k in range(0, len(hexes), 16)}
    alike = lambda a, b: len(a & b) / len(a | b)
    for at, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(edited))
        own = sets(r["fingerprint"])
        assert r["near_edited"] == pytest.approx(alike(own, sets(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(alike(own, sets(got[after[0]]["fingerprint"])))
    prints = defaultdict(set)
    for i, text, *_ in rows:
        prints[text or ""].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_mixing(spark, folder):
    got = result(spark, folder, "op8_mixing")
    size = lambda t: len(re.findall(brute.WORD, t or ""))
    by_source = defaultdict(int)
    for _, text, _, source, _ in folder[1]:
        by_source[source] += size(text)
    taken, target = defaultdict(int), {}
    for i, text, _, source, _ in folder[1]:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size(text), by_source[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    share = sum(by_source.values()) / sum((5, 2, 1)[k % 3] for k in range(len(order)))
    for k, s in enumerate(order):
        assert target[s] <= 3 * by_source[s] + 1e-6 and abs(taken[s] - target[s]) <= 2
        free = share * (5, 2, 1)[k % 3]
        assert target[s] == pytest.approx(3 * by_source[s]) or target[s] >= free - 1e-6
    assert sum(target.values()) == pytest.approx(sum(by_source.values()))


def test_simhash(spark, folder):
    got = result(spark, folder, "op9_simhash")
    prints = [brute.fingerprint(t) for _, t, *_ in folder[1]]
    groups = brute.groups(prints)
    lowest = {g: min(r[0] for r, h in zip(folder[1], groups, strict=True) if h == g) for g in set(groups)}
    for (i, *_), fp, g in zip(folder[1], prints, groups, strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", lowest[g])


def test_quality(spark, folder):
    got = result(spark, folder, "op2_quality")
    assert set(got) == {r[0] for r in folder[1]}
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("quality", "doc_quality", "host_quality", "path_quality"))
    assert all(r["keep"] == (r["quality"] >= 0.5) for r in got.values())
