"""Token ids, packing, mixing, top-k search and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from chronopanel.llm import mixing, packing, stages, tokens, topk_search
from chronopanel.llm.queries import QUERIES

PATH = packing.default_tokenizer()
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


ODD = ["don't I'll you're '", "it's'sx 'S", "x<|endoftext|>y <|startoftext|>", " a\u0085b", "é Å", "ÀÉß ÿŸ ÷×", "a\x1cb\x0bc\x0cd",
       "___ a_b", "Σας ΟΔΟΣ", "İstanbul", "中文 字", "", " \n\t ", "ª º ² ½ µ", "a" * 3000, "1 22 a3b4", "w.,;w ..w", "é"]


@pytest.mark.parametrize("generation", [250_000, 3])
def test_token_ids(monkeypatch, generation):
    monkeypatch.setattr(tokens, "GENERATION_WORDS", generation)
    own = tokens.Encoder(PATH)
    for text in ODD * 2 + [chr(c) * 2 + "a" + chr(c) for c in range(1, 0x180)]:
        assert own.encode(text) == ids_of(text), text


OWN = tokens.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abCé'stre \n\t.,-!1<|ßÀ́Ω\xa0"), max_size=40))
def test_token_ids_of_any_text(text):
    assert OWN.encode(text) == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=15))))
def test_plans_place_all_pieces(case):
    capacity, counts = case
    fixed, rest = packing.reduce_by_dominance(dict(counts), capacity)
    placed = defaultdict(int)
    for items, n in fixed + packing.best_fit(rest, capacity):
        assert n > 0 and sum(items) <= capacity
        for w in items:
            placed[w] += n
    assert placed == counts


def least_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[i] <= capacity:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b + items[i]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    """What dominance fixes, with the best packing of the rest, needs no more sequences than the best packing of all."""
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randint(5, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = {w: items.count(w) for w in items}
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + least_bins(left, capacity) == least_bins(items, capacity)


def test_reduction_where_three_more_fit():
    """A longest partner that no two exceed does not dominate three."""
    items = [50, 45, 22, 22, 21, 20, 20, 20]
    counts = {w: items.count(w) for w in items}
    fixed, rest = packing.reduce_by_dominance(counts, 110)
    left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + least_bins(left, 110) == least_bins(items, 110) == 2


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(["the", "Quick", "fox,", "élan", "zzxxq"]) for _ in range(rng.randint(1, 60)))
        source = rng.choices(["a", "b", "ç", "Z", None], [6, 1, 1, 1, 1])[0]
        rows.append((i, text, "en", source, len(text)))
    rows += [(900, None, "en", "b", None), (901, "", None, "a", 0), (902, " \n ", "fr", "empty", 3), (None, "no id", "en", None, 5)]
    rows += rows[:30] + [(903, "long " * 9000, "en", "b", 45_000), (3, "same id, other text", "en", "a", 19)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").withColumn("size", F.lit(1))


def test_packing(docs):
    capacity = 64
    cut = packing.pieces(docs, capacity, PATH, with_ids=True)
    rows = packing.pack(cut, capacity).collect()
    whole = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert r["start"] == r["piece"] * capacity
        whole[r["doc"]["doc_id"], r["doc"]["text"]].append((r["piece"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (_, text), parts in whole.items():
        copies = sum(p == 0 for p, _ in parts)
        assert sorted(parts) == sorted(
            (i // (4 * capacity), (ids_of(text or "") + b"\0\0\0\0")[i : i + 4 * capacity])
            for i in range(0, len(ids_of(text or "")) + 4, 4 * capacity)
            for _ in range(copies)
        )
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(sum(p == 0 for p, _ in parts) for parts in whole.values()) == docs.count()
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / capacity + 2
    assert packing.pack(packing.pieces(docs.limit(0)), capacity).collect() == []


def test_packing_with_hot_lengths(spark, monkeypatch):
    """Ranks go through several buckets and no place is given twice."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    cut = spark.range(4000).select(
        F.struct("id").alias("doc"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 64).otherwise(1 + F.col("id") % 40).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"),
    )
    rows = packing.pack(cut, 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4000
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.fill_targets([10, 20, 1000], [5, 2, 1]) == pytest.approx([30, 60, 940])
    assert mixing.fill_targets([0, 0], [5, 2]) == [0, 0] and mixing.fill_targets([], []) == []


def test_mixing(docs):
    words = lambda t: len(__import__("re").findall(brute.WORD, t or ""))
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.fill_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for block in (1, 7, 512):
        mixture = mixing.mix(docs.drop("size"), block_words=block, shard_slots=16)
        rows = mixture.taken().collect()
        assert sorted(str((r["id"], r["size"])) for r in rows) == sorted(str((r["doc_id"], words(r["text"]))) for r in docs.collect())
        taken, target = defaultdict(int), {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source_size"], r["target"]] += r["taken"]
        want = defaultdict(float)
        for s in order:
            want[sizes[s], targets[s]] += targets[s]
        for key, n in taken.items():
            assert abs(n - want[key]) <= len(order), (block, key)
        slots = mixture.slots().collect()
        assert sorted(r["shard"] * 16 + r["slot"] for r in slots) == list(range(len(slots)))
        assert sum(r["words"] for r in slots) == sum(r["taken"] for r in rows)
    again = mixing.mix(docs.drop("size").repartition(7), block_words=7).taken().collect()
    first = mixing.mix(docs.drop("size"), block_words=7).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert mixing.mix(docs.drop("size").limit(0)).taken().collect() == []


def test_hot_source_goes_through_buckets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    rows = mixing.mix(docs.drop("size"), block_words=3).taken().collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), abs=6)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).round(2)]) for i in range(230)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (100, rows[0][1])]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [0.5]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("score", F.lit("x")).repartition(5)
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = [(i, [int(np.floor(1024 * x)) for x in v] if good(v) else None, i % 100 == 0) for i, v in rows if i is not None]
    for k, block in ((10, 16), (3, 512), (400, 8)):
        got = defaultdict(list)
        for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, k, block_rows=block).collect():
            got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
        want = brute.top_k(whole, k)
        assert set(got) == set(want)
        for q, lists in want.items():
            assert sorted(got[q]) == sorted((n + 1, i, s) for own in lists for n, (i, s) in enumerate(own)), q
    assert topk_search.top_k(df.limit(0), F.lit(True)).collect() == []
    assert topk_search.top_k(df, F.lit(False)).collect() == []


def test_top_k_leaves_out_the_own_row_alone(spark, tmp_path):
    """Other rows of the query's id, equal ones too, and rows without an id are candidates; bounds pass 64 bits."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4).round(2)]) for i in range(150)]
    rows += [(0, rows[0][1]), (100, rows[100][1]), (100, rows[100][1]), (100, rows[7][1]), (None, rows[0][1]), (None, [9.0] * 4)]
    rows += [(200, [1e6, -1e6, 1e6, 1e6]), (201, [3e6, 3e6, 0.0, 0.0]), (202, [-2e6, -2e6, 1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], r["score"]) for r in QUERIES["op10_topk_search"](spark, str(tmp_path)).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (i, v) in enumerate(whole):
        if i is not None and i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j) for m, (j, w) in enumerate(whole) if m != n)[:10]
            want += [(i, rank + 1, -1 if j is None else j, -s) for rank, (s, _, j) in enumerate(found)]
    assert got == sorted(want)
    queries, top, low = np.array([[2**31, 2**31]]), np.array([[2**32, 2**32]]), np.array([[0, 0]])
    assert topk_search._bounds(queries, top, low)[0, 0] >= 2.0**64


def test_pruning_skips_blocks(monkeypatch):
    """Clustered blocks: far ones are never scored, and the answer is the same."""
    rng = np.random.default_rng(1)
    centres = np.eye(8, dtype=np.int64) * 1000
    blocks = [(np.arange(b * 50, b * 50 + 50), centres[b % 8] + rng.integers(-20, 20, (50, 8))) for b in range(16)]
    scored = []
    plain = topk_search._products
    monkeypatch.setattr(topk_search, "_products", lambda q, m: scored.append(len(m)) or plain(q, m))
    queries = centres[:1]
    who, ids, score, _ = topk_search.best_of_blocks(queries, np.array([-1]), blocks, 5)
    everything = sorted((-int(s), int(i)) for own, m in blocks for i, s in zip(own, (queries @ m.T)[0]))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, score)] == everything
    assert len(scored) < 2 + 4


def test_stages_one_by_one(spark, docs):
    table = docs.drop("size")
    kept = stages.keep_identified(table).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in table.collect()} - {900, 901, 902}
    lines = stages.drop_shared_lines(table).collect()
    want = brute.line_dedup([r["text"] for r in table.collect()])
    assert sorted(r["text"] or "" for r in lines) == sorted(w[2] for w in want)
    assert sum(r["text"] is None for r in lines) == 1
    one = stages.keep_one_of_each_group(table)
    rows = table.collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    heads = {}
    for r, p, g in zip(rows, prints, brute.groups(prints), strict=True):
        heads.setdefault(g, []).append(r["doc_id"])
    firsts = sorted(str(min(x for x in ids if x is not None)) if any(x is not None for x in ids) else "None" for ids in heads.values())
    assert sorted(str(r["doc_id"]) for r in one.collect()) == firsts
    mixed = stages.take_mixture(table, block_words=7).collect()
    size = lambda t: len(__import__("re").findall(brute.WORD, t or ""))
    taken = defaultdict(int)
    for r in mixing.mix(table, block_words=7).taken().collect():
        taken[r["id"]] += r["taken"]
    out = defaultdict(int)
    texts = defaultdict(set)
    for r in table.collect():
        texts[r["doc_id"]].add(" ".join((r["text"] or "").split()))
    for r in mixed:
        out[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"]) and size(r["text"]) > 0
    assert dict(out) == {k: v for k, v in taken.items() if v}
    whole = [r for r in mixed if any(" ".join(r["text"].split()) == t for t in texts[r["doc_id"]])]
    assert len(whole) > len(mixed) / 3


def test_pipeline(spark, docs, tmp_path):
    folder = f"{tmp_path}/tables"
    docs.drop("size").write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert not {900, 901, 902} & {r["doc_id"] for r in rows}
    docs.drop("size").limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_shards_draw_their_sources(spark):
    """Shard counts scatter as multinomial draws do, other seeds draw otherwise, and few draws are corrected."""
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").repartition(3)
    mixture = mixing.mix(df, block_words=5, shard_slots=100)
    quota = [f["n_slots"] for f in mixture.facts]
    total = sum(quota)
    slots = mixture.assigned().collect()
    assert sorted((r["shard"], r["slot"]) for r in slots) == sorted((i // 100, i % 100) for i in range(total))
    for no, n in enumerate(quota):
        assert sorted(r["j"] for r in slots if r["source_no"] == no) == list(range(n))
    assert sum(r["drawn"] != r["source_no"] for r in slots) < 6 * total**0.5
    counts = Counter((r["shard"], r["drawn"]) for r in slots)
    whole = [s for s in range(total // 100)]
    for no, n in enumerate(quota):
        p = n / total
        own = np.array([counts[s, no] for s in whole])
        assert abs(own.mean() - 100 * p) < 4 * (100 * p * (1 - p) / len(whole)) ** 0.5
        assert 0.6 < own.var() / (100 * p * (1 - p)) < 1.5  # dealt out evenly it would be near nothing
    before = Counter()
    for r in sorted(mixture.shards().collect(), key=lambda r: r["shard"]):
        assert (r["n"], r["before"]) == (counts[r["shard"], r["drawn"]], before[r["drawn"]])
        before[r["drawn"]] += r["n"]
    other = mixing.mix(df, block_words=5, shard_slots=100, seed=18).drawn().orderBy("shard", "slot").collect()
    same = [r["drawn"] for r in mixture.drawn().orderBy("shard", "slot").collect()]
    assert same != [r["drawn"] for r in other]
    assert same == [r["drawn"] for r in sorted(slots, key=lambda r: (r["shard"], r["slot"]))]


def test_clustered_vectors_skip_blocks(spark):
    """Of the pairs of query and block few are scored where vectors lie in clusters, and the result is that of all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(50, 16)) * 2
    rows = [(i, (centres[i % 50] + rng.normal(size=16) * 0.05).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(4)
    visits = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 200 == 0, 10, visits=visits).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 4000, 200):
        score = x @ x[q]
        assert got[q] == sorted(((i, int(s)) for i, s in enumerate(score) if i != q), key=lambda p: (-p[1], p[0]))[:10]
    scored, every = (v.value for v in visits)
    assert 0 < scored < 0.5 * every, scored / every
