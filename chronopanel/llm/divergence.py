"""Which sources of a language differ, and by which terms: one-hot level products price every joint table.

A term is a maximal run of letters A-Z and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that
occur in at least ``min_docs`` of its rows (V of them). A group is a (lang, source); with n occurrences of a kept term
and N of all kept terms its smoothed share is p = 1 + floor(10^9 * (n + 1) / (N + V)), the language's likewise. What p
differs from q by weighs f = floor((p - q)^2 / q).

*Joint tables.* f depends on nothing but the two groups and the two counts, so the divergence of two groups is the sum
of f over their joint table of counts: how many terms occur a times in one and b times in the other. Take an indicator
column for every (group, count level) over all kept terms, X; then X'X holds the joint tables of all pairs of groups.
Terms are cut into blocks of about ``TERMS`` by hash and groups into blocks of about ``GROUPS``, and each (block of terms,
pair of blocks of groups) is one task's product: a dense one in single precision for levels below ``LOW``, exact as a
block has far fewer than 2^24 terms, and a sparse one (counts of level codes) for the few terms above. Terms that a pair
of blocks does not hold are level zero on both sides and priced together. Prices are 64-bit integers; a sum over all
terms stays below 10^18 times two or three, as the shares of a group add up to about 10^9.

Null text, lang and source are read as ''. Repeated rows are documents of their own. A group without terms, and one in
a language without kept terms (all values 0 there), is still compared with every other. Ties are ranked by the item's
UTF-8 bytes. An empty table gives an empty one. Other columns are not read, so none can clash. Very long texts are
counted whole, one after the other.

Scale: tasks count terms before anything is shuffled, in dictionaries that are emptied at ``HELD`` entries, so that a
hot term or source is a row per task. What a term holds is one (source, count) per source; the result has a row per
pair of sources, so sources are expected to be thousands, not millions. Nothing is collected; top ranks are limited
before their shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept

TERMS = 8192
GROUPS = 32
LOW = 8
HELD = 200_000
SCALE = 1_000_000_000

_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows, counted per task and not yet added up."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches):
        n: dict = defaultdict(Counter)
        rows: dict = defaultdict(Counter)

        def out():
            for (lang, source), found in n.items():
                words = list(found)
                size, own = len(words), rows[lang, source]
                yield pa.record_batch(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array([source] * size, pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array(found.values(), pa.int64()),
                        pa.array([own[w] for w in words], pa.int64()),
                    ],
                    schema=schema,
                )
            n.clear()
            rows.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                words = terms(text)
                if not words:
                    continue
                own, before = n[lang, source], len(n[lang, source])
                own.update(words)
                rows[lang, source].update(set(words))
                held += len(own) - before
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str, vocabulary: str) -> Column:
    """p of a count, by long division in steps of a thousand, so that no product passes 64 bits."""
    over = f"({total} + {vocabulary})"
    rest, done = f"({n} + 1)", "0L"
    for _ in range(3):
        done, rest = f"({done} * 1000 + ({rest} * 1000) div {over})", f"(({rest} * 1000) % {over})"
    return F.expr(f"1 + {done}")


def _weight(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shares(n: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """``_share`` of arrays."""
    over = total + vocabulary
    rest, done = n + 1, np.zeros(np.broadcast(n, over).shape, np.int64)
    for _ in range(3):
        done, rest = done * 1000 + rest * 1000 // over, rest * 1000 % over
    return 1 + done


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def price_block(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, vocabulary: int) -> tuple:
    """Sums of f over the terms of a block, for every pair of its groups: (left from right, right from left).

    ``left`` and ``right`` are counts (terms x groups); the joint tables come from products of their indicators.
    """
    width = max(1, min(LOW, 1 + int(max(left.max(initial=0), right.max(initial=0)))))
    level = np.arange(width)
    one_hot = lambda c: (c[:, :, None] == level).reshape(len(c), c.shape[1] * width).astype(np.float32)
    tables = (one_hot(left).T @ one_hot(right)).astype(np.int64)
    tables = tables.reshape(left.shape[1], width, right.shape[1], width)
    p = shares(level[None, :], n_left[:, None], vocabulary)[:, :, None, None]
    q = shares(level[None, :], n_right[:, None], vocabulary)[None, None, :, :]
    there, back = (tables * _price(p, q)).sum(axis=(1, 3)), (tables * _price(q, p)).sum(axis=(1, 3))
    high_left, high_right = left >= width, right >= width
    some_left, some_right = high_left.any(axis=1), high_right.any(axis=1)
    for g in range(left.shape[1]):
        rows = np.flatnonzero(high_left[:, g] | some_right) if some_left.any() or some_right.any() else []
        for h in range(right.shape[1]) if len(rows) else ():
            own = rows[high_left[rows, g] | high_right[rows, h]]
            if not len(own):
                continue
            codes, times = np.unique(left[own, g] * (1 + right[own, h].max()) + right[own, h], return_counts=True)
            a, b = np.divmod(codes, 1 + right[own, h].max())
            p, q = shares(a, n_left[g : g + 1], vocabulary), shares(b, n_right[h : h + 1], vocabulary)
            there[g, h] += (times * _price(p, q)).sum()
            back[g, h] += (times * _price(q, p)).sum()
    return there, back


def _price_tiles(tiles: DataFrame) -> DataFrame:
    """(lang, g, h, value, terms): what each tile adds to the divergence of group g from group h."""

    def price(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        named = rows[rows["filler"]]
        totals = named.drop_duplicates("g").set_index("g")["total"]
        side = named.drop_duplicates("g").set_index("g")["part"]
        found = rows[~rows["filler"]]
        term, _ = pd.factorize(found["term"])
        height = int(term.max()) + 1 if len(term) else 0
        counts = {}
        for part in {i, j}:
            groups = pd.Index(side.index[side == part])
            at = groups.get_indexer(found["g"])
            table = np.zeros((height, len(groups)), np.int64)
            table[term[at >= 0], at[at >= 0]] = found["n"].to_numpy(np.int64)[at >= 0]
            counts[part] = groups, table, totals[groups].to_numpy(np.int64)
        (gs, left, n_left), (hs, right, n_right) = counts[i], counts[j]
        there, back = price_block(left, right, n_left, n_right, int(rows["v"].iloc[0]))
        g, h = np.repeat(gs.to_numpy(), len(hs)), np.tile(hs.to_numpy(), len(gs))
        out = [(g, h, there.reshape(-1))] + ([(h, g, back.reshape(-1))] if i != j else [])
        g, h, value = (np.concatenate(x) for x in zip(*out, strict=True))
        done = pd.DataFrame({"lang": lang, "g": g, "h": h, "value": value, "terms": height})
        return done[done["g"] != done["h"]]

    schema = "lang string, g long, h long, value long, terms long"
    return tiles.groupBy("lang", "block", "i", "j").applyInPandas(price, schema)


def audit(
    df: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms a source overuses."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(read(text_col).alias("text"), read(lang_col).alias("lang"), read(source_col).alias("source"))
    vocabulary = kept(
        _term_counts(docs)
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    cells = vocabulary.select("lang", "term", "all", F.inline("by_source"))
    groups = docs.select("lang", "source").distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes, ["lang", "source"], "left").fillna(0, ["total"])
    words = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).alias("parts")).join(words, "lang", "left")
    langs = langs.fillna(0, ["v", "lang_total"]).withColumn("blocks", F.ceil(F.col("v") / TERMS))
    part = F.pmod(F.xxhash64(F.lit("part"), "source"), F.col("parts")).alias("part")
    groups = kept(groups.join(langs, "lang").select("*", F.xxhash64("source").alias("g"), part))

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    fillers = groups.where("blocks > 0").select(
        "lang", block.alias("block"), "part", "parts", "g", "v", "total",
        F.lit(0).cast("long").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("filler"),
    )
    named = groups.select("lang", "source", "part", "parts", "blocks", "g", "v", "total")
    filled = cells.join(named, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64(F.lit("block"), "term"), "blocks").alias("block"), "part", "parts", "g", "v", "total",
        F.xxhash64("term").alias("term"), "n", F.lit(False).alias("filler"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    tiles = filled.unionByName(fillers).select("*", other)
    tiles = tiles.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    priced = _price_tiles(tiles.drop("other", "parts")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))

    one = groups.select("lang", "source", "g", "v", "total")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("total").alias("item_total"))
    pairs = one.join(two, "lang").where("g <> h").join(priced, ["lang", "g", "h"], "left").where("v > 0")
    pairs = pairs.withColumn("p", _share("0L", "total", "v")).withColumn("q", _share("0L", "item_total", "v"))
    rest = (F.col("v") - F.coalesce("terms", F.lit(0))) * _weight("p", "q")
    pairs = pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))
    bare = one.where("v = 0").join(two, "lang").where("g <> h").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shaped = lambda rows, name: rows.select(
        "lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )

    overused = (
        cells.join(groups.select("lang", "source", "v", "total", "lang_total"), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), _share("n", "total", "v").alias("p"), _share("`all`", "lang_total", "v").alias("q"))
        .where("p > q")
        .select("lang", "source", "item", _weight("p", "q").alias("value"))
    )
    return shaped(pairs.unionByName(bare), "pair").unionByName(shaped(overused, "term").where(F.col("rank") <= top))
