"""Phrases whose words go together, counted on a weighted de Bruijn graph.

A text is lower-cased (A-Z), split into pieces at punctuation and line ends, and those into words at blanks. Per
language, the nodes are pairs of words and every run of three words is an edge from its first pair to its last, weighted
by its occurrences.

*Edges.* Each word of a piece starts one gram: three words, or at the end of the piece two or one. Tasks count those, and
one shuffle by first word adds them up.
*Flow.* What passes a node is the weight of the edges that leave it plus the pieces that end in it; what passes a word is
the flow of the pairs it starts plus the pieces that end in it. So the counts of pairs, words and of all words of a
language are sums over grams in the same partition; texts are not counted again.
*Compaction.* A node whose whole flow comes in by one edge and leaves by one is inside an unary path; such runs become
one row (words, weight), found by pointer doubling over these nodes. All that passes a path has its weight: the pairs
inside need no look-up and are always covered by a longer phrase; only the two ends of a path are looked up.
*Phrases* of 2 and 3 words that occur at least ``min_count`` times (a) are candidates. A cut into a first part of l and a
rest of r occurrences scores floor(1000000 * a * a / (l * r)); the lowest cut counts, the first of equals. Pairs that are
for ``covered`` per cent or more part of one candidate of three words are dropped.

Null text is empty, a null language ``und``. Repeated rows count again. Texts without words add nothing; a language
without candidates has no rows. Ties in rank go by count, then by UTF-8 bytes. An empty table gives an empty one. Other
columns are not read. Very long texts are read whole, piece by piece; a path is never longer than a piece.

Words travel as 64 bits of hash with their language and are spelled out again once only frequent phrases are left (of
10^9 distinct words some two share a number with odds of 3 %).

Scale: tasks count the grams of ``HELD_BYTES`` of text at a time and send each once. Words that make up more than one
part in ``HOT_PARTS`` of all (at most as many; found in a first pass by counts in the tasks, those rarer than a quarter of
that left out there) are spread by their second word, and where that is hot too by the third; only their few partial
sums meet again. The rest of the work is on phrases of at least ``min_count`` occurrences. Ranks are taken of parts of a
language first.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept
from chronopanel.llm.hashing import WordHashes, bit_table, mix

HELD_BYTES = 1 << 23
HOT_PARTS = 2048
SALTS = 64

_CUTS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


@dataclass
class Words:
    """The words of many texts: their bytes with one blank after each, where each begins and ends, its hash and piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(texts: list[bytes], hashes: WordHashes) -> Words:
        raw = np.frombuffer(b"\n".join(texts).translate(_CUTS) + b"\n", np.uint8)
        blank = (raw == 32) | (raw == 10)
        after = blank & ~np.concatenate([[True], blank[:-1]])  # the blank that ends a word
        keep = ~blank | after
        data = np.where(blank, np.uint8(32), raw)[keep]
        piece = np.cumsum(raw == 10, dtype=np.int32)[np.flatnonzero(after) - 1]
        end = np.flatnonzero(data == 32)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return Words(data, start, end, hashes.of_bytes(data.tobytes()), piece)

    def numbers(self, lang: str) -> np.ndarray:
        """Number of every word in its language."""
        return mix(self.hash ^ np.uint64(xxhash.xxh64_intdigest(lang)))

    def text(self, at: int) -> str:
        return self.data[self.start[at] : self.end[at]].tobytes().decode("utf-8", "surrogatepass")


def _by_language(batches, hashes: WordHashes):
    """(language, words) of the texts of a task, several megabytes at a time."""
    held: dict = defaultdict(list)
    size = 0

    def out():
        for lang, texts in held.items():
            words = Words.of(texts, hashes)
            if len(words.start):
                yield lang, words
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            held[lang].append(data)
            size += len(data)
            if size > HELD_BYTES:
                yield from out()
                size = 0
    yield from out()


def hot_words(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Numbers of words that make up more than one part in ``HOT_PARTS`` of all, and (lang, n), all words by language."""

    def count(batches):
        for lang, words in _by_language(batches, WordHashes()):
            found, times = np.unique(words.numbers(lang), return_counts=True)
            often = times * HOT_PARTS * 4 > len(words.hash)
            yield pd.DataFrame({"lang": lang, "word": found[often].view(np.int64), "n": times[often], "sum": False})
            yield pd.DataFrame({"lang": [lang], "word": [0], "n": [len(words.hash)], "sum": [True]})

    schema = "lang string, word long, n long, sum boolean"
    found = kept(docs.mapInPandas(count, schema).groupBy("lang", "word", "sum").agg(F.sum("n").alias("n")))
    totals = found.where("sum").select("lang", "n")
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = found.where(~F.col("sum") & (F.col("n") > every // HOT_PARTS)).select("word").collect()
    return np.sort(np.array([r["word"] for r in hot], np.int64).view(np.uint64)), totals


def grams(docs: DataFrame, hot) -> DataFrame:
    """(w1, salt, w2, w3, n): grams counted per task, words as numbers, 0 after the end of a piece.

    The salt is 0 where the first word is not hot; it follows the second word, and where that is hot too the third.
    """

    def count(batches):
        hashes = WordHashes()
        factors = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)
        for lang, words in _by_language(batches, hashes):
            one = words.numbers(lang)
            two, three = np.zeros_like(one), np.zeros_like(one)
            same = words.piece[:-1] == words.piece[1:]
            two[:-1] = np.where(same, one[1:], np.uint64(0))
            three[:-2] = np.where(same[:-1] & same[1:], one[2:], np.uint64(0))
            with np.errstate(over="ignore"):
                key = mix(one * factors[0] + two * factors[1] + three * factors[2])
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            alike = np.lexsort([two[at], one[at]])  # neighbours that look alike pack well
            at, times = at[alike], times[alike]
            one, two, three = one[at], two[at], three[at]
            first_hot, second_hot = np.isin(one, hot.value), np.isin(two, hot.value)
            salt = 1 + mix(np.where(second_hot, two ^ mix(three), two)) % np.uint64(SALTS)
            yield pd.DataFrame(
                {
                    "w1": one.view(np.int64),
                    "salt": np.where(first_hot, salt, np.uint64(0)).astype(np.int32),
                    "w2": two.view(np.int64),
                    "w3": three.view(np.int64),
                    "n": times,
                }
            )

    return docs.mapInPandas(count, "w1 long, salt int, w2 long, w3 long, n long")


def _spelled(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, lang, text) of the words in ``words`` (word)."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(words.select("word"), words.count()))

    def spell(batches):
        for lang, found in _by_language(batches, WordHashes()):
            numbers, at = np.unique(found.numbers(lang), return_index=True)
            wanted = table.value[(numbers & np.uint64(len(table.value) - 1)).astype(np.int64)]
            texts = [found.text(i) for i in at[wanted]]
            yield pd.DataFrame({"word": numbers[wanted].view(np.int64), "lang": lang, "text": texts})

    return docs.mapInPandas(spell, "word long, lang string, text string").dropDuplicates(["word"])


def flows(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, pairs, words, totals), from ``min_count`` occurrences on.

    ``edges`` (lang, w1, w2, w3, n), ``pairs`` (lang, w1, w2, n, out) with the heaviest edge that leaves, ``words``
    (lang, w, n), ``totals`` (lang, n).
    """
    hot, totals = hot_words(docs)
    found = grams(docs, docs.sparkSession.sparkContext.broadcast(hot)).repartition("w1", "salt")
    summed = found.groupBy("w1", "salt", "w2", "w3").agg(F.sum("n").alias("n"))
    edge = F.when((F.col("w3") != 0) & (F.col("n") >= min_count), F.col("n"))
    none, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    # what passes the gram, the pair and the word it begins with, in the partition of its first word
    level = lambda k, w2, w3, out: F.struct(F.lit(k).alias("k"), w2.alias("x2"), w3.alias("x3"), out.alias("out"))
    levels = F.array(level(3, F.col("w2"), F.col("w3"), edge), level(2, F.col("w2"), none, edge), level(1, none, none, nothing))
    passed = summed.select("w1", "salt", "n", F.inline(levels)).where("(k < 3 OR out IS NOT NULL) AND (k < 2 OR x2 <> 0)")
    passed = passed.groupBy("w1", "salt", "k", "x2", "x3").agg(F.sum("n").alias("n"), F.max("out").alias("out"))
    frequent = kept(passed.where((F.col("n") >= min_count) | (F.col("salt") > 0)))
    # the parts of a hot word's flows meet again
    whole = frequent.groupBy("k", "w1", F.col("x2").alias("w2"), F.col("x3").alias("w3")).agg(F.sum("n").alias("n"), F.max("out").alias("out"))
    whole = kept(whole.where(F.col("n") >= min_count))
    spelled = kept(_spelled(docs, whole.where("k = 1").select(F.col("w1").alias("word"))))
    named = lambda w: spelled.select(F.col("word").alias(w), F.col("text").alias(f"{w}_text"))
    words = whole.where("k = 1").join(spelled, F.col("w1") == F.col("word")).select("lang", F.col("text").alias("w"), "n")
    first = spelled.select(F.col("word").alias("w1"), "lang", F.col("text").alias("w1_text"))
    longer = whole.where("k > 1").join(first, "w1").join(named("w2"), "w2").join(named("w3"), "w3", "left")
    longer = kept(
        longer.select("k", "lang", F.col("w1_text").alias("w1"), F.col("w2_text").alias("w2"), F.col("w3_text").alias("w3"), "n", F.coalesce("out", none).alias("out"))
    )
    edges = longer.where("k = 3").select("lang", "w1", "w2", "w3", "n")
    return edges, longer.where("k = 2").select("lang", "w1", "w2", "n", "out"), kept(words), totals


def _node(*words: str) -> Column:
    return F.concat_ws("\t", F.concat_ws(" ", *words), "lang")


def nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, lang, w1, w2, n, out, into, inner): pairs with the heaviest edges that leave and reach them."""
    into = edges.groupBy(_node("w2", "w3").alias("node")).agg(F.max("n").alias("into"))
    met = pairs.withColumn("node", _node("w1", "w2")).join(into, "node", "left").fillna(0, ["into"])
    return kept(met.withColumn("inner", (F.col("out") == F.col("n")) & (F.col("into") == F.col("n"))))


def paths(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(lang, words, n): the edges, runs of them through inner nodes as one row."""
    ends = edges.withColumn("head", _node("w1", "w2")).withColumn("tail", _node("w2", "w3"))
    inner = nodes_.where("inner").select("node")
    steps = ends.join(inner.withColumnRenamed("node", "head"), "head", "left_semi").select(F.col("head").alias("at"), F.col("tail").alias("to"))
    # every inner node leaves by one edge; doubling finds the last inner node of its path and how far it is
    last = inner.select(F.col("node").alias("stop"))
    reach = kept(
        steps.join(last, F.col("to") == F.col("stop"), "left").select(
            "at", F.coalesce("stop", "at").alias("to"), F.col("stop").isNotNull().cast("long").alias("hops")
        )
    )
    while True:
        ahead = reach.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"))
        doubled = kept(
            reach.join(ahead, "to").select(
                "at", F.col("further").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("more") > 0).alias("moved")
            )
        )
        reach = doubled.select("at", "to", "hops")
        if doubled.where("moved").isEmpty():
            break
    by_head = reach.select(F.col("at").alias("head"), F.col("to").alias("end"), F.col("hops").alias("left"))
    by_tail = reach.select(F.col("at").alias("tail"), F.col("to").alias("tail_end"), (F.col("hops") + 1).alias("tail_left"))
    placed = ends.join(by_head, "head", "left").join(by_tail, "tail", "left")
    alone = F.concat_ws("\t", "w1", "head", "tail")
    placed = placed.select(
        "lang", "n", "w1", "w2", "w3",
        F.coalesce("end", "tail_end", alone).alias("path"),
        F.coalesce("left", "tail_left", F.lit(0)).alias("left"),
        F.when(F.col("end").isNotNull() | F.col("tail_end").isNotNull(), 1).otherwise(0).alias("joined"),
    )
    single = placed.where("joined = 0").select("lang", F.array("w1", "w2", "w3").alias("words"), "n")
    runs = placed.where("joined = 1").groupBy("lang", "path", "n").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("place"), "w1", "w2", "w3"))).alias("run")
    )
    words = F.concat(F.array(F.col("run")[0]["w1"], F.col("run")[0]["w2"]), F.transform("run", lambda e: e["w3"]))
    return kept(single.unionByName(runs.select("lang", words.alias("words"), "n")))


def _score(a: str, left: str, right: str) -> Column:
    wide = "CAST({} AS DECIMAL(15, 0))".format
    return F.expr(f"({wide(a)} * {wide(a)} * 1000000) div ({wide(left)} * {wide(right)})")


def collocations(
    df: DataFrame, min_count: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    docs = df.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    edges, pairs, words, totals = flows(docs, min_count)
    known = nodes(edges, pairs)
    runs = paths(edges, known)

    flow = known.select("node", F.col("n").alias("flow"))
    size = F.size("words")
    at = lambda i: F.element_at("words", i)
    ended = (
        runs.select("*", _node_of(at(1), at(2)).alias("head"), _node_of(at(size - 1), at(size)).alias("tail"))
        .join(flow.select(F.col("node").alias("head"), F.col("flow").alias("head_flow")), "head")
        .join(flow.select(F.col("node").alias("tail"), F.col("flow").alias("tail_flow")), "tail")
    )
    triples = ended.select("lang", "n", "head_flow", "tail_flow", size.alias("size"), "words", F.explode(F.sequence(F.lit(1), size - 2)).alias("i"))
    triples = triples.select(
        "lang", at(F.col("i")).alias("w1"), at(F.col("i") + 1).alias("w2"), at(F.col("i") + 2).alias("w3"), F.col("n").alias("a"),
        F.when(F.col("i") == 1, F.col("head_flow")).otherwise(F.col("n")).alias("first_two"),
        F.when(F.col("i") == F.col("size") - 2, F.col("tail_flow")).otherwise(F.col("n")).alias("last_two"),
    )
    twos = known.where(~F.col("inner") & (100 * F.greatest("out", "into") < covered * F.col("n"))).select(
        "lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), F.col("n").alias("a"),
        F.lit(None).cast("long").alias("first_two"), F.lit(None).cast("long").alias("last_two"),
    )
    both = triples.unionByName(twos).withColumn("end", F.coalesce("w3", "w2"))
    both = both.join(words.select("lang", F.col("w").alias("w1"), F.col("n").alias("f1")), ["lang", "w1"])
    both = both.join(words.select("lang", F.col("w").alias("end"), F.col("n").alias("f_end")), ["lang", "end"])
    scored = both.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "f1", "f_end", "first_two", "last_two",
        _score("a", "f1", "coalesce(last_two, f_end)").alias("s1"), _score("a", "first_two", "f_end").alias("s2"),
    )
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    cut = scored.select(
        "lang", "phrase", "a",
        F.when(later, F.col("first_two")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f_end")).otherwise(F.coalesce("last_two", "f_end")).alias("r"),
        F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the best of each part of a language first, so that no task ranks all of its phrases
    parted = cut.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = parted.withColumn("rank", F.row_number().over(order("lang", "part"))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(order("lang"))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _node_of(one: Column, two: Column) -> Column:
    return F.concat_ws("\t", F.concat_ws(" ", one, two), "lang")
