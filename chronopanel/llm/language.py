"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters other than letters becomes one blank, and its 1-, 2- and 3-grams are
hashed into ``2**HASH_BITS`` buckets. Fitting counts buckets per language on a sample of labelled rows: languages of at
most ``max_rows`` rows give all of them, larger ones a share chosen by a hash of id and text, ``max_rows`` rows to be
expected (a documented bound; every language keeps rows). Counts are summed in Spark; one matrix of log probabilities,
languages by buckets, is broadcast: its size depends on the number of languages alone. Scoring covers every row and the
whole text: batches are cut into pieces of bounded length, bucket numbers look up rows of the matrix, and sums per
document come out of one ``reduceat`` per language.

A text that is null or without letters gets ``und`` and score 0; so does every text if nothing could be learned. Ties
go to the first language by code point. The score is the posterior probability of the answer, which is near 1 for any
longer text; whether it is like that language at all, its likeness tells. Repeated rows get the same
answer each, an empty table gives an empty one, and rows with null label or text are never learned from. Input rows come
back in the struct ``doc``, so their names cannot clash with the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 16
BUCKETS = 1 << HASH_BITS
UND = "und"
#: Texts of fewer grams are too short to be found unlike a language.
LEAST_GRAMS = 64
_PIECE = 1 << 18
_GRAMS = (1, 2, 3)

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Code points of the normalised text, a blank before and after each word; empty without letters."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[raw]
    codes = np.where(letter, raw, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    if not letter.any():
        return codes[:0]
    return np.concatenate([[32], codes, [32]] if codes[-1] != 32 else [[32], codes]).astype(np.uint32)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, one array per n; position i starts gram i."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in _GRAMS:
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] * np.uint32(0x9E3779B1)) ^ (codes[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
        yield ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - HASH_BITS)).astype(np.int32)


def _pieces(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Pieces of bounded length and how many gram starts each owns; the codes after those only end its last grams."""
    for at in range(0, len(codes), _PIECE):
        yield codes[at : at + _PIECE + max(_GRAMS) - 1], min(_PIECE, len(codes) - at)


def _sample(df: DataFrame, label: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(
        label.cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")
    ).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("label").count().collect()  # one row per language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("label") == r["label"], F.lit(min(1.0, max_rows / r["count"]))).otherwise(share)
    place = F.pmod(F.xxhash64("id", F.length("text"), F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(place < share)


class Model:
    """Languages in code point order and their log probabilities, float32 [language, bucket]; priors are equal.

    ``typical`` is the mean log probability of the grams a language was learned from, ``unseen`` that of a gram it never
    had: between the two lies how much a text is like that language at all.
    """

    def __init__(self, languages: list[str], table: np.ndarray, typical: np.ndarray):
        self.languages, self.table, self.typical = languages, table, typical
        self.unseen = table.min(axis=1) if len(languages) else typical


def fit(
    df: DataFrame, label: Column, max_rows: int = 4000, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    def count(batches):
        for batch in batches:
            for label, texts in batch.groupby("label")["text"]:
                total = np.zeros(BUCKETS, dtype=np.int64)
                for text in texts:
                    for piece, owned in _pieces(_codes(text)):
                        for b in _buckets(piece):
                            total += np.bincount(b[:owned], minlength=BUCKETS)
                some = np.flatnonzero(total)
                yield pd.DataFrame({"label": label, "bucket": some.astype(np.int32), "n": total[some]})

    sample = _sample(df, label, max_rows, id_col, text_col)
    counts = sample.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # languages x buckets at most
    languages = sorted(set(found["label"]))
    table, seen = np.full((len(languages), BUCKETS), alpha), np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = found[found["label"] == lang]
        seen[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    table = table + seen
    if languages:
        table = np.log(table / table.sum(axis=1, keepdims=True))
    return Model(languages, table.astype(np.float32), (seen * table).sum(axis=1) / np.maximum(seen.sum(axis=1), 1))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior of each text, and how like that language its average gram is: 1 typical (or too few), 0 never seen."""
    n, langs = len(texts), len(model.languages)
    sums = np.zeros((n, langs))
    grams = np.zeros(n)
    has = np.zeros(n, dtype=bool)

    def flush(parts: list[tuple[np.ndarray, int]], owners: list[int]) -> None:
        if not parts or not langs:
            return
        codes = np.concatenate([p for p, _ in parts])
        lengths, owned = np.array([len(p) for p, _ in parts]), np.array([o for _, o in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for g, b in zip(_GRAMS, _buckets(codes), strict=False):
            counts = np.ones(len(b), dtype=bool)
            for e in range(1, max(_GRAMS) + 1):  # grams that leave their piece, or start in the next one's part
                out = (lengths >= e) & (lengths - e >= np.minimum(owned, lengths - g + 1)) & (ends - e < len(b))
                counts[ends[out] - e] = False
            live = starts < len(b)
            grams[np.asarray(owners)[live]] += np.add.reduceat(counts, starts[live], dtype=np.int64)
            for k in range(langs):
                values = np.where(counts, model.table[k][b], np.float32(0))
                sums[np.asarray(owners)[live], k] += np.add.reduceat(values, starts[live], dtype=np.float64)

    parts: list[tuple[np.ndarray, int]] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        codes = _codes(text) if text else np.zeros(0, np.uint32)
        has[i] = len(codes) > 0
        for piece in _pieces(codes):
            if i in owners[-1:] or held >= _PIECE:  # sums are added by index: one piece of a text at a time
                flush(parts, owners)
                parts, owners, held = [], [], 0
            parts.append(piece)
            owners.append(i)
            held += piece[1]
    flush(parts, owners)
    if not langs:
        return [UND] * n, np.zeros(n), np.zeros(n)
    best = sums.argmax(axis=1)
    top = sums.max(axis=1, keepdims=True)
    posterior = 1.0 / np.exp(sums - top).sum(axis=1)
    names = [model.languages[b] if h else UND for b, h in zip(best, has, strict=True)]
    mean = sums[np.arange(n), best] / np.maximum(grams, 1)
    likeness = (mean - model.unseen[best]) / np.maximum(model.typical - model.unseen, 1e-9)[best]
    return names, np.where(has, posterior, 0.0), np.where(has, np.where(grams < LEAST_GRAMS, 1.0, likeness), 0.0)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, likeness) for every row, from the whole text alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def answer(texts: pd.Series) -> pd.DataFrame:
        names, score, likeness = score_texts(shared.value, list(texts))
        return pd.DataFrame({"lang_pred": names, "score": score, "likeness": likeness})

    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # called non-deterministic lest a later filter on the answer evaluate it twice
    return df.select(doc.alias("doc"), answer.asNondeterministic()(F.col(text_col).cast("string")).alias("a")).select("doc", "a.lang_pred", "a.score", "a.likeness")
