"""Hashes of all words of a text at once, by numpy, and bit tables of numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Bytes that are worked on together.
STRETCH = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0x165667B19E3779F9)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """One-to-one scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _SPREAD
        x = (x ^ (x >> np.uint64(29))) * _BASE
        return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, A-Z lower-cased: a polynomial over random numbers of their bytes, scrambled."""

    def __init__(self):
        self.letters = mix(np.arange(256, dtype=np.uint64) + np.uint64(SEED))
        self.letters[0x41:0x5B] = self.letters[0x61:0x7B]
        self.blank = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        """Powers of the base and of its inverse up to this length."""
        with np.errstate(over="ignore"):
            while len(self.powers) < size:
                step, back = self.powers[-1] * _BASE, self.inverses[-1] * _UNBASE
                self.powers = np.concatenate([self.powers, self.powers * step])
                self.inverses = np.concatenate([self.inverses, self.inverses * back])

    def _stretch(self, data: np.ndarray, blank: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.powers[: len(data)])])
            return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * _LENGTH)

    def of_bytes(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text, in order."""
        data = np.frombuffer(text, np.uint8)
        blank = self.blank[data]
        out, at, ahead = [], 0, STRETCH
        while at < len(data):  # a stretch ends at a blank, and grows where a word is longer
            end = min(at + ahead, len(data))
            if end < len(data):
                last = np.flatnonzero(blank[at:end])
                if not len(last):
                    ahead *= 2
                    continue
                end = at + int(last[-1]) + 1
            out.append(self._stretch(data[at:end], blank[at:end]))
            at, ahead = end, STRETCH
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_table(numbers: DataFrame, n: int) -> np.ndarray:
    """Which low bits the ``n`` numbers of a one-column table have: at least 2^16 flags, 16 for each, at most 2^26.

    Small enough for every task whatever the table; a full one only lets more through.
    """
    name = numbers.columns[0]
    bits = min(max(16, int(16 * n).bit_length()), 26)
    low = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    mask = F.expr(f"shiftleft(1L, CAST(({name} & {(1 << bits) - 1}L) % 64 AS INT))")
    rows = numbers.select(F.floor(low / 64).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        table[r["word"]] = r["mask"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)
