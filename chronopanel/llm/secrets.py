"""Secret scan: a character convolutional network over every candidate and its surroundings.

*Base findings* are fixed patterns: ``assign`` (a key word, a sign, a value of 8 or more characters), ``access`` and
``hex``. They always stay. *Candidates* come from looser generators: any word of 8 or more characters of the secret
alphabet, ordinary words and numbers too, and any value assigned to a word. Each is judged by a network in numpy: one-hot
characters of the candidate, in fixed places between the text before and after, one layer of convolutions, the largest response
inside and around the candidate, a logistic output. Every candidate is scored, whatever its place in the text. One of more
than 40 characters is seen through every window of 40, each with the text before and after it; its likeliest window counts.

*Training.* Positive are the base findings (their value parts), and, in the half that trains, those that mix letters and
digits once more without their key word. Negative are candidates that overlap no base finding, unless they may well be
secrets: those assigned to a word, those behind a word that announces secrets, and those that change between letters and
digits four times or more are unknown and taught as neither. A fixed set of made-up secrets and ordinary words (``prior``)
starts the network, so tables of any size are learned from. Then ever more rows are read, at last all of them, ``HARDENED``
times or until nothing new is met: every distinct base finding is taught, and of the sure negatives every one that the
network takes for a secret, or nearly; those it already tells apart need no teaching. The first few rows, chosen by hash, only spare
the later searches what is learned from a few; no row, finding or hard word is left out. The examples are dealt by hash into
shares of about ``SHARE``; every share trains the network in a task of its own, and the weights are averaged, some times.

Half of the examples, by hash, calibrate: a logistic curve fitted to held-out outputs gives probabilities, and per kind the
threshold is the highest that keeps a recall of ``recall`` on held-out findings and made-up secrets, whatever its height.
Outputs are counted by steps of ``1 / CELLS``, so that counts alone reach the driver. ``held_out`` counts what the last
network finds and takes of examples it has not seen. Long examples train by their first and last windows and one between,
and are calibrated by their likeliest. Kinds with few held-out findings share the pooled threshold. Only an empty table has
no network.

Added findings never overlap base findings or one another: the likelier comes first, ties go to the earlier. Null and
empty texts have none. Repeated rows are judged alike, empty tables give empty results, and input columns come back
inside the struct ``doc``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import copy
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept
from chronopanel.schema import spread

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole: shorter ones fail anyway
_VALUE = re.compile(r"[A-Za-z_]{2,20}[\"']?\x20*[:=]\x20*[\"']?([^\s\"']{8,})", re.ASCII)
#: What every match of ``_ASSIGN`` with a value long enough, and of ``_VALUE``, holds: most texts hold neither.
_SET = re.compile(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}")
_SIGNED = re.compile(r"[:=]\x20*[\"']?[^\s\"']{8}", re.ASCII)

#: What makes a candidate outside the base no sure negative.
_NAMES = "pass pwd secret token key auth bearer credential private signature login kennwort clave".split()
_ANNOUNCED = re.compile(f"(?i)(?=({'|'.join(_NAMES)}))")
_SWITCH = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")

BEFORE, INSIDE, AFTER = 20, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
GAP = 64  # classes between texts, as many as a window reaches beyond its text
WIDTH, FILTERS = 5, 16
STEPS = 2000  # of training, at least
FIRST_ROWS, WIDER = 512, 8  # rows expected that are searched for hard words first, and how many times more next
HARDENED = 3  # times that all rows are searched for them
LEAST_WORD = 8  # characters of a word that is a candidate
SHARE = 8192  # examples, about, that one task trains with
NEAR = 2.0  # below the threshold, as a logarithm of odds, from where on words are taught too
MERGES = 4  # times that the weights of several shares are averaged in a training
CELLS = 256  # steps that outputs are counted by, in one unit
GROUP = 400_000  # characters, about, that are searched at once
LEAST_FINDINGS = 20  # held-out findings that set a threshold of their own


def base_findings(text: str, hexes: bool = True) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, start of the value), ordered by start, then kind."""
    found = []
    if _SET.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((0, m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:
        found += [(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def _kind(value: str) -> int:
    if value.startswith("AKIA"):
        return 1
    return 2 if re.fullmatch(r"[0-9a-f]+", value) else 0


def _mixed(value: str) -> bool:
    return len(_SWITCH.findall(value)) >= 4


def _of_class(*characters: str) -> np.ndarray:
    """Which character classes stand for one of the characters."""
    flags = np.zeros(97, dtype=bool)
    flags[[ord(c) - 31 for part in characters for c in part]] = True
    return flags


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_IS_LETTER, _IS_DIGIT, _IS_HEX, _IS_SIGN = _of_class(_LOWER, _LOWER.upper()), _of_class(_DIGITS), _of_class(_DIGITS, "abcdef"), _of_class("=")
_IS_WORD = _IS_LETTER | _IS_DIGIT | _of_class("+/_=-")
#: Character classes: 0 outside the text, 1-95 printable, 96 other.
_CLASS = np.where((np.arange(129) >= 32) & (np.arange(129) < 127), np.arange(129) - 31, 96).astype(np.uint8)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of texts laid end to end with gaps of class 0 around them, and where each text begins."""
    gap = "\0" * GAP
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = GAP + np.cumsum(lengths + GAP) - lengths - GAP
    points = np.frombuffer((gap + "".join(t + gap for t in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = _CLASS[np.minimum(points, 128)]
    classes[:GAP] = 0
    for end in offsets + lengths:
        classes[end : end + GAP] = 0
    return classes, offsets


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least so many flags; the first and the last flag are unset."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])


def _announced(text: str) -> list[tuple[int, int]]:
    plain = text.lower()
    if not plain.isascii():  # letters that a pattern without case takes for others
        plain = plain.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")
    return [m.span(1) for m in _ANNOUNCED.finditer(text)] if any(name in plain for name in _NAMES) else []


class Met:
    """Base findings and candidates of some texts, searched together.

    Candidates are the words and assigned values that overlap no base finding; they may overlap one another. ``starts`` and
    ``ends`` are places in ``classes``, by start, then end; ``owner`` is the text of each. Not ``sure`` are those that may
    be secrets: assigned, announced by the text before or within, or mixed like a key.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        classes, offsets = self.classes, self.offsets = joined(texts)
        hexes = _IS_HEX[classes]
        owners = set((np.searchsorted(offsets, _runs(hexes, 32)[0], side="right") - 1).tolist())
        self.base = [base_findings(text, i in owners) for i, text in enumerate(texts)]
        values, names = [], []
        for at, text in zip(offsets.tolist(), texts):
            if _SIGNED.search(text):
                values += [(at + m.start(1), at + m.end(1)) for m in _VALUE.finditer(text)]
            names += [(at + s, at + e) for s, e in _announced(text)]
        starts, ends = _runs(_IS_WORD[classes], LEAST_WORD)
        value_starts, value_ends = np.array(values, dtype=np.int64).reshape(-1, 2).T
        if values:
            both = np.unique(np.concatenate([np.stack([starts, ends], axis=1), np.stack([value_starts, value_ends], axis=1)]), axis=0)
            starts, ends = both[:, 0], both[:, 1]
        taken = np.array([(at + s, at + e) for at, found in zip(offsets.tolist(), self.base) for _, s, e, _ in found], dtype=np.int64).reshape(-1, 2)
        if len(taken):
            before = np.searchsorted(taken[:, 0], ends)  # findings that start before the end of the span
            reach = np.concatenate([[0], np.maximum.accumulate(taken[:, 1])])
            free = reach[before] <= starts
            starts, ends = starts[free], ends[free]
        self.starts, self.ends = starts, ends
        self.owner = np.searchsorted(offsets, starts, side="right") - 1
        within = lambda sums, s, e: sums[e] - sums[s]
        self.kinds = np.where(within(_sums(hexes), starts, ends) == ends - starts, 2, 0)
        self.kinds[np.all([classes[starts + i] == ord(c) - 31 for i, c in enumerate("AKIA")], axis=0)] = 1
        letter, digit = _IS_LETTER[classes], _IS_DIGIT[classes]
        switch = np.zeros(len(classes), dtype=bool)
        switch[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
        unknown = within(_sums(switch), starts + 1, ends) >= 4
        sign = _IS_SIGN[classes]
        if sign.any():  # one before another character of the span
            last = np.maximum.accumulate(np.where(sign, 0, np.arange(len(classes))))[ends - 1]
            unknown |= within(_sums(sign), starts, np.maximum(last, starts)) > 0
        if values:
            unknown |= np.isin(starts, value_starts)
        if names:
            first, end = np.array(sorted(names), dtype=np.int64).T
            nearest = np.append(np.minimum.accumulate(end[::-1])[::-1], np.iinfo(np.int64).max)
            unknown |= nearest[np.searchsorted(first, starts - BEFORE)] <= ends
        self.sure = ~unknown


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in turn, so many at a time as have about ``GROUP`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1]) + GAP
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def prior(n: int = 500, seed: int = 5) -> list[tuple[int, int, str, int, int]]:
    """Made-up examples (label, kind number, text, start, end): ``n`` secrets and ``n`` ordinary words."""
    rng = random.Random(seed)
    word = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = lambda: "".join(rng.choice("the ing er on ein sch ten la que de tion al re st en us".split()) for _ in range(rng.randint(3, 9)))
    secret = [
        lambda: word(rng.choice([32, 40, 64]), digit + "abcdef"),
        lambda: "AKIA" + word(16, lower.upper() + digit),
        lambda: word(rng.randint(16, 40), lower + lower.upper() + digit),
        lambda: word(rng.randint(20, 40), lower + lower.upper() + digit + "+/") + "==",
        lambda: word(rng.randint(3, 6), lower + lower.upper() + digit) + word(2, digit) + word(rng.randint(3, 7), lower + lower.upper() + digit),
    ]
    harmless = [
        plain, plain, plain, lambda: plain() + plain(), lambda: word(rng.randint(8, 19), digit), lambda: plain().capitalize() + plain().capitalize(),
        lambda: "-".join(plain() for _ in range(3)) + f"-{rng.randint(1, 99)}", lambda: "/".join(plain() for _ in range(3)),
        lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: plain() + word(rng.randint(1, 3), digit),
        lambda: plain().upper(), lambda: plain().upper(), lambda: "_".join(plain() for _ in range(3)).upper(), lambda: plain().capitalize(),
    ]
    names = "password secret token api_key auth bearer credential access_key".split()
    out = []
    for i in range(n):
        for label, makers in ((1, secret), (0, harmless)):
            value = makers[i % len(makers)]()
            lead = " ".join(plain() for _ in range(2)) + rng.choice([" ", ". ", ", ", "\n"])
            if label and (len(value) < 16 or rng.random() < 0.5):
                lead += rng.choice(names) + rng.choice([": ", " = ", "=", ': "', " "])
            elif not label and rng.random() < 0.2:
                lead += rng.choice(["name", "title", "note", "see"]) + rng.choice([": ", " = "])
            out.append((label, _kind(value), lead + value + rng.choice(['"', " ", ". ", "\n", "!! ", ", "]) + plain(), len(lead), len(lead) + len(value)))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes: 0 outside the text, 1-95 printable, 96 other; a window has fixed places between its surroundings."""
    row = np.zeros(LENGTH, dtype=np.int16)
    inside, end = text[start : start + INSIDE], min(end, start + INSIDE)
    for at, part in (
        (BEFORE - min(BEFORE, start), text[max(0, start - BEFORE) : start]),
        (BEFORE, inside[: end - start]),
        (BEFORE + INSIDE, text[end : end + AFTER]),
    ):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row[at : at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes.astype(np.int64) - 31, 96)
    return row


def windows(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of spans, codes as by ``encode``) of all windows of spans, at most ``piece`` rows at a time."""
    counts = np.maximum(ends - starts - INSIDE, 0) + 1  # windows of each span
    last = np.cumsum(counts)
    upto, after = (np.lib.stride_tricks.sliding_window_view(classes, n) for n in (BEFORE + INSIDE, AFTER))
    for i in range(0, int(last[-1]) if len(last) else 0, piece):
        number = np.arange(i, min(i + piece, last[-1]))
        owner = np.searchsorted(last, number, side="right")
        first = starts[owner] + number - (last - counts)[owner]
        end = np.minimum(ends[owner], first + INSIDE)
        codes = np.empty((len(number), LENGTH), dtype=np.uint8)
        codes[:, : BEFORE + INSIDE] = upto[first - BEFORE]
        codes[:, BEFORE : BEFORE + INSIDE] *= np.arange(INSIDE) < (end - first)[:, None]
        codes[:, BEFORE + INSIDE :] = after[end]
        yield owner, codes


def encode_all(text: str, spans: list[tuple[int, int, int]], piece: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of spans, codes as by ``encode``) of all windows of all spans of a text, at most ``piece`` rows at a time."""
    classes, (at,) = joined([text])
    starts, ends = np.array([(s, e) for _, s, e in spans], dtype=np.int64).reshape(-1, 2).T + at
    return windows(classes, starts, ends, piece)


class Network:
    """Weights, calibration and thresholds; forward passes need nothing else."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.1, (WIDTH, 97, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.1, 2 * FILTERS)
        self.out_bias = 0.0
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = [0.5] * len(KINDS)

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        steps = LENGTH - WIDTH + 1
        h = np.broadcast_to(self.bias, (n, steps, FILTERS)).copy()
        for w in range(WIDTH):
            h += self.kernel[w][x[:, w : w + steps]]
        inner = slice(BEFORE - WIDTH // 2, BEFORE + INSIDE - WIDTH // 2)
        own, other = h[:, inner], h.copy()
        other[:, inner] = -np.inf
        a, b = own.argmax(axis=1) + inner.start, other.argmax(axis=1)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        return np.concatenate([h[rows, a, cols], h[rows, b, cols]], axis=1), a, b

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Outputs alone, in single precision: the same sums as ``_hidden``, without the places of the largest."""
        steps, first, last = LENGTH - WIDTH + 1, BEFORE - WIDTH // 2, BEFORE + INSIDE - WIDTH // 2
        kernel, out = self.kernel.astype(np.float32), self.out.astype(np.float32)
        # characters are looked up by twos
        pairs = {w: (kernel[w][:, None] + kernel[w + 1][None]).reshape(-1, FILTERS) for w in range(0, WIDTH - 1, 2)}
        z = np.zeros(len(x))
        for i in range(0, len(x), 256):
            codes = np.ascontiguousarray(x[i : i + 256].T).astype(np.intp)
            two = codes[:-1] * len(kernel[0]) + codes[1:]
            h = np.take(pairs[0], two[:steps], axis=0)
            for w in range(2, WIDTH, 2):
                h += np.take(pairs[w], two[w : w + steps], axis=0) if w in pairs else np.take(kernel[w], codes[w : w + steps], axis=0)
            around = np.maximum(h[:first].max(axis=0), h[last:].max(axis=0))
            largest = np.concatenate([h[first:last].max(axis=0), around], axis=1) + np.tile(self.bias, 2)
            z[i : i + 256] = (np.maximum(largest, 0) * out).sum(axis=1) + self.out_bias
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._curve(self.logits(x))

    def _curve(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z * self.scale + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                raw, a, b = self._hidden(x[i])
                act = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out_bias, -40, 40)))
                g = (p - y[i]) / len(i)
                back = (g[:, None] * self.out) * (raw > 0)
                self.out -= rate * 4 * (act.T @ g)
                self.out_bias -= rate * 4 * g.sum()
                grad = np.zeros_like(self.kernel)
                cols = np.broadcast_to(np.arange(FILTERS), (len(i), FILTERS))
                rows = np.arange(len(i))[:, None]
                for place, d in ((a, back[:, :FILTERS]), (b, back[:, FILTERS:])):
                    for w in range(WIDTH):
                        np.add.at(grad[w], (x[i][rows, place + w], cols), d)
                    self.bias -= rate * 4 * d.sum(axis=0)
                self.kernel -= rate * 4 * grad

    def calibrate(
        self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float, owner: np.ndarray | None = None, labelled: np.ndarray | None = None
    ) -> None:
        """``x`` holds the windows of the examples, ``owner`` the example of each; by default they are one each.

        The recall is one of all held-out secrets, made-up ones too, as findings of a corpus may all look alike; what is
        noted in ``held_out`` is of ``labelled`` examples only.
        """
        z = self.logits(x)
        if owner is not None:
            z = np.maximum.reduceat(z, np.flatnonzero(np.diff(owner, prepend=-1)))
        self.settle(z, y, kinds, np.ones(len(y), int), recall, labelled)

    def settle(self, z: np.ndarray, y: np.ndarray, kinds: np.ndarray, n: np.ndarray, recall: float, labelled: np.ndarray | None = None) -> None:
        """Curve, thresholds and ``held_out`` from outputs that ``n`` examples each have."""
        for _ in range(200):  # logistic curve by gradient steps on two numbers
            p = 1 / (1 + np.exp(-np.clip(z * self.scale + self.shift, -40, 40)))
            self.scale = max(self.scale - 0.05 * float(np.average((p - y) * z, weights=n)), 1e-3)
            self.shift -= 0.2 * float(np.average(p - y, weights=n))
        p = self._curve(z)

        def cut(own: np.ndarray) -> float:
            """The lower of the values around the quantile."""
            order = np.flatnonzero(own)[np.argsort(p[own], kind="stable")]
            upto = np.cumsum(n[order])
            return float(p[order[np.searchsorted(upto, math.floor((1 - recall) * (upto[-1] - 1)), side="right")]]) if len(order) else 0.5

        pooled = cut(y == 1)
        for k in range(len(KINDS)):
            own = (y == 1) & (kinds == k)
            self.thresholds[k] = cut(own) if n[own].sum() >= LEAST_FINDINGS else pooled
        known = np.ones(len(y), bool) if labelled is None else labelled
        passed = known & (p >= np.array(self.thresholds)[kinds])
        self.held_out = {
            "findings": int(n[known & (y == 1)].sum()), "found": int(n[passed & (y == 1)].sum()),
            "words": int(n[known & (y == 0)].sum()), "taken": int(n[passed & (y == 0)].sum()),
        }

    def untrained(self) -> Network:
        """A copy whose curve is not fitted yet."""
        other = copy.deepcopy(self)
        other.scale, other.shift = 1.0, 0.0
        return other

    def weights(self) -> np.ndarray:
        return np.concatenate([self.kernel.ravel(), self.bias, self.out, [self.out_bias]])

    def put(self, weights: np.ndarray) -> None:
        kernel, self.bias, self.out, last = np.split(weights, np.cumsum([self.kernel.size, self.bias.size, self.out.size]))
        self.kernel, self.out_bias = kernel.reshape(self.kernel.shape), float(last[0])


def largest(network: Network, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The output of the likeliest window of each span."""
    out = np.full(len(starts), -np.inf)
    for owner, codes in windows(classes, starts, ends):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.maximum(out[owner[first]], np.maximum.reduceat(network.logits(codes), first))
    return out


def _best(network: Network, texts: list[tuple[str, list[tuple[int, int, int]]]]) -> list[np.ndarray]:
    """Per text the probability of each of its candidates."""
    classes, offsets = joined([text for text, _ in texts])
    spans = np.array([(at + s, at + e) for at, (_, own) in zip(offsets, texts) for _, s, e in own], dtype=np.int64).reshape(-1, 2)
    p = network._curve(largest(network, classes, spans[:, 0], spans[:, 1]))
    return np.split(p, np.cumsum([len(own) for _, own in texts])[:-1])


def _example(label: int, kind: int, text: str, start: int, end: int) -> tuple[int, int, str, int, int]:
    """The same example with no more text than the network sees."""
    first = max(0, start - BEFORE)
    return label, kind, text[first : end + AFTER], start - first, end - first


def _bare_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """A secret once more without the text before it, if it is known by its own letters and digits."""
    return [(text[start:], 0, end - start)] if start and _mixed(text[start:end]) else []


def _few_windows(examples: list[tuple[int, int, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows of examples, of long ones three, and the numbers of their examples."""
    codes, owners = [], []
    for i, (_, _, text, s, e) in enumerate(examples):
        last = max(s, e - INSIDE)
        rows = [encode(text, at, e) for at in sorted({s, (s + last) // 2, last})]
        codes += rows
        owners += [i] * len(rows)
    return np.stack(codes), np.array(owners)


_EXAMPLE = ["label", "kind", "text", "start", "end"]
_EXAMPLE_TYPE = "label int, kind int, text string, start int, end int"


def fit(df: DataFrame, recall: float = 0.98, text_col: str = "text") -> Network | None:
    """The network learned from all rows; none from an empty table."""
    texts = df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    rows = texts.count()
    if not rows:
        return None
    made = prior()  # both labels alternate: halves by pairs
    train, held = ([e for i, e in enumerate(made) if i // 2 % 2 == half] for half in (0, 1))
    start = network = _taught(None, Network(), train, held, recall)
    place = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20))
    met, known, wanted, whole = None, 0, FIRST_ROWS, 0
    while whole < HARDENED:
        part = texts if wanted >= rows else texts.where(place < math.ceil(wanted / rows * (1 << 20)))
        new = _meet(part, network, findings=not whole, near=0.0 if network is start else NEAR)
        met = kept((new if met is None else met.unionByName(new)).distinct())
        n, whole = met.count(), whole + (wanted >= rows)
        if n > known:
            network = _taught(met, start, train, held, recall)
        elif whole:
            break
        known, wanted = n, wanted * WIDER
    return network


def _taught(met: DataFrame | None, start: Network, made: list, held: list, recall: float) -> Network:
    """The network trained and calibrated on examples, by halves, and on made-up ones."""
    network = start.untrained()
    if met is None:
        _train(network, made, 1, 0)
    else:
        ranked = met.withColumn("rank", F.xxhash64(*_EXAMPLE))
        own = ranked.where(F.pmod("rank", F.lit(2)) == 0)
        shares = max(1, math.ceil(own.count() / SHARE))
        dealt = spread(own.withColumn("share", F.pmod(F.shiftright("rank", 1), F.lit(shares))), "share")
        merges = MERGES if shares > 1 else 1
        for merge in range(merges):
            _average(dealt, network, made, merges, merge)
    z = [(label, k, False, *_cells(network, [(text, s, e)]), 1) for label, k, text, s, e in held]
    if met is not None:
        shared = ranked.sparkSession.sparkContext.broadcast(network)

        def outputs(batches):
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    part = batch.iloc[i : i + 1024]
                    yield part[["label", "kind"]].assign(cell=_cells(shared.value, list(zip(part["text"], part["start"], part["end"]))))

        scored = ranked.where(F.pmod("rank", F.lit(2)) == 1).drop("rank").mapInPandas(outputs, "label int, kind int, cell long")
        z += [(r["label"], r["kind"], True, r["cell"], r["count"]) for r in scored.groupBy("label", "kind", "cell").count().orderBy("label", "kind", "cell").collect()]
    label, kinds, labelled, cells, n = map(np.array, zip(*z))
    network.settle(cells / CELLS, label.astype(np.float64), kinds, n, recall, labelled)
    return network


def _cells(network: Network, examples: list[tuple[str, int, int]]) -> np.ndarray:
    """The outputs of examples, in whole steps."""
    classes, offsets = joined([text for text, _, _ in examples])
    spans = np.array([(s, e) for _, s, e in examples], dtype=np.int64) + offsets[:, None]
    return np.floor(largest(network, classes, spans[:, 0], spans[:, 1]) * CELLS).astype(np.int64)


def _train(network: Network, examples: list[tuple[int, int, str, int, int]], parts: int, part: int) -> None:
    """One part of a training of ``STEPS`` steps at least."""
    examples = examples + [(1, k, *bare) for label, k, text, s, e in examples if label for bare in _bare_of(text, s, e)]
    x, owner = _few_windows(examples)
    epochs = max(6, math.ceil(STEPS * 64 / len(x)))
    network.train(x, np.array([e[0] for e in examples], dtype=np.float64)[owner], epochs=math.ceil(epochs / parts), seed=11 + part)


def _average(dealt: DataFrame, network: Network, made: list, parts: int, part: int) -> None:
    """Every share trains a copy of the network, and all of them are averaged; sums of whole numbers know no order."""
    unit = float(1 << 32)
    shared = dealt.sparkSession.sparkContext.broadcast(network)

    def train(share: pd.DataFrame) -> pd.DataFrame:
        own = copy.deepcopy(shared.value)
        rows = share.sort_values(["rank", *_EXAMPLE])
        _train(own, made + list(rows[_EXAMPLE].itertuples(index=False, name=None)), parts, part)
        return pd.DataFrame({"weights": [np.round(own.weights() * unit).astype(np.int64)]})

    each = dealt.groupBy("share").applyInPandas(train, "weights array<long>").select(F.posexplode("weights").alias("i", "w"))
    sums = each.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).orderBy("i").collect()
    if sums:
        network.put(np.array([r["w"] / r["n"] for r in sums]) / unit)


def _meet(texts: DataFrame, network: Network, findings: bool, near: float) -> DataFrame:
    """Of all rows the sure negatives that the network takes for secrets, or nearly, and, if asked for, the base findings."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def meet(batches):
        odds = np.array(shared.value.thresholds) / (1 - np.minimum(shared.value.thresholds, 1 - 1e-9)) * math.exp(-near)
        least = odds / (1 + odds)
        for batch in batches:
            for group in grouped(batch["text"]):
                met, out = Met(group), []
                sure = np.flatnonzero(met.sure)
                p = shared.value._curve(largest(shared.value, met.classes, met.starts[sure], met.ends[sure]))
                for i in sure[p >= least[met.kinds[sure]]].tolist():
                    at = met.offsets[met.owner[i]]
                    out.append(_example(0, int(met.kinds[i]), group[met.owner[i]], int(met.starts[i] - at), int(met.ends[i] - at)))
                if findings:
                    out += [_example(1, k, text, v, e) for text, base in zip(group, met.base) for k, _, e, v in base]
                if out:
                    yield pd.DataFrame(out, columns=_EXAMPLE)

    return texts.mapInPandas(meet, _EXAMPLE_TYPE)


def added_findings(spans: list[tuple[int, int, int]], p: np.ndarray, network: Network) -> list[tuple[int, int, int, float]]:
    """Of candidates and their probabilities those the network takes for secrets, without overlaps, by start."""
    good = np.flatnonzero(p >= np.array(network.thresholds)[[k for k, _, _ in spans]]) if spans else []
    chosen: list[tuple[int, int, int, float]] = []
    taken, ends = [], []
    for i in sorted(good, key=lambda i: (-p[i], spans[i][1], spans[i][2])):
        k, s, e = spans[i]
        at = bisect_left(taken, s)
        if (at and ends[at - 1] > s) or (at < len(taken) and taken[at] < e):
            continue
        taken.insert(at, s)
        ends.insert(at, e)
        chosen.append((k, s, e, float(p[i])))
    return sorted(chosen, key=lambda c: (c[1], c[0]))


def _added(network: Network, met: Met) -> list[list[tuple[int, int, int, float]]]:
    """Per text what the network adds to its base findings."""
    p = network._curve(largest(network, met.classes, met.starts, met.ends))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in met.texts]
    scores: list[list[float]] = [[] for _ in met.texts]
    for i in np.flatnonzero(p >= np.array(network.thresholds)[met.kinds]).tolist():
        owner = int(met.owner[i])
        at = int(met.offsets[owner])
        spans[owner].append((int(met.kinds[i]), int(met.starts[i]) - at, int(met.ends[i]) - at))
        scores[owner].append(float(p[i]))
    return [added_findings(s, np.array(q), network) for s, q in zip(spans, scores)]


def scan(df: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """(doc, findings): per row an array of (kind, start, end, base, score), by start, then kind in the order of ``KINDS``."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    shape = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"

    @F.pandas_udf(shape)
    def find(texts: pd.Series) -> pd.Series:
        network, out = shared.value, []
        for group in grouped(texts):
            if network is None:
                added = [[] for _ in group]
                bases = [base_findings(text) for text in group]
            else:
                added, bases = _added(network, met := Met(group)), met.base
            for base, more in zip(bases, added):
                rows = [(s, k, e, True, 1.0) for k, s, e, _ in base] + [(s, k, e, False, q) for k, s, e, q in more]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": q} for s, k, e, b, q in sorted(rows)])
        return pd.Series(out)

    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(doc.alias("doc"), find(F.col(text_col).cast("string")).alias("findings"))
