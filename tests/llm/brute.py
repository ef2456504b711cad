"""Plain versions of the operators, by definition and for small inputs only."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(text):
    return re.sub("[^0-9]", "", text)


def pii_base(text):
    """(start, kind number, end) in order."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0])):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def secret_base(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def joined(found, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def line_dedup(texts, min_docs=10):
    """(n_lines, n_dropped, kept text) of each text."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    lines = [(t or "").split("\n") for t in texts]
    docs = Counter(k for own in lines for k in {key(x) for x in own} if k)
    out = []
    for own in lines:
        left = [x for x in own if not key(x) or docs[key(x)] < min_docs]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def fingerprint(text, n=3):
    words = re.findall(WORD, (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, bits=2):
    """Group number of each fingerprint, by comparing all with all."""
    parent = list(range(len(fingerprints)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= bits:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(fingerprints))]


def top_k(rows, k=10):
    """{query row: [(id, score)]} over rows (id, integers or None, asks)."""
    live = [(i, np.array(v, dtype=object)) for i, v, _ in rows if v is not None]
    asked = [(i, np.array(v, dtype=object)) for i, v, q in rows if v is not None and q]
    width = max((len(v) for _, v in live), default=0)
    pad = lambda v: np.concatenate([v, np.zeros(width - len(v), dtype=object)])
    out = defaultdict(list)
    for q, v in asked:
        scored = sorted(((-int(sum(pad(v) * pad(w))), i) for i, w in live if i != q))
        out[q].append([(i, -s) for s, i in scored[:k]])
    return out
