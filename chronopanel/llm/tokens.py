"""Token ids of whole texts, equal to those of the tokenizer's own ``encode``, with a store of words.

Most words of a corpus repeat, and the ids of a text are those of its words one after the other. So words are looked up,
and only new ones go through the tokenizer's model. That holds for texts of the plain characters below, for which the
tokenizer's normalisation is a mere lower-casing and its words are runs of letters, single digits and runs of other
signs; every other text goes to the tokenizer whole. The store has two generations: when the younger is full the older is
dropped, so frequent words stay and memory has a bound. It never changes a result.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

GENERATION_WORDS = 250_000

_BLANKS = " \t\n\r"
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CAPITALS = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_ASCII = "".join(chr(c) for c in range(33, 127) if chr(c).isalnum())
#: Bytes of plain texts in Latin-1.
_PLAIN = (_BLANKS + _SIGNS + _ASCII + _LETTERS + _CAPITALS).encode("latin-1")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[{re.escape(_SIGNS)}]+")


def _byte_characters() -> dict[int, str]:
    """The model's characters for bytes: printable ones stand for themselves, the others for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.characters = _byte_characters()

    def _word(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            self.young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if len(self.young) > GENERATION_WORDS:
            self.old, self.young = self.young, {}
        get = self.young.get
        parts = text.lower().split()
        ids = list(map(get, parts))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    part = parts[i]
                    bare = part.rstrip(_SIGNS)  # most others are a word with signs after it
                    word, signs = get(bare, b"" if not bare else None), get(part[len(bare) :])
                    if word is None or signs is None:
                        ids[i] = b"".join(map(self._word, _WORD.findall(part)))
                    else:
                        ids[i] = word + signs
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        try:
            raw = text.encode("latin-1")
            plain = not raw.translate(None, _PLAIN) and b"<|" not in raw
        except UnicodeEncodeError:
            plain = False
        if plain:
            return self._plain(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
