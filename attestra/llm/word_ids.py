"""Token ids by a word-level BPE file of the tokenizers library, remembering the pieces between white space."""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Pieces whose ids a task remembers, and how long they are at most: bounds on its memory.
REMEMBERED, SHORT = 300_000, 64
#: Letters that need no normalisation beyond lower-casing, and marks that the vocabulary cuts from a word before them.
LETTERS, MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+"), ".,!?;:*$%#&()\"-"


class WordEncoder:
    """Gives the ids of a text as little-endian unsigned 32-bit integers, equal to the library's without added special tokens."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        specials = [re.escape(x["content"]) for x in json.loads(spec)["added_tokens"]]
        self.special = re.compile("|".join(specials)) if specials else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.symbols = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of lower-case letters, or of marks, which are one word to the model."""
        ids = self.cores.get(word)
        if ids is None:
            if len(self.cores) >= REMEMBERED:
                self.cores.clear()
            symbols = word if word.isascii() else "".join(map(self.symbols.__getitem__, word.encode()))
            ids = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
            if len(word) <= SHORT:
                self.cores[word] = ids
        return ids

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "surrogatepass")
        core = text.rstrip(MARKS)
        if LETTERS.fullmatch(core) and LETTERS.fullmatch(low := core.lower()):
            return self.word(low) + (self.word(text[len(core) :]) if len(core) < len(text) else b"")
        return self.whole(text)

    def encode(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return self.whole(text)
        pieces = text.encode("utf-8", "surrogatepass").split()
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = self.piece(p)
        out = b"".join(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return out


_encoders: dict[int, WordEncoder] = {}


def encoder_for(spec: str) -> WordEncoder:
    """One encoder for each vocabulary, kept from task to task in the same worker."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]
