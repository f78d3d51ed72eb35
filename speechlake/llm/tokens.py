"""Encoding by public tokenizers inside tasks, each distinct stretch of text once.

A text is cut into stretches at places that no token crosses, for reasons that hold for every text:

* byte-level BPE (``tokenizers``, GPT-2 pattern): the pattern's tokens contain white space only at their
  start or are white space alone. A cut before a white-space run that follows other characters is always
  a token boundary, and what follows it does not depend on what came before.
* word BPE: white space is dropped by the pattern, so every white-space character is a boundary;
  normalisation (NFC, lower case) does not reach across it.
* sentencepiece BPE: no vocabulary entry has a word mark after another character (checked when the
  model loads), so merges never cross a place before a run of spaces.

Each stretch that is new to a worker goes through the library; its ids are kept in a bounded table.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np

#: Unicode White_Space (Python's \\s has four control characters more).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BYTE_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_BEGINS_WHITE = re.compile(f"[{_WS}]|\\Z").match
#: In these the pattern's letters, digits and spaces are the same for every Unicode version, and NFC changes nothing.
_PLAIN = re.compile("[\\n -~\u00a1-\u00ff]*")
_BYTE_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PARTS = r"'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks that are a stretch of their own after a word, whatever follows; an apostrophe may begin one.
_MARKS = frozenset(".,;:!?")
#: Stretches kept by a worker.
KEPT = 1_200_000


@contextmanager
def no_collection():
    """No cyclic garbage arises in here; without this, each collection walks the large tables."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Recent(dict):
    """A dict of at most about ``most`` entries: when half is full, it becomes the older half, whose
    entries return if asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are in neither half; the others are in the newer half now."""
        out, older = [], self.older
        for k in keys:
            if k not in self:
                if k in older:
                    self[k] = older[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()


class Learned(Recent):
    """A Recent that makes the values it is asked for and doesn't have."""

    def __init__(self, most: int, make: Callable):
        super().__init__(most)
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.older[key] if key in self.older else self.make(key)
        return value


class Encoder:
    """ids_of(texts): for each text its ids as little-endian uint32 bytes, without special tokens added."""

    def __init__(self, file: str, kind: str, kept: int = KEPT):
        import regex
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(kind)
        self.tokenizer, self.kind = Tokenizer.from_file(file), kind
        # Stretches after a space (byte) or between spaces (word); whole stretches; what the pattern makes of them.
        after = " " if kind == "byte" else ""
        self.known, self.lone, self.parts = Learned(kept, lambda k: self.learn(k, after)), Learned(kept // 4, self.learn), Learned(kept // 2, self.merged)
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(_BYTE_PARTS if kind == "byte" else _WORD_PARTS).findall
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def pieces(self, unit: str) -> list[str] | None:
        """The unit as the library's pattern cuts it; None where that isn't beyond doubt."""
        if not _PLAIN.fullmatch(unit) or "<|" in unit and any(s in unit for s in self.special):
            return None
        if self.kind == "word":
            unit = unit.lower()
        return [unit] if (unit[1:] if unit[:1] == " " else unit).isalpha() else self.split(unit)

    def whole(self, unit: str) -> bytes:
        """Through the whole library: normaliser, special tokens, pattern and merges."""
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        """Through the library's model alone: the piece is one stretch of its pattern already."""
        letters = self.letters
        shown = piece.replace(" ", letters[32]).replace("\n", letters[10]) if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def learn(self, key: str, before: str = "") -> bytes | None:
        """The ids of before + key."""
        # One stretch of the pattern: most words, and nothing to look up again.
        if key.isascii() and key.isalpha():
            return array("I", [t.id for t in self.tokenize((before and self.letters[32]) + (key.lower() if self.kind == "word" else key))]).tobytes()
        if _PLAIN.fullmatch(key):
            # A word and one mark: two stretches. Lines of other characters than white space, apart.
            own = self.known if before or self.kind == "word" else self.lone
            if key[-1:] in _MARKS and key[:-1].isalpha():
                return own[key[:-1]] + self.parts[key[-1]]
            head, cut, tail = key.partition("\n")
            if head and tail and " " not in key and tail[0] != "\n":
                return own[head] + (self.parts[cut] + self.lone[tail] if self.kind == "byte" else own[tail])
        if before and _BEGINS_WHITE(key):
            return None  # a space before white space or the end is no sure place to cut
        ps = self.pieces(before + key)
        return self.whole(before + key) if ps is None else b"".join([self.parts[p] for p in ps])

    def ids_of(self, texts: list[str]) -> list[bytes]:
        with no_collection():
            return self._ids_of(texts)

    def _ids_of(self, texts: list[str]) -> list[bytes]:
        for t in (self.known, self.lone, self.parts):
            t.turn()
        units = [t.split(" ") for t in texts]
        get = self.known.__getitem__
        if self.kind == "word":
            return [b"".join(map(get, us)) for us in units]
        heads, out, slow = [us.pop(0) for us in units], [], {}
        for i, us in enumerate(units):
            try:
                out.append(b"".join(map(get, us)))
            except TypeError:
                out.append(b"")
                slow[i] = _BYTE_UNIT.findall(texts[i])
        lone = self.lone.__getitem__
        return [b"".join(map(lone, slow[i])) if i in slow else lone(h) + x for i, (h, x) in enumerate(zip(heads, out, strict=True))]


_ENCODERS: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """One object for each worker process."""
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def encoder(file: str, kind: str) -> Encoder:
    return once((file, kind), lambda: Encoder(file, kind))


def slices(lengths: list[int], most: int = 4 << 20):
    """(from, to) of consecutive runs whose lengths sum to about ``most``: texts are handled run by run."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
