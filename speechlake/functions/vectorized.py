"""Pandas helpers for what Spark has no built-in for: n-gram repetition, word distance, NFKC, chunking, mixed tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as K


def repeats(text: str | None, length: int, tolerance: int) -> bool:
    """Whether an overlapping n-gram of characters occurs more than ``tolerance`` times."""
    if not text or len(text) - length + 1 <= max(tolerance, 0):
        return False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = max(4096, 2 * length)
    # Growing prefixes: a repetitive text is known by its beginning.
    while True:
        part = points[:size]
        code = part[: len(part) - length + 1]
        for k in range(1, length):
            # Three code points fill 63 bits; before a fourth, codes become numbers of distinct ones.
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64) if k >= 3 else code
            code = code << np.uint64(21) | part[k : k + len(code)]
        if np.unique(code, return_counts=True)[1].max() > tolerance:
            return True
        if size >= len(points):
            return False
        size *= 4


def repetition(length: int = 2, tolerance: int = 10):
    @F.pandas_udf(K.BooleanType())
    def found(x: pd.Series) -> pd.Series:
        return x.map(lambda t: repeats(t, length, tolerance)).astype(bool)

    return found


@F.pandas_udf(K.StringType())
def portable_key(x: pd.Series) -> pd.Series:
    """NFKC and case folding: equal for file names that some file systems do not tell apart."""
    return x.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


#: Fixed value: a sentence ends after ASCII punctuation before white space (which goes), or after a full-width mark.
SENTENCE_END = re.compile(r"[;:,.!?](\s+)|[；：，。！？]")


def sentences(text: str) -> list[str]:
    """The text's sentences, each with its end mark; none is empty."""
    cuts = [(m.end() - len(m[1] or ""), m.end()) for m in SENTENCE_END.finditer(text)]
    starts, stops = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
    return [text[a:b] for a, b in zip(starts, stops, strict=True) if a < b]


def chunks(text: str | None, most: int) -> list[str]:
    """Runs of sentences of at most ``most`` UTF-8 bytes (a longer sentence alone), as long as they can be from the
    left. A sentence with an ASCII end takes a space behind it; that of a chunk's last sentence doesn't count.

    With the running sums of sizes, each chunk's end is one search."""
    parts = sentences(text or "")
    size = np.array([len(s.encode()) for s in parts], dtype=np.int64)
    gap = np.array([s[-1].isascii() for s in parts], dtype=np.int64)
    before = np.cumsum(size + gap) - size - gap
    out, at = [], 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(before + size, before[at] + most, side="right")))
        out.append("".join(s + " " * g for s, g in zip(parts[at:stop], gap[at:stop].tolist(), strict=True)).strip())
        at = stop
    return out


def chunked(most: int):
    @F.pandas_udf(K.ArrayType(K.StringType()))
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: chunks(t, most))

    return of


#: After these no space is put before an ASCII word of two letters or more.
NO_SPACE_AFTER = frozenset(" :'\"")
_MIXED = re.compile(r"(?P<word>[A-Za-z0-9']+)|(?P<han>[\u3100-\u9fff])|(?P<other>.)", re.DOTALL)


def mixed_tokens(text: str | None, syllables: dict[str, str]) -> list[str]:
    """Words as their characters, Han characters as their syllable (from a table; else the character) with a
    space before it, others as they are. A word of two letters or more gets a space before it, too, unless it
    comes first or after one of ``NO_SPACE_AFTER``."""
    out: list[str] = []
    for m in _MIXED.finditer(text or ""):
        if m["han"]:
            out += (" ", syllables.get(m["han"], m["han"]))
        else:
            apart = len(m[0]) > 1 and bool(out) and not NO_SPACE_AFTER.issuperset(out[-1:])
            out += " " * apart + m[0]
    return out


def mixed_tokenizer(syllables: dict[str, str]):
    @F.pandas_udf(K.ArrayType(K.StringType()))
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: mixed_tokens(t, syllables))

    return of


@F.pandas_udf(K.ArrayType(K.IntegerType()))
def byte_tokens(x: pd.Series) -> pd.Series:
    return x.map(lambda t: list((t or "").encode()))


# Fixed values of version 1 of the Japanese normalisation: character -> replacement, by kind.
JA_WAVES = {"〜": "ー", "～": "ー", "〰": "ー", "~": "ー"}
JA_QUOTES = dict.fromkeys("\"'`「」『』“”‘’", "")
JA_PUNCTUATION = {",": "、", "，": "、", "､": "、", ".": "。", "｡": "。", "!": "！", "?": "？", ":": "：", ";": "；", "(": "（", ")": "）"}

_JA = {c: (to, kind) for kind, table in (("wave", JA_WAVES), ("quote", JA_QUOTES), ("punct", JA_PUNCTUATION)) for c, to in table.items()}
_JA_FOUND = re.compile(f"[{re.escape(''.join(_JA))}]|\\s+")


def _ja_edits(m: re.Match) -> list[tuple[int, str, str, str]]:
    """(place, character, replacement, kind) of a character of the tables or a run of white space."""
    if m[0] in _JA:
        return [(m.start(), m[0], *_JA[m[0]])]
    # Of a run every second character goes; those that stay are plain spaces.
    return [(m.start() + k, c, "" if k % 2 else " ", "whitespace") for k, c in enumerate(m[0])]


def normal_ja(text: str) -> tuple[str | None, list[tuple[str, int, str, str, str]]]:
    """(normalised text, [(stage, position, source, target, kind), ...]); no text if it has U+FFFD: then the events
    say where. Stages: normalize (NFKC), map (tables and white space), trim (either end); positions are those in the
    stage's own input."""
    if "\ufffd" in text:
        return None, [("reject", m.start(), m[0], "", "replacement_character") for m in re.finditer("\ufffd", text)]
    plain = unicodedata.normalize("NFKC", text)
    edits = [e for m in _JA_FOUND.finditer(plain) for e in _ja_edits(m)]
    mapped = _JA_FOUND.sub(lambda m: "".join(to for _, _, to, _ in _ja_edits(m)), plain)
    ends = [m for m in (re.match(r"\s+", mapped), re.search(r"\s+\Z", mapped)) if m]
    events = [("normalize", 0, text, plain, "nfkc")] if plain != text else []
    events += [("map", *e) for e in edits]
    events += [("trim", m.start(), m[0], "", "whitespace") for m in ends]
    return mapped.strip(), events


_EVENT = K.StructType([K.StructField("stage", K.StringType()), K.StructField("position", K.IntegerType()), *(K.StructField(n, K.StringType()) for n in ("source", "target", "kind"))])


_STAGES = ("normalize", "map", "trim", "reject")
_KINDS = ("nfkc", "wave", "quote", "punct", "whitespace", "replacement_character")
#: So many characters are normalised at once, or one text: a tenth to all of them become events.
_JA_CHARACTERS = 1 << 19


@cache
def _ja_classes() -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each code point, 0 if it stays; words: those of the classes first, then replacements; and by class: the
    replacement's code point (0: none), its word, its kind, whether it is white space)."""
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    changes = [("", "", "nfkc"), *((c, *edit) for c, edit in _JA.items()), *((c, " ", "whitespace") for c in spaces)]
    words = [c for c, _, _ in changes]
    words += sorted({to for _, to, _ in changes} - set(words))
    classes = np.zeros(0x110000, dtype=np.uint8)
    classes[[ord(c) for c, _, _ in changes[1:]]] = np.arange(1, len(changes))
    code, word = (np.array([f(to) for _, to, _ in changes]) for f in (lambda to: ord(to) if to else 0, words.index))
    kind = np.array([_KINDS.index(k) for _, _, k in changes])
    return classes, words, code.astype("<u4"), word, kind, kind == _KINDS.index("whitespace")


def normal_ja_rows(texts: list[str | None]) -> pa.StructArray:
    """``normal_ja`` of each text as a struct of text and events; the code points of all texts are mapped together."""
    classes, words, code, word, kind, space = _ja_classes()
    words = list(words)
    plain = [None if t is None or "\ufffd" in t else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
    sizes = np.array([len(p or "") for p in plain], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(p or "" for p in plain).encode("utf-32-le"), dtype="<u4").copy()
    at = np.flatnonzero(of := classes[codes])
    of = of[at]
    row = np.searchsorted(ends, at, side="right")
    # Of a run of white space every second character goes.
    follows = np.zeros(len(at), dtype=bool)
    follows[1:] = space[of[1:]] & space[of[:-1]] & (np.diff(at) == 1) & (np.diff(row) == 0)
    place = np.arange(len(at))
    second = (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 1
    codes[at] = new = np.where(second, 0, code[of])
    gone = new == 0
    mapped = np.delete(codes, at[gone]).tobytes().decode("utf-32-le")
    stops = np.cumsum(sizes - np.bincount(row[gone], minlength=len(texts))).tolist()
    # (row, stage, position, source, target, kind) of all other events, words as places in the list.
    rare: list[tuple[int, int, int, int, int, int]] = []
    out: list[str | None] = []

    def also(i: int, stage: str, position: int, source: str, target: str, why: str) -> None:
        words.extend((source, target))
        rare.append((i, _STAGES.index(stage), position, len(words) - 2, len(words) - 1, _KINDS.index(why)))

    for i, (t, p, a, b) in enumerate(zip(texts, plain, [0, *stops], stops, strict=False)):
        if p is None:
            out.append(None)
            for m in re.finditer("\ufffd", t or ""):
                also(i, "reject", m.start(), m[0], "", "replacement_character")
            continue
        if p is not t and p != t:
            also(i, "normalize", 0, t, p, "nfkc")
        cut = mapped[a:b]
        out.append(bare := cut.strip())
        if len(bare) < len(cut):
            left, right = len(cut) - len(cut.lstrip()), len(cut.rstrip())
            for x, y in ((0, left), (right, len(cut))):
                if x < y:
                    also(i, "trim", x, cut[x:y], "", "whitespace")
    more = np.array(rare, dtype=np.int64).reshape(-1, 6).T
    first = more[1] == _STAGES.index("normalize")
    starts = ends - sizes
    maps = (row, np.full(len(at), _STAGES.index("map")), at - starts[row], of, np.where(second, 0, word[of]), kind[of])
    rows, *fields = (np.concatenate((m[first], x, m[~first])) for m, x in zip(more, maps, strict=True))
    order = np.argsort(rows, kind="stable")
    stage, position, source, target, why = (x[order].astype(np.int32) for x in fields)
    named = lambda known, x: known.take(pa.array(x))
    known = pa.array(words, pa.string())
    columns = [named(pa.array(_STAGES), stage), pa.array(position), named(known, source), named(known, target), named(pa.array(_KINDS), why)]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(texts))))).astype(np.int32)
    events = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=_EVENT.names))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), events], names=["text", "events"])


def _ja_parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in runs of at most ``_JA_CHARACTERS`` characters (a longer text alone)."""
    part, size = [], 0
    for x in texts:
        t = x.as_py()
        if part and size + len(t or "") > _JA_CHARACTERS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


@F.arrow_udf(K.StructType([K.StructField("text", K.StringType()), K.StructField("events", K.ArrayType(_EVENT))]))
def japanese(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """struct of the normalised text and its events. A batch goes out in parts, so that a task holds the events of one."""
    for texts in batches:
        for part in _ja_parts(texts):
            yield normal_ja_rows(part)
