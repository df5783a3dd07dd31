"""Memoised encoding of whole texts by space-led pieces.

Both byte-level tokenizers split a text by the same pattern before they merge. In that pattern only a
match's first character can be a space, so a single space between two non-space characters always starts
a new match. Cutting a text there, encoding every distinct piece once and joining the ids gives exactly
the ids of the whole text. Texts where a piece touches other white space are cut by a look-around pattern
at the safe spaces only. Texts in Latin letters are cut at more such places, by whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts before a single space between two non-space characters.
_SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: A word of Latin letters after a space, and plain punctuation: one match of the split pattern each.
latin_word = re.compile(r"( [A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?|]*)").fullmatch


class _Unsafe(Exception):
    """A piece touches other white space than the single space before it."""


class _Memo(dict):
    """Bytes of the ids of pieces; pieces over 32 characters are not kept."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        if self.before and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise _Unsafe
        made = self.encode(self.before + piece)
        if len(piece) <= 32:
            self[piece] = made
        return made


class _Latin(dict):
    """Bytes of the ids of pieces given as UTF-8; pieces over 32 bytes are not kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        made = self.encode(piece.decode())
        if len(piece) <= 32:
            self[piece] = made
        return made


class PieceEncoder:
    """Encodes texts to bytes (ids as little-endian numbers), each distinct piece once while the memo holds it.

    A memo of `limit` pieces is emptied, so memory is bounded whatever the corpus.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 400_000):
        self.limit = limit
        self.spaced = _Memo(encode, " ")  # keyed by the piece without the space before it
        self.bare = _Memo(encode, "")
        self.latin = _Latin(encode)

    def encode(self, text: str | None) -> bytes:
        """The bytes of a text's ids; a null text counts as empty."""
        for memo in (self.spaced, self.bare):
            if len(memo) > self.limit:
                memo.clear()
        first, *rest = (text or "").split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Unsafe
            return b"".join([self.bare[first], *map(self.spaced.__getitem__, rest)])
        except _Unsafe:
            return b"".join(map(self.bare.__getitem__, _SAFE_SPACE.split(text)))

    def encode_many(self, texts: pa.Array, known: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of texts as one array of 32-bit numbers, and the bounds of each text's ids in it.

        Texts in Latin letters are cut and their pieces told apart for the whole array at once, so the memo is asked
        only once for each distinct piece. All others go through encode(). known: bytes to take for the texts at
        these indices instead.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        raw, offsets = raw_texts(texts)
        own = {i: known[i] if known and i in known else self.encode(texts[i].as_py()) for i in sorted({*_not_latin(raw, offsets), *(known or ())})}
        if own:
            latin = np.ones(len(texts), bool)
            latin[list(own)] = False
            raw, offsets = raw_texts(texts.filter(pa.array(latin)))
        ids, bounds = self._encode_latin(raw, offsets)
        if own:
            parts = np.split(ids, bounds[1:-1]) if len(bounds) > 1 else []
            for i, x in own.items():  # ascending, so that later places are right
                parts.insert(i, np.frombuffer(x, "<u4"))
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    def _encode_latin(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        if len(self.latin) > self.limit:
            self.latin.clear()
        at = latin_cuts(raw, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        codes = np.asarray(coded.indices)
        _, own, data = coded.dictionary.buffers()
        own, data = np.frombuffer(own, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
        encoded = [self.latin[data[a:b]] for a, b in zip(own[:-1], own[1:], strict=True)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        begins = np.cumsum(sizes) - sizes
        length = sizes[codes]
        ends = np.cumsum(length)
        ids = np.frombuffer(b"".join(encoded), "<u4")[np.repeat(begins[codes] - ends + length, length) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(at, offsets)]


def raw_texts(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and each text's bounds in them."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)), offsets - first


def _flags(*members: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_ASCII_LETTERS = [*range(65, 91), *range(97, 123)]
#: Lead bytes of U+00C0 to U+023F, all letters but for two signs of U+00C0 to U+00FF.
_LEADS = range(0xC3, 0xC9)
_SURE = _flags(*range(0x21, 0x7F), *range(0x80, 256))  # never white space in these texts
_LETTER_END = _flags(*_ASCII_LETTERS, *range(0x80, 0xC0))
_LETTER_START = _flags(*_ASCII_LETTERS, *_LEADS)
_PUNCTUATION = _flags(*b".,;:!?|\n")
_FOREIGN = _flags(*(set(range(0xC0, 256)) - set(_LEADS)))


def _not_latin(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts with characters from U+0240 on, from U+0080 to U+00BF, or the signs of multiplication and division."""
    foreign = _FOREIGN[raw]
    foreign[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(foreign), "right") - 1).tolist()


def latin_cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of Latin texts begin: places where the split pattern must start a match whatever stands around.

    Before a single space between characters that are not white space; between a letter and punctuation or a line
    break; between a single line break and a letter. And where texts begin.
    """
    sure, cut = _SURE[raw], np.zeros(len(raw), bool)
    cut[1:-1] = (raw[1:-1] == 32) & sure[:-2] & sure[2:]
    cut[1:] |= _PUNCTUATION[raw[1:]] & _LETTER_END[raw[:-1]]
    cut[2:] |= _LETTER_START[raw[2:]] & (raw[1:-1] == 10) & sure[:-2]
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)
