"""Words, word hashes and packed integers shared by the window and shingle operators (numpy, in Python workers)."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

find_words = re.compile(r"[^\x20\x09-\x0d]+").findall


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers = _Powers(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, none for white space; the second table takes A-Z as a-z.
_VALUES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_VALUES[_SPACE] = 0
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
STEP = 1 << 20


def hash_texts(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an array of strings, and the bounds of each text's words in it.

    A word's hash is the mixed sum of its bytes' values times powers of a base. Works on blocks of words of about
    a million bytes, however long a text is.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets is not None else np.zeros(len(texts) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, last - first, first)
    offsets = offsets - first
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    values, out, at = _LOWER if lower else _VALUES, np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + STEP)))
        high = starts[to] if to < len(starts) else len(raw)
        up, down = _byte_powers.upto(int(high - low))
        own = starts[at:to] - low
        out[at:to] = np.add.reduceat(values[raw[low:high]] * up, own) * down[own]
        at = to
    return mix(out), np.searchsorted(starts, offsets)


class Rolling:
    """Rabin-Karp hashes of all windows of `width` by prefix sums: sum of w[i] * B**-i, times B**i, modulo 2**64; in blocks."""

    def __init__(self, width: int, base: int = 0xA24BAED4963EE407):
        self.width, self.powers = width, _Powers(base)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(max(0, len(w) - self.width + 1), np.uint64)
        for at in range(0, len(out), STEP):
            part = w[at : at + STEP + self.width - 1]
            up, down = self.powers.upto(len(part))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * down, dtype=np.uint64)])
            windows = len(part) - self.width + 1
            out[at : at + windows] = (sums[self.width :] - sums[: -self.width]) * up[:windows]
        return mix(out)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as one byte for the width and `width` bytes each."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The numbers of pack()."""
    width = raw[0]
    flat = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :width] = flat
    return out.view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return pack(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def pack_many(*parts: bytes) -> bytes:
    """Byte strings, each behind its length."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_many(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


@lru_cache(maxsize=4096)
def _edges(n: int) -> np.ndarray:
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def split_ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal ranges of the 64-bit space in an ascending array."""
    return np.concatenate([[0], np.searchsorted(hashes, _edges(n)), [len(hashes)]]).astype(np.int64)
