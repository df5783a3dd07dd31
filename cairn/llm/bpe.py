"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are vocabulary entries.
Tier two: every other pre-token goes through a heap of adjacent pairs over linked bytes, lowest rank first,
leftmost first among equals, in O(n log n) of its length.

Null text counts as empty (no ids); repeated rows are encoded each for itself; other columns are left out of
the digest query and kept by `encode_frame`. No shuffle: each task encodes the rows that it reads.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.chunks import PieceEncoder, latin_word
from cairn.session import ship

# Letters and numbers that the installed regex module knows and the rank library's Unicode version does not.
NEWER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEWER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with the letter and number classes of the rank library's Unicode version."""
    letters, numbers = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
    neither = rf"[^\s[\p{{L}}--[{NEWER_LETTERS}]][\p{{N}}--[{NEWER_NUMBERS}]]]"
    swapped = pattern.replace(r"[^\s\p{L}\p{N}]", neither.replace("\\p", "\\P_")).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    return regex.compile(swapped.replace("\\P_", "\\p"), regex.V1)


class PerfectHash:
    """A minimal perfect hash from byte strings to their values: one slot for each key, none empty.

    Keys are dealt to buckets by one hash; for each bucket, largest first, a displacement is sought that sends
    all its keys to free slots. Buckets of one key point to a free slot directly. A stored key is compared at
    lookup, so strings outside the set give None.
    """

    def __init__(self, values: dict[bytes, int]):
        n = len(values)
        self.n, self.n_buckets = n, max(1, n // 3)
        self.displacement = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        buckets: dict[int, list[bytes]] = {}
        for key in values:
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % self.n_buckets, []).append(key)
        free = None
        for b, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(keys) == 1:
                free = free if free is not None else [i for i, k in enumerate(self.keys) if k is None]
                slots = [free.pop()]
                self.displacement[b] = -1 - slots[0]
            else:
                hashes, d = [xxhash.xxh3_64_intdigest(k) for k in keys], 0
                while True:
                    slots = [((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 32 & 0xFFFFFFFF) % n for h in hashes]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.displacement[b] = d
            for key, s in zip(keys, slots, strict=True):
                self.keys[s], self.values[s] = key, values[key]

    def get(self, key: bytes) -> int | None:
        """The key's value, or None for a string outside the set."""
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.n_buckets]
        s = -1 - d if d < 0 else ((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 32 & 0xFFFFFFFF) % self.n
        return self.values[s] if self.keys[s] == key else None


def pair_table(table: dict[bytes, int]) -> dict[int, int]:
    """For each two entries whose bytes joined are an entry: left id * 2**32 + right id -> joined id."""
    pairs = {}
    for whole, rank in table.items():
        for k in range(1, len(whole)):
            left, right = table.get(whole[:k]), table.get(whole[k:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def merge_bytes(ids: list[int], joined: Callable[[int], int | None]) -> list[int]:
    """Merge a piece's byte ids in place: always the pair of lowest rank, leftmost first.

    Parts are linked by the starts of their neighbours; the heap holds rank and start of pairs, and a pair that
    has changed since it was pushed is passed over.
    """
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [joined(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]  # what the pair that starts here becomes
    now.append(None)
    heap = [r << 32 | i for i, r in enumerate(now) if r is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        if now[i] != rank:
            continue
        j = after[i]
        ids[i], ids[j], now[j] = rank, -1, None
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            now[i] = r = joined(rank << 32 | ids[j])
            if r is not None:
                push(heap, r << 32 | i)
        else:
            now[i] = None
        j = before[i]
        if j >= 0:
            now[j] = r = joined(ids[j] << 32 | rank)
            if r is not None:
                push(heap, r << 32 | j)
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes texts to ids and back by one rank table. It is built once on the driver and sent as it is."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(key): int(value) for key, value in map(bytes.split, ranks.splitlines()) if key}
        self.whole = PerfectHash(table)
        self.pairs = pair_table(table)
        self.bytes = [table.get(bytes([b]), -1) for b in range(256)]
        self.pieces = [b""] * (max(table.values(), default=-1) + 1)
        for key, value in table.items():
            self.pieces[value] = key
        self.pattern = pattern
        self._prepare()

    def _prepare(self) -> None:
        self.split = compile_pattern(self.pattern).findall
        self.encoder = PieceEncoder(self._encode_piece, limit=1_000_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "encoder")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _encode_piece(self, piece: str) -> bytes:
        if (m := latin_word(piece)) and m[2]:
            return self._encode_piece(m[1]) + self.encoder.bare[m[2]]
        ids: list[int] = []
        for token in (piece,) if m else self.split(piece):
            raw = token.encode()
            found = self.whole.get(raw)
            if found is None:
                ids += merge_bytes([self.bytes[b] for b in raw], self.pairs.get)
            else:
                ids.append(found)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        return self.encoder.encode(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """This process's codec for a rank table."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file (fixed size, about 1 MB) as bytes; read on the driver, through Spark where it is a URI."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as f:
        return f.read()


def map_ids(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str, columns: str, make: Callable[[Codec, list[np.ndarray]], dict[str, list]]) -> DataFrame:
    """`keep` columns of df, and what make() gives for the ids of each row's whole text."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(codec(read_vocabulary(spark, ranks_path), pattern))
    source = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, bounds = own.encoder.encode_many(part.column(len(keep)))
                made = make(own, [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(x) for x in made.values())], names=[*keep, *made])

    return source.mapInArrow(run, schema)


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(own: Codec, ids: list[np.ndarray]) -> dict[str, list]:
    raw = [x.tobytes() for x in ids]
    return {"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw], "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in raw]}


def encode_frame(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with `token_ids` (array of int, in text order); an own column of that name is replaced."""
    keep = [c for c in df.columns if c != "token_ids"]
    make = lambda own, ids: {"token_ids": [x.astype("<i4") for x in ids]}
    return map_ids(df, ranks_path, pattern, keep, text, "token_ids array<int>", make)


def digest_frame(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip of every text: id, n_tokens, ids_sha256 and decoded_sha256."""
    return map_ids(df, ranks_path, pattern, [id_column], text, DIGESTS, _digests)


def encode_and_digest(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with token_ids, and n_tokens, ids_sha256 and decoded_sha256 to hold them against; own columns of these names are replaced."""
    keep = [c for c in df.columns if c not in (text, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    make = lambda own, ids: {"token_ids": [x.astype("<i4") for x in ids]} | _digests(own, ids)
    return map_ids(df, ranks_path, pattern, keep, text, f"token_ids array<int>, {DIGESTS}", make)
