"""Sorted-string-table shards of token ids.

A shard file holds documents in ascending key order:

    block*   entries (shared key length, own key length, value length as varints; rest of key; value), CRC-32
    index    for each block: first key, offset, length
    bloom    bits of a Bloom filter over the shard's keys, 10 a key, 7 probes
    footer   offsets and lengths of index and bloom, documents, tokens, shard number, id width, magic

Keys are one byte (0: null, 1: a number) and the number as 8 big-endian bytes with the sign bit flipped, so
byte order is numeric order with null first. Within a block a key leaves out what it shares with the key
before it. Values are ids as little-endian unsigned integers of 16 bits where the vocabulary allows, else 32.

Files are written and read by Spark's own text and binaryFile connectors (each block is a row whose bytes go
through the text sink unchanged; the one line-feed after each row is counted in the offsets), so they work in
any store, and a task that is run again replaces its file through the commit protocol.

Null text counts as empty; null ids sort first; repeated ids stay, in order of their texts' bytes; an empty
table gives no documents. Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.bpe import read_vocabulary
from cairn.llm.chunks import PieceEncoder, latin_word
from cairn.session import drop_path, scan_bytes, scratch_path, ship, staged

MAGIC = b"CRNSST1\n"
FOOTER = struct.Struct("<QQQQQQIB8s")
BLOCK_BYTES = 64 * 1024
BITS_A_KEY, PROBES = 10, 7
PAD = 1  # the text sink's line-feed after each row


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id & (2**64 - 1)) ^ 2**63)


def id_of(key: bytes) -> int | None:
    if key == b"\0":
        return None
    n = struct.unpack(">Q", key[1:])[0] ^ 2**63
    return n - 2**64 if n >= 2**63 else n


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % 2**64 % bits for i in range(PROBES)]


class ShardWriter:
    """Turns documents in key order into the rows of one shard file."""

    def __init__(self, shard: int, width: int):
        self.shard, self.width = shard, width
        self.at = self.docs = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last = bytearray(), None, b""

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.first = key if self.first is None else self.first
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            yield self._close()

    def _row(self, raw: bytes) -> bytes:
        self.at += len(raw) + PAD
        return raw

    def _close(self) -> bytes:
        raw = bytes(self.block)
        raw += struct.pack("<I", zlib.crc32(raw))
        self.index.append((self.first, self.at, len(raw)))
        self._open()
        return self._row(raw)

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close()
        bits = max(64, len(self.keys) * BITS_A_KEY) + 7 & ~7
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[bloom_probes(key, bits)] = True
        index_at, index = self.at, b"".join(bytes([len(k)]) + k + struct.pack("<QQ", o, n) for k, o, n in self.index)
        yield self._row(index)
        bloom_at, raw = self.at, np.packbits(bloom, bitorder="little").tobytes()
        yield self._row(raw)
        yield FOOTER.pack(index_at, len(index), bloom_at, len(raw), self.docs, self.tokens, self.shard, self.width, MAGIC)


class RemoteFile:
    """Parts of a file of any store, read by seeking through Hadoop's file system API; sliced and indexed like bytes."""

    def __init__(self, spark: SparkSession, path: str, length: int):
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.length, self.read = length, spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        self.stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop_path)
        self.bytes_read = 0

    def __getitem__(self, at: int | slice) -> int | bytes:
        low, high, _ = at.indices(self.length) if isinstance(at, slice) else (at, at + 1, 1)
        self.stream.seek(low)
        raw = bytes(self.read(self.stream, high - low))
        self.bytes_read += len(raw)
        return raw if isinstance(at, slice) else raw[0]

    def close(self) -> None:
        self.stream.close()


class Shard:
    """Reads one shard file, block by block; of a RemoteFile only footer, index, and what is asked for."""

    def __init__(self, raw: bytes | memoryview | RemoteFile):
        self.raw = raw
        self.index_at, index_n, self.bloom_at, self.bloom_n, self.docs, self.tokens, self.shard, self.width, magic = FOOTER.unpack(raw[-FOOTER.size - PAD : -PAD])
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.first_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        at, index = 0, bytes(raw[self.index_at : self.index_at + index_n])
        while at < index_n:
            n = index[at]
            self.first_keys.append(index[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QQ", index, at + 1 + n))
            at += n + 17

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        offset, n = self.blocks[block]
        raw = bytes(self.raw[offset : offset + n])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {block} of shard {self.shard} is damaged")
        at, key = 0, b""
        while at < n - 4:
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + size]
            at += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """All documents of that id: Bloom filter, binary search over the block index, scan of the blocks."""
        from bisect import bisect_left

        key, bits = key_of(doc_id), self.bloom_n * 8
        if not all(self.raw[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in bloom_probes(key, bits)):
            return []
        found = []
        for block in range(max(0, bisect_left(self.first_keys, key) - 1), len(self.blocks)):
            if self.first_keys[block] > key:
                break
            found += [self.ids(v) for k, v in self.entries(block) if k == key]
        return found


class LibraryEncoder:
    """The tokenizers library's encoding of whole texts, each distinct piece asked for once while it is remembered.

    Plain words go straight to the library's merge model in its byte alphabet; all else goes through its full
    encoder. Texts that hold an added token's string go to the library whole.
    """

    def __init__(self, vocabulary: bytes):
        self.own = Tokenizer.from_str(vocabulary.decode())
        self.specials = [t.content for t in self.own.get_added_tokens_decoder().values()]
        byte_level = json.loads(vocabulary).get("pre_tokenizer") or {}
        self.plain = byte_level.get("type") == "ByteLevel" and byte_level.get("use_regex", True) and not byte_level.get("add_prefix_space") and self.own.normalizer is None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.pieces = PieceEncoder(self._piece, limit=600_000)
        self.width = 2 if self.own.get_vocab_size() <= 65536 else 4

    def _whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (self.plain and (m := latin_word(piece))):
            return self._whole(piece)
        word, tail = m.groups()
        shown = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.own.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids) + (self.pieces.bare[tail] if tail else b"")

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        return self._whole(text) if text and any(s in text for s in self.specials) else self.pieces.encode(text)


    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of texts as one array, and the bounds of each text's ids in it."""
        held = np.zeros(len(texts), bool)
        for s in self.specials:
            held |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False))
        return self.pieces.encode_many(texts, {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(held).tolist()})


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(vocabulary: bytes) -> LibraryEncoder:
    """This process's encoder for a vocabulary; kept between tasks."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = LibraryEncoder(vocabulary)
    return _encoders[name]


def write_shards(df: DataFrame, path: str, vocabulary_path: str, end_id: int, id_column: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20) -> None:
    """Encode df's texts, end each with end_id, and write them as shards in ascending id order.

    The number of shards follows the input's size (`shard_bytes` of stored input each), so a shard fits a task.
    The one shuffle deals texts by range of id; encoding happens behind it, in key order.
    """
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary_path))
    source = df.select(F.col(id_column).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    shards = max(spark.sparkContext.defaultParallelism, scan_bytes(source) // shard_bytes)
    dealt = source.repartitionByRange(shards, F.asc_nulls_first("k")).sortWithinPartitions(F.asc_nulls_first("k"), F.asc_nulls_first("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_encoder(vocabulary.value)
        width = own.width if end_id < 65536 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                if writer is None:
                    writer = ShardWriter(TaskContext.get().partitionId(), width)
                ids, bounds = own.encode_many(part.column(1))
                ids = ids.astype(f"<u{width}")
                for i, key in enumerate(part.column(0).to_pylist()):
                    rows += writer.add(key_of(key), ids[bounds[i] : bounds[i + 1]].tobytes() + end)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["raw"])
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], names=["raw"])

    dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value")).write.text(path)


def _scan(spark: SparkSession, path: str, make: Callable[[Shard], dict[str, pa.Array]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").where("length > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                made = make(Shard(memoryview(raw.as_buffer())))
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return files.mapInArrow(run, schema)


def read_digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Staged, per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are read once, one a batch. Starts are sums of two levels: within a shard as it is read, and over the
    shards' totals by groups of 1,000 shards, so no task sees more than a thousandth of the shards.
    """

    def documents(shard: Shard) -> dict[str, pa.Array]:
        keys, sizes, sums = [], [], []
        for key, value in shard:
            ids = shard.ids(value).astype("<u4")
            keys.append(id_of(key))
            sizes.append(len(ids))
            sums.append(zlib.crc32(ids.tobytes()))
        ends = np.cumsum(np.array(sizes, np.int64))
        return {
            "shard": pa.array([shard.shard] * len(keys), pa.int64()), id_column: pa.array(keys, pa.int64()), "start_in": pa.array(ends - np.array(sizes, np.int64), pa.int64()),
            "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
        }

    found = staged(_scan(spark, path, documents, f"shard bigint, `{id_column}` bigint, start_in bigint, n_tokens bigint, ids_crc32 bigint"), "sst-documents")
    totals = found.groupBy("shard").agg(F.max(F.col("start_in") + F.col("n_tokens")).alias("total")).withColumn("bunch", F.floor(F.col("shard") / 1000))
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = totals.withColumn("in_bunch", before(Window.partitionBy("bunch").orderBy("shard")))
    bunches = totals.groupBy("bunch").agg(F.sum("total").alias("total")).withColumn("to_bunch", before(Window.partitionBy(F.lit(0)).orderBy("bunch"))).drop("total")
    offsets = within.join(bunches, "bunch").select("shard", (F.col("in_bunch") + F.col("to_bunch")).alias("offset"))
    return found.join(offsets, "shard").select(id_column, (F.col("offset") + F.col("start_in")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], opened: list[RemoteFile] | None = None) -> list[tuple]:
    """Point lookups: (id, token ids) of each stored document with one of these ids.

    Shards are in key order by file name and a key is in one of them, so the files are searched by halving: of each that
    is probed footer and index are read, of the one that may hold the key its Bloom filter's bits and the blocks of the
    key. Nothing else is read, and no job runs. opened: gets the files that were opened.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    files = sorted((x.getPath().toString(), x.getLen()) for x in listed if x.getPath().getName().startswith("part-") and x.getLen() > 0)
    shards: dict[int, Shard] = {}

    def shard(n: int) -> Shard:
        if n not in shards:
            shards[n] = Shard(RemoteFile(spark, *files[n]))
        return shards[n]

    out = []
    for d in doc_ids:
        key, low, high = key_of(d), 0, len(files)
        while high - low > 1:  # the last shard whose first key is not beyond the key
            middle = (low + high) // 2
            low, high = (middle, high) if shard(middle).first_keys[0] <= key else (low, middle)
        if files:
            out += [(d, ids.tolist()) for ids in shard(low).lookup(d)]
    for s in shards.values():
        s.raw.close()
    if opened is not None:
        opened += [s.raw for s in shards.values()]
    return out


def round_trip(df: DataFrame, vocabulary_path: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df as shards in the shared folder and return what the files say of each document."""
    path = scratch_path(df.sparkSession, "sst")
    write_shards(df, path, vocabulary_path, end_id, id_column, text)
    found = read_digests(df.sparkSession, path, id_column)
    drop_path(df.sparkSession, path)
    return found
