"""Substring dedup: windows of `width` words that start earlier elsewhere, merged into maximal removal spans.

1. Each task hashes every window of its documents (Rabin-Karp over 64-bit word hashes) in batches of about two
   million words. Within a batch only the first of equal windows goes on; the later ones are marked at once.
   Hashes are cut into ranges of the 64-bit space and packed: a shuffled row holds one batch's hashes of one
   range with the ids and places of just the documents they come from, about ten bytes a window. The number of
   ranges follows the size of the input; a batch's documents as a whole are sent once.
2. A range's rows meet in one group: of equal hashes the smallest (document, start) stays, the others are marked.
   A window that occurs everywhere is one entry for each batch there, so no group is larger for it.
3. Marks go back to their batch, become merged spans of words for each document, and are joined to the texts.

Order is by document id, null first, then start. Rows that share an id are told apart by a hash of their text;
equal rows at equal starts are not earlier than one another. Null and short texts have no windows. Spans refer to
words `[^\\x20\\x09-\\x0D]+`. Windows are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import Rolling, find_words, hash_texts, pack, pack_many, pack_sorted, split_ranges, unpack, unpack_many, unpack_sorted
from cairn.session import free_shuffles, scan_bytes, ship, staged

BATCH_WORDS = 2_000_000
RANGE_BYTES = 6 << 20  # stored input for each range of hashes
LOWEST = -(2**63)


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("__k"), F.xxhash64(body).bitwiseAND(F.lit(0xFFFFFFFF)).alias("__r"), body.alias("__t"))


class _Batch:
    """Documents with their word hashes, until there are enough to send."""

    def __init__(self, width: int, ranges: int):
        self.width, self.ranges, self.roll = width, ranges, Rolling(width)
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, int, np.ndarray]] = []
        self.n = 0

    def add(self, k: int, r: int, words: np.ndarray) -> None:
        if len(words) >= self.width:
            self.docs.append((k, r, words))
            self.n += len(words)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(group, batch, payload): groups from 0 are ranges of hashes; the document table goes to a negative one."""
        if not self.docs:
            return
        self.docs.sort(key=lambda d: d[:2])
        ks, rs = np.array([d[0] for d in self.docs], np.int64), np.array([d[1] for d in self.docs], np.int64)
        sizes = np.array([len(d[2]) for d in self.docs], np.int64)
        table = zlib.compress(pack_many(ks.tobytes(), pack(rs), pack(sizes)), 1)
        batch = xxhash.xxh3_64_intdigest(table) - 2**63
        starts = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.ones(starts[-1], bool)  # windows that end in the document where they start
        for j in range(1, self.width):
            inside[starts[1:] - j] = False
        at = np.flatnonzero(inside)
        hashes = self.roll(np.concatenate([d[2] for d in self.docs]))[at]
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        marked = later_ones(hashes, lambda i: (ks[d := np.searchsorted(starts, at[i], "right") - 1], at[i] - starts[d]))
        yield -1 - batch % (16 * self.ranges), batch, pack_many(table, pack(np.sort(at[marked]).astype(np.uint64)))
        hashes, at = hashes[~marked], at[~marked]
        bounds = split_ranges(hashes, self.ranges)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]
        for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                base = np.uint64((g << 64) // self.ranges)
                there = np.zeros(len(sizes), bool)
                there[doc[a:b]] = True
                ids = ks[there].view(np.uint64) + np.uint64(2**63)  # ascending as unsigned numbers
                yield g, batch, pack_many(pack_sorted(hashes[a:b] - base), pack(at[a:b].astype(np.uint64)), pack_sorted(starts[:-1][there].astype(np.uint64)), ids[:1].tobytes(), pack_sorted(ids - ids[0]))


def later_ones(hashes: np.ndarray, place) -> np.ndarray:
    """Which entries of an ascending array have an equal one at a smaller place; place(indices) -> (document, start)."""
    marked = np.zeros(len(hashes), bool)
    if len(hashes) < 2:
        return marked
    same = hashes[1:] == hashes[:-1]
    member = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if not len(member):
        return marked
    k, start = place(member)
    order = np.lexsort((start, k, hashes[member]))
    member, k, start = member[order], k[order], start[order]
    head = np.concatenate([[True], hashes[member[1:]] != hashes[member[:-1]]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(member)), 0))
    marked[member[(k != k[first]) | (start != start[first])]] = True
    return marked


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["g", "batch", "raw"])


def _windows(keyed: DataFrame, width: int, ranges: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch(width, ranges)
        for part in batches:
            words, bounds = hash_texts(part.column(2))
            for i, (k, r) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                held.add(k, r, words[bounds[i] : bounds[i + 1]])
                if held.n >= BATCH_WORDS:
                    yield _batch_of(list(held.rows()))
                    held.clear()
        if held.docs:
            yield _batch_of(list(held.rows()))

    return keyed.mapInArrow(run, "g bigint, batch bigint, raw binary")


def _mark_range(group: pa.Table) -> pa.Table:
    """One range of hashes: marks for each batch. Document tables pass through."""
    if group.column("g")[0].as_py() < 0:
        return group.select(["batch", "raw"])
    hashes, at, k, start, source = [], [], [], [], []
    batches = group.column("batch").to_pylist()
    for i, raw in enumerate(group.column("raw")):
        deltas, places, offsets, least, ids = unpack_many(raw.as_py())
        offsets, places = unpack_sorted(offsets).astype(np.int64), unpack(places).astype(np.int64)
        d = np.searchsorted(offsets, places, "right") - 1
        hashes.append(unpack_sorted(deltas))
        at.append(places)
        k.append((unpack_sorted(ids) + np.frombuffer(least, np.uint64) - np.uint64(2**63)).view(np.int64)[d])
        start.append(places - offsets[d])
        source.append(np.full(len(places), i, np.int32))
    hashes, at, k, start, source = (np.concatenate(x) for x in (hashes, at, k, start, source))
    order = np.argsort(hashes, kind="stable")
    marked = order[later_ones(hashes[order], lambda i: (k[order[i]], start[order[i]]))]
    out = [(batches[i], pack_many(pack(np.sort(at[marked[source[marked] == i]]).astype(np.uint64)))) for i in np.unique(source[marked])]
    return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "raw": pa.array([r for _, r in out], pa.binary())})


def _spans_of(width: int):
    def run(group: pa.Table) -> pa.Table:
        """All marks of one batch: merged spans for each of its documents that has any."""
        table, marks = None, []
        for raw in group.column("raw"):
            parts = unpack_many(raw.as_py())
            table = parts[0] if len(parts) == 2 else table
            marks.append(unpack(parts[-1]).astype(np.int64))
        ks, rs, sizes = unpack_many(zlib.decompress(table))
        ends = np.cumsum(unpack(sizes)).astype(np.int64)
        marks = np.unique(np.concatenate(marks))
        doc = np.searchsorted(ends, marks, "right")
        start = marks - np.concatenate([[0], ends])[doc]
        if not len(marks):
            return pa.table({"__k": pa.array([], pa.int64()), "__r": pa.array([], pa.int64()), "__spans": pa.array([], pa.binary())})
        first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(start) > width)]))
        last = np.concatenate([first[1:] - 1, [len(marks) - 1]])
        begin, end, doc = start[first], start[last] + width, doc[first]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0]))
        spans = [np.stack([begin[a:b], end[a:b]], 1).astype("<i4").tobytes() for a, b in zip(cut, [*cut[1:], len(doc)], strict=True)]
        return pa.table({"__k": pa.array(np.frombuffer(ks, np.int64)[doc[cut]], pa.int64()), "__r": pa.array(unpack(rs).astype(np.int64)[doc[cut]], pa.int64()), "__spans": pa.array(spans, pa.binary())})

    return run


def removal_spans(docs: DataFrame, width: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged table (__k, __r, __spans): for each document with repeats its maximal spans [begin, end) of words."""
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_column, text)
    ranges = max(64, scan_bytes(docs) // RANGE_BYTES)
    marks = _windows(keyed, width, ranges).groupBy("g").applyInArrow(_mark_range, "batch bigint, raw binary")
    spans = marks.groupBy("batch").applyInArrow(_spans_of(width), "__k bigint, __r bigint, __spans binary")
    return staged(spans.groupBy("__k", "__r").agg(F.first("__spans").alias("__spans")), "spans")


def cut_words(words: list[str], spans: bytes | None) -> list[str]:
    """The words outside the spans."""
    if not spans:
        return words
    kept, at = [], 0
    for begin, end in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
        kept += words[at:begin]
        at = end
    return kept + words[at:]


def _with_spans(docs: DataFrame, width: int, id_column: str, text: str, *keep: str) -> DataFrame:
    spans = removal_spans(docs, width, id_column, text)
    free_shuffles(docs.sparkSession)  # the windows' files go before the texts are shuffled
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    left = docs.select(*keep, F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("__k"), F.xxhash64(body).bitwiseAND(F.lit(0xFFFFFFFF)).alias("__r"), F.col(text).cast("string").alias("__t"))
    return left.join(spans, ["__k", "__r"], "left").select(*keep, "__t", "__spans")


def digest(docs: DataFrame, width: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed and kept_sha256 of the kept words joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = find_words(t or "")
                kept = cut_words(words, spans)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            n, removed, sums = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], names=[id_column, "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _with_spans(docs, width, id_column, text, id_column).mapInArrow(run, f"`{id_column}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, width: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages taken out of the text; untouched texts stay as they are, others become their kept words joined by one space."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, spans = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            made = pa.array([" ".join(cut_words(find_words(x), s)) if s else x for x, s in zip(t, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made if n == text else batch.column(i) for i, n in enumerate(names)], names=names)

    return _with_spans(docs, width, id_column, text, *names).mapInArrow(run, docs.schema)
