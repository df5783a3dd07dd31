"""N-gram Jaccard join by universe partition: which documents' shingle sets are similar, as components.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal sets form a class;
all work is on classes. Sets are similar at Jaccard t when |A & B| >= t/(1+t) (|A| + |B|), so their symmetric
difference is at most H = (1-t)/(1+t) (|A| + |B|).

Size bands. Sets of up to U tokens share a space with all sets that could be similar to one of theirs. The hash
space is cut into m equal segments; a set's subset in a segment is described by a sum of its tokens. If Δ tokens
differ, some segment i with allowance a_i differs in at most a_i, as long as the allowances (+1 each) of a set's
non-empty segments add up to more than H. Allowance 0: the subset itself is indexed; allowance 1: also its
one-deletion neighbourhood (a subset and a neighbour meet; two neighbours do not). Costs decide: small bands
take few segments with allowance 1, larger ones more segments with allowance 0, both with about a third to
spare. Empty segments, which all sets share, are skipped; a set whose remaining allowances fall short goes to
the rest space of its band, where every token is a signature.

Signatures travel packed, some ten bytes each, by ranges; only those of two classes or more are kept. Of these
every class gives up the most widely shared ones, as far as its allowances to spare go (allocation by cost). All
classes go by one order, list size and then signature, so of the signatures that two similar sets share the first
in that order is given up by neither. In a rest space a set of n tokens can spare all but n - ceil(t n) + 1.

Two rounds link every class to the most central class of its signatures (by how often its signatures are shared,
then by most shared signatures); after each, signatures within one component are settled. In what is left, all
pairs across components are compared, lists of more than HOT classes in blocks: first by a parity sketch (a lower
bound of the symmetric difference), then exactly, on the sets made again from the whole texts.

No pair is capped, sampled or left out. Null or wordless texts have empty sets and link with nothing. Null ids
are never a component's id unless there is no other. Repeated rows are equal sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.links import block_pairs, components
from cairn.llm.words import Rolling, hash_texts, mix, pack, pack_many, pack_sorted, split_ranges, unpack, unpack_many, unpack_sorted
from cairn.session import free_shuffles, made_so_far, scan_bytes, ship, staged, tidy, unstage

BATCH_SIGNATURES = 1_500_000
RANGE_BYTES = 8 << 20  # stored input for each range of signatures
HOT = 64
BLOCK = 2048
#: Up to so many places of classes (some 30 bytes each) are broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_HOMES = 1_000_000
SALT = 500


@dataclass(frozen=True)
class Space:
    """A size band: largest set, smallest set that can meet one of it, segments, those with allowance 1."""

    number: int
    largest: int
    smallest: int
    segments: int
    neighbours: int


class Partition:
    """All spaces for a similarity of num / den."""

    def __init__(self, num: int, den: int, growth: float = 1.6):
        self.num, self.den = num, den
        self.spaces: list[Space] = []
        self.growth = growth
        self._grow(1)

    def most_apart(self, a: int, b: int) -> int:
        """The largest symmetric difference of similar sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def _grow(self, size: int) -> None:
        while not self.spaces or self.spaces[-1].largest < size:
            low = self.spaces[-1].largest + 1 if self.spaces else 1
            high = max(low + 3, int(low * self.growth) - 1)
            need = self.most_apart(high, high) + 1
            short = high <= 48
            segments = max(1, -(-3 * need // 4) + (need > 2)) if short else -(-13 * need // 10)
            self.spaces.append(Space(len(self.spaces), high, -(-low * self.num // self.den), segments, segments if short else 0))

    def of(self, size: int) -> list[Space]:
        """The spaces of a set: its own band's and those of larger bands that it can reach."""
        self._grow(size * self.den // self.num + 1)
        return [s for s in self.spaces if s.smallest <= size <= s.largest]

    def signatures(self, tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(space, spare allowance, signatures); the last two bits say: allowance 1 (2), a neighbour (1)."""
        n = len(tokens)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
        for s in self.of(n):
            bounds = split_ranges(tokens, s.segments)
            sizes = np.diff(bounds)
            seed = mix(np.arange(s.segments, dtype=np.uint64) + np.uint64(s.number << 32))
            full = sums[bounds[1:]] - sums[bounds[:-1]] + seed
            here = sizes > 0
            double = (sizes > 1) & bool(s.neighbours)
            spare = int(here.sum() + double.sum()) - 1 - self.most_apart(n, min(s.largest, n * self.den // self.num))
            if spare < 0:
                yield -1 - s.number, -(-n * self.num // self.den) - 1, mix(tokens + np.uint64((s.number << 1) + 1)) & ~np.uint64(3)
            low = np.where(double, np.uint64(2), np.uint64(0))
            out = [(mix(full) & ~np.uint64(3) | low)[here]]
            if double.any():
                segment = np.repeat(np.arange(s.segments), sizes)
                less = mix(full[segment] - mix(tokens)) & ~np.uint64(3) | np.uint64(3)
                out.append(less[double[segment]])
            yield s.number, min(spare, 60_000) if spare >= 0 else 0, np.concatenate(out)


def shingle_sets(texts: pa.Array, n: int, roll: Rolling) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its word n-grams, A-Z lowered; all words as one if they are fewer."""
    words, bounds = hash_texts(texts, lower=True)
    windows = roll(words)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(windows[a : b - n + 1])
        else:
            yield mix(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64)) if b > a else np.empty(0, np.uint64)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of tokens in 512 buckets, or in more by powers of two, four a token at least: a pair much below 0.75 shows."""
    bits = 512
    while bits < 4 * len(tokens):
        bits *= 2
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(bool)).tobytes()


def fold(raw: np.ndarray, size: int) -> np.ndarray:
    """A sketch of `size` bytes from a larger one."""
    while raw.shape[-1] > size:
        half = raw.shape[-1] // 2
        raw = raw[..., :half] ^ raw[..., half:]
    return raw


def _class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("__k"), F.xxhash64(body).alias("__r"), body.alias("__t"))


def _document_table(keyed: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(n)
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), n, roll))
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__k", "__r", "n", "c", "sketch"])

    return keyed.mapInArrow(run, "__k bigint, __r bigint, n bigint, c bigint, sketch binary")


def _packed_signatures(keyed: DataFrame, n: int, num: int, den: int, ranges: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, partition = Rolling(n), Partition(num, den)
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries = list(held.items())
            signatures = np.concatenate([x[1] for _, x in entries])
            owner = np.repeat(np.arange(len(entries), dtype=np.int64), [len(x[1]) for _, x in entries])
            c, space, spare = (np.array(x, np.int64) for x in zip(*((c, s, x[0]) for (c, s), x in entries), strict=True))
            order = np.argsort(signatures)
            signatures, owner = signatures[order], owner[order]
            bounds = split_ranges(signatures, ranges)
            for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b > a:
                    used, own = np.unique(owner[a:b], return_inverse=True)
                    table = pack_many(c[used].tobytes(), zlib.compress(pack((space[used] + 1000).astype(np.uint64)), 1), zlib.compress(pack(spare[used].astype(np.uint64)), 1))
                    base = np.uint64((g << 64) // ranges)
                    raw = pack_many(pack_sorted(signatures[a:b] - base), pack(own.astype(np.uint64)), table)
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([raw], pa.binary())], names=["g", "raw"])

        for batch in batches:
            for tokens in shingle_sets(batch.column(2), n, roll):
                if not len(tokens):
                    continue
                c = _class_of(tokens)
                for space, spare, signatures in partition.signatures(tokens):
                    if (c, space) not in held:
                        held[c, space] = spare, signatures
                        count += len(signatures)
                if count >= BATCH_SIGNATURES:
                    yield from flush()
                    held.clear()
                    count = 0
        if held:
            yield from flush()

    return keyed.mapInArrow(run, "g bigint, raw binary")


def _shared_of(ranges: int):
    def run(group: pa.Table) -> pa.Table:
        """Signatures of one range that two classes or more have, at least one as its own subset."""
        base = np.uint64((group.column("g")[0].as_py() << 64) // ranges)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for raw in group.column("raw"):
            deltas, own, table = unpack_many(raw.as_py())
            c, space, spare = unpack_many(table)
            own = unpack(own).astype(np.int64)
            for held, x in zip(parts, (unpack_sorted(deltas) + base, np.frombuffer(c, np.int64)[own], (unpack(zlib.decompress(space)).astype(np.int64) - 1000)[own], unpack(zlib.decompress(spare)).astype(np.int64)[own]), strict=True):
                held.append(x)
        signatures, c, space, spare = (np.concatenate(x) for x in parts)
        key = signatures >> np.uint64(2)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) > 1 else order[:0]
        order = order[np.lexsort((signatures[order] & np.uint64(1), c[order], key[order]))]
        first = np.ones(len(order), bool)
        first[1:] = (key[order[1:]] != key[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        order = order[first]
        _, run_of, sizes = np.unique(key[order], return_inverse=True, return_counts=True)
        own = np.bincount(run_of, weights=(signatures[order] & np.uint64(1)) == 0, minlength=len(sizes)) if len(order) else np.zeros(0)
        keep = (sizes[run_of] > 1) & (own[run_of] > 0) if len(order) else np.zeros(0, bool)
        order, run_of = order[keep], run_of[keep]
        low = (signatures[order] & np.uint64(3)).astype(np.int64)
        return pa.table({"sig": key[order].astype(np.int64), "c": c[order], "space": space[order].astype(np.int32), "spare": spare[order].astype(np.int32), "own": (low & 1) == 0, "weight": (1 + (low >> 1)).astype(np.int32), "size": sizes[run_of].astype(np.int64)})

    return run


def _afforded(shared: DataFrame, parts: int) -> DataFrame:
    """(sig, c, own, central): the signatures that a class does not give up, and how often its signatures are shared.

    One shuffle by class; a class has as many rows as its set has signatures.
    """
    widest = Window.partitionBy("c", "space").orderBy(F.col("size").desc(), F.col("sig").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = shared.repartition(parts, "c").withColumn("lost", F.sum("weight").over(widest)).withColumn("central", F.sum(F.col("size") - 1).over(Window.partitionBy("c")))
    return ranked.where("lost > spare").select("sig", "c", "own", "central")


def _sets(pairs: DataFrame, known: DataFrame | None, classes: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """(c, tokens) for the classes of pairs (a, b): those in known, and staged ones made from whole texts."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(n)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n, roll)], pa.binary())], names=["c", "tokens"])

    used = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    if known is not None:
        used = used.join(known.select("c"), "c", "left_anti")
    keys = ["__k", "z", "__r"]
    homes = staged(classes.select("c", F.coalesce("__k", F.lit(0)).alias("__k"), F.col("__k").isNull().alias("z"), "__r").join(used, "c"), "homes")
    n_homes = homes.count()
    if not n_homes:
        return known if known is not None else homes.select("c", F.lit(b"").alias("tokens"))
    found = keyed.select(F.coalesce("__k", F.lit(0)).alias("__k"), F.col("__k").isNull().alias("z"), "__r", "__t").join(F.broadcast(homes) if n_homes <= BROADCAST_HOMES else homes, keys)
    # Repeated rows give a set once; the window uses the join's partitioning and order.
    once = found.withColumn("same", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).where("same = 1")
    made = staged(once.select("c", "__t").mapInArrow(make, "c bigint, tokens binary"), "sets")
    free_shuffles(keyed.sparkSession)
    return made if known is None else known.union(made)


def _sift(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                least = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum())
                keep.append(den * min(m, n) >= num * max(m, n) and apart * (den + num) <= (den - num) * (m + n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x, m, s: classes.select(F.col("c").alias(x), F.col("n").alias(m), F.col("sketch").alias(s))
    joined = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return joined.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Staged links (a, b): the pairs whose sets are similar. The set of a b of many pairs is copied for salts."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salts = staged(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("k")), "salts")
    salted = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("salt"))
    left = salted.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), "a")
    right = salts.join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("y")), "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    return staged(left.join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), "links")


def _pairs_in_cell(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        """Pairs across components in one cell that the sketches do not rule out."""
        side = np.array(group.column("__side"))
        cell = group.column("__cell")[0].as_py()
        c, comp, n, own = (np.array(group.column(x)) for x in ("c", "component", "n", "own"))
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("sketch")]
        least = min(map(len, raw))
        bits = np.stack([fold(x, least) for x in raw]).view(np.uint64)
        left = np.flatnonzero(side == cell["i"])
        right = left if cell["i"] == cell["j"] else np.flatnonzero(side == cell["j"])
        a, b = [], []
        step = max(1, 4_000_000 // max(1, len(right) * bits.shape[1]))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            apart = np.bitwise_count(bits[part][:, None, :] ^ bits[right][None, :, :]).sum(-1, dtype=np.int64)
            sizes = n[part][:, None] + n[right][None, :]
            ok = (apart * (den + num) <= (den - num) * sizes) & (comp[part][:, None] != comp[right][None, :]) & (own[part][:, None] | own[right][None, :])
            ok &= den * np.minimum(n[part][:, None], n[right][None, :]) >= num * np.maximum(n[part][:, None], n[right][None, :])
            if cell["i"] == cell["j"]:
                ok &= c[part][:, None] < c[right][None, :]
            i, j = np.nonzero(ok)
            a.append(c[part[i]])
            b.append(c[right[j]])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))  # a side may have no rows
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def similar_components(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: __k (id), __r (text hash), n (set size), component (null for empty sets), component_id (smallest id that links reach)."""
    spark = docs.sparkSession
    ship(spark)
    mark = made_so_far()
    keyed = _keyed(docs, id_column, text)
    ranges = max(32, scan_bytes(docs) // RANGE_BYTES)
    table = staged(_document_table(keyed, n), "documents")
    home = F.min(F.struct(F.col("__k").isNull().alias("z"), F.col("__k").alias("k"), F.col("__r").alias("r"))).alias("home")
    classes = staged(table.where("c is not null").groupBy("c").agg(home, F.count("*").alias("members"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("c", F.col("home.k").alias("__k"), F.col("home.r").alias("__r"), "members", "n", "sketch"), "classes")
    shared = _packed_signatures(keyed, n, num, den, ranges).groupBy("g").applyInArrow(_shared_of(ranges), "sig bigint, c bigint, space int, spare int, own boolean, weight int, size bigint")
    shared = staged(shared, "shared")
    free_shuffles(spark)
    kept = staged(_afforded(shared, ranges), "kept")
    unstage(shared)
    free_shuffles(spark)
    labels = sets = links = tested = None
    for vote in (False, True):
        rows = kept.withColumn("component", F.col("c")) if labels is None else kept.join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
        leaders = rows.groupBy("sig").agg(F.max(F.when(F.col("own"), F.struct("central", "c", "component"))).alias("top"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig", F.col("top.c").alias("leader"), F.col("top.component").alias("leads"), F.col("top.central").alias("rank"))
        aims = rows.join(leaders, "sig").where("component <> leads").groupBy("c", "leader").agg(F.count("*").alias("votes"), F.first("rank").alias("rank"))
        aims = aims.select(F.col("c").alias("a"), F.col("leader").alias("b"), "votes", "rank")
        if tested is not None:
            aims = aims.join(tested, ["a", "b"], "left_anti")
        best = F.max(F.struct("votes", "rank", "b") if vote else F.struct("rank", "votes", "b")).alias("best")
        pairs = staged(aims.groupBy("a").agg(best).select("a", "best.b"), "pairs")
        allowed = staged(_sift(pairs, classes, num, den), "allowed")
        free_shuffles(spark)
        sets = _sets(allowed, sets, classes, keyed, n)
        found = _verify(allowed, sets, num, den)
        links, tested = (found, pairs) if links is None else (links.union(found), tested.union(pairs))
        merged = components(links)
        labels = merged.select(F.col("node").alias("c"), "component")
        free_shuffles(spark)
    rows = kept.join(labels, "c", "left").select("sig", "c", "own", F.coalesce("component", "c").alias("component"))
    open_sigs = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("now")).where("low <> high").select("sig", "now")
    rows = staged(rows.join(open_sigs, "sig"), "open")
    # Short lists: pairs by a self-join on the signature, at most HOT / 2 for each row, made distinct before sketches are looked at.
    short = rows.where(f"now <= {HOT}").select("sig", "c", "component", "own")
    other = short.select("sig", F.col("c").alias("b"), F.col("component").alias("other"), F.col("own").alias("theirs"))
    pairs = short.withColumnRenamed("c", "a").join(other, "sig").where("a < b and component <> other and (own or theirs)").select("a", "b").distinct()
    # Long lists: in blocks.
    long = rows.where(f"now > {HOT}")
    if long.take(1):
        left = long.join(classes.select("c", "n", "sketch"), "c").select("sig", "c", "component", "own", F.col("n").cast("long").alias("n"), "sketch")
        cells = block_pairs(left, "sig", "c", BLOCK).groupBy("sig", "__cell").applyInArrow(_pairs_in_cell(num, den), "a bigint, b bigint")
        pairs = pairs.union(cells).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(_sift(pairs.join(done, ["a", "b"], "left_anti"), classes, num, den), "rest")
    free_shuffles(spark)
    sets = _sets(rest, sets, classes, keyed, n)
    links = links.union(_verify(rest, sets, num, den))
    merged = components(links)
    named = classes.join(merged.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    many = named.where("members > 1").select("c", "component").union(merged.select(F.col("node").alias("c"), "component")).distinct()
    ids = named.groupBy("component").agg(F.min("__k").alias("component_id"))
    many = staged(many.join(ids, "component").select("c", "component", "component_id"), "many")
    tidy(spark, mark, table, many)
    found = F.col("component").isNotNull()
    return table.join(many, "c", "left").select("__k", "__r", "n", F.coalesce("component", "c").alias("component"), F.when(found, F.col("component_id")).otherwise(F.col("__k")).alias("component_id"))


def digest(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id."""
    return similar_components(docs, n, num, den, id_column, text).select(F.col("__k").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of similar documents: of those with the smallest id the first by text hash.

    Null ids count as largest; of equal rows one stays; rows without words are in no group and stay.
    """
    mark = made_so_far()
    found = similar_components(docs, n, num, den, id_column, text).where("component is not null")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("__k").isNull().alias("z"), F.coalesce("__k", F.lit(0)).alias("k"), F.col("__r").alias("r"))).alias("f"))
    first = staged(first.select(F.col("f.k").alias("__kk"), F.col("f.z").alias("__z"), F.col("f.r").alias("__rr"), F.lit(True).alias("__first")), "first")
    tidy(docs.sparkSession, mark, first)
    free_shuffles(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__kk": F.coalesce(F.col(id_column).cast("long"), F.lit(0)), "__z": F.col(id_column).isNull(), "__rr": F.xxhash64(body)})
    keys = ["__kk", "__z", "__rr"]
    same = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    joined = keyed.join(first, keys, "left").withColumn("__same", same)
    return joined.where((F.col("__first") & (F.col("__same") == 1)) | ~body.rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
