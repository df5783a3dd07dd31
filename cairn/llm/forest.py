"""Approximate nearest neighbours by a forest of hash prefixes, for the largest inner product.

Each tree gives every vector a long hash string of SYMBOLS symbols. A symbol is the signed axis on which the vector,
turned at random, lies furthest; the turns are seeded and need no data. Norms are taken in by one more coordinate
that brings all rows to the largest norm, so that the angle to a query orders by inner product.

* Sorted arrays. A tree's strings in order are cut at prefixes: a prefix with more than 4 * share * N / TREES rows is
  cut again one symbol further, so the cuts go deep only where rows crowd, and their number has a bound that does not
  grow with the rows. Counts of prefixes are grouped counts in Spark. A piece (leaf) of many rows is dealt to blocks.
* Descent and synchronous ascent. A query descends in every tree along its own string. The deepest level at which the
  rows under its prefixes in all trees together are share * N or more is its level in all trees; where even one
  symbol gives fewer, it ascends to the root, which is all rows. Its own row does not count, and one tree alone must hold k.
* Candidates. A query goes to the leaves that its prefix overlaps and takes the range of its prefix in their sorted
  arrays by binary search. All rows in the range are compared, none is dropped. Blocks of rows meet blocks of queries,
  so that neither a crowded prefix nor a popular one is one task. Each block returns its k best for each query.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as queries nor as
rows. Vectors of unequal length are never compared; the commonest length sets the turns and others are cut or padded
for hashing alone, do not count for levels, and as queries start at the root. Repeated rows are rows of their own; a query leaves out its own row only. Equal scores go to the
smaller id, null ids last. An empty table gives no rows. Columns other than those named are ignored.

Recall against brute force is measured in tests and stated in the README. `share` buys it: the test tables' vectors
have no structure but some groups of near copies, so that much has to be compared; on clustered data 0.05 or less does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import Staging, ship

TREES, SYMBOLS, AXES, SHARE = 24, 8, 12, 0.6
BLOCK, ASKS = 4096, 1024  # rows and queries that meet in one group
SEED = 7


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors of a list column in a row, bounds of each vector, and which vectors take part."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    return flat, bounds, (bad[bounds[1:]] == bad[bounds[:-1]]) & (some[bounds[1:]] > some[bounds[:-1]])


def _norm(v: np.ndarray) -> float:
    top = float(np.abs(v).max())
    return top * float(np.linalg.norm(v / top))


def _vectors(df: DataFrame, id_column: str, vector: str, asks: Column) -> DataFrame:
    """row, vec_id, ask (whether it is a query), size, norm, raw (the components as they are stored); only vectors that take part."""
    element = df.schema[vector].dataType.elementType.simpleString()
    kind, cast = ("<f4", "array<float>") if element == "float" else ("<f8", "array<double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds, good = rows_of(batch.column(2))
            at = np.flatnonzero(good)
            own = [flat[bounds[i] : bounds[i + 1]] for i in at]
            columns = [*(batch.column(i).take(pa.array(at)) for i in (0, 1)), pa.array([len(v) for v in own], pa.int32()), pa.array([_norm(v) for v in own], pa.float64()), pa.array([v.astype(kind).tobytes() for v in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "ask", "size", "norm", "raw"])

    made = df.select(F.col(id_column).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("ask"), F.col(vector).cast(cast).alias("v"))
    return made.mapInArrow(run, "vec_id bigint, ask boolean, size int, norm double, raw binary").withColumn("row", F.monotonically_increasing_id())


class Turns:
    """The hash strings: for each tree and symbol `axes` orthonormal directions, as many to a turn as there is room for."""

    def __init__(self, size: int, trees: int, symbols: int, axes: int, seed: int):
        self.size, self.trees, self.symbols, self.axes = size + 1, trees, symbols, min(axes, size + 1)
        self.bits = max(1, (2 * self.axes - 1).bit_length())
        rng, made, width = np.random.default_rng(seed), [], trees * symbols * self.axes
        per = self.size // self.axes * self.axes
        while sum(x.shape[1] for x in made) < width:
            made.append(np.linalg.qr(rng.normal(size=(self.size, self.size)))[0][:, :per])
        self.directions = np.hstack(made)[:, :width]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Strings as numbers, first symbol in the highest bits; one row a vector, one column a tree."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for symbol in range(self.symbols):  # directions go tree by tree within a symbol
            step = self.trees * self.axes
            turned = (vectors @ self.directions[:, symbol * step : (symbol + 1) * step]).reshape(len(vectors), self.trees, self.axes)
            axis = np.abs(turned).argmax(2)
            sign = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] < 0
            out = (out << self.bits) | (2 * axis + sign)
        return out


def _hashed(vectors: DataFrame, turns: Broadcast, kind: str, top: float) -> DataFrame:
    """vectors with codes (strings as a row) and, for queries, asked (strings as a query)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: Turns = turns.value
        for batch in batches:
            n, raws = len(batch), batch.column("raw").to_pylist()
            norm, ask = np.asarray(batch.column("norm")), batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            x = np.zeros((n, turn.size))
            for i, raw in enumerate(raws):
                v = np.frombuffer(raw, kind)[: turn.size - 1]
                x[i, : len(v)] = v / norm[i]
            share = norm / top
            as_rows = x * share[:, None]
            as_rows[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - share**2))
            codes, asked = turn(as_rows), iter(turn(x[ask]).tolist())
            columns = [*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array([next(asked) if a else None for a in ask], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "codes", "asked"])

    return vectors.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}, codes array<bigint>, asked array<bigint>")


@dataclass
class Trie:
    """Counts of the prefixes that were counted, by level, and the leaves: the sorted arrays' pieces of each tree."""

    bits: int
    symbols: int
    counts: list[tuple[np.ndarray, np.ndarray]]  # for each level: keys (tree, prefix) in order, and rows of the commonest length under them
    tree: np.ndarray  # of each leaf; leaves are in order of tree and string
    low: np.ndarray  # first string of each leaf
    high: np.ndarray  # first string behind it
    rows: np.ndarray

    def key(self, tree: np.ndarray, prefix: np.ndarray, level: int) -> np.ndarray:
        return (tree.astype(np.int64) << (self.bits * level)) | prefix

    def count(self, tree: np.ndarray, code: np.ndarray, level: int) -> np.ndarray:
        """Rows under the codes' prefixes of `level` symbols; 0 where they were not counted."""
        keys, n = self.counts[level - 1]
        wanted = self.key(tree, code >> (self.bits * (self.symbols - level)), level)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, n[at], 0)

    def leaves(self, tree: int, low: int, high: int) -> range:
        """The leaves of a tree that overlap strings low <= x < high."""
        a, b = np.searchsorted(self.tree, [tree, tree + 1])
        return range(a + int(np.searchsorted(self.high[a:b], low, "right")), a + int(np.searchsorted(self.low[a:b], high, "left")))

    def leaf_of(self, tree: int, codes: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.tree, [tree, tree + 1])
        return a + np.searchsorted(self.low[a:b], codes, "right") - 1


def count_prefixes(hashed: DataFrame, bits: int, symbols: int, crowded: float, size: int) -> Trie:
    """Count prefixes level by level, going on only below those with more rows than `crowded`."""
    spark, counts, leaves, parents = hashed.sparkSession, [], [], None
    for level in range(1, symbols + 1):
        now = hashed.select("size", F.posexplode("codes").alias("tree", "code")).select("size", "tree", F.shiftright("code", bits * (symbols - level)).alias("prefix"))
        if parents is not None:
            now = now.withColumn("parent", F.shiftright("prefix", bits)).join(F.broadcast(parents), ["tree", "parent"])
        found = np.array([(r.tree, r.prefix, r.n, r.same) for r in now.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.count_if(F.col("size") == size).alias("same")).collect()], np.int64).reshape(-1, 4)
        keys = (found[:, 0] << (bits * level)) | found[:, 1]
        order = np.argsort(keys)
        found, keys = found[order], keys[order]
        counts.append((keys, found[:, 3]))
        last = found[:, 2] <= crowded if level < symbols else np.ones(len(found), bool)
        shift = bits * (symbols - level)
        leaves.append(np.stack([found[last, 0], found[last, 1] << shift, (found[last, 1] + 1) << shift, found[last, 2]], 1))
        if last.all():
            break
        parents = spark.createDataFrame(found[~last, :2].tolist(), "tree int, parent bigint")
    every = np.concatenate(leaves)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    return Trie(bits, symbols, counts, *(np.ascontiguousarray(every[:, i]) for i in range(4)))


def levels(trie: Trie, asked: np.ndarray, target: float, k: int) -> np.ndarray:
    """For each query (a row of strings, one a tree) the deepest level with `target` other rows or more in all trees together and k in one; 0 is the root."""
    out, tree = np.zeros(len(asked), np.int64), np.arange(asked.shape[1])
    for level in range(1, len(trie.counts) + 1):
        others = np.maximum(trie.count(tree[None, :], asked, level) - 1, 0)
        out[(others.sum(1) >= target) & (others.max(1) >= k)] = level
    return out


def _visits(hashed: DataFrame, sent: Broadcast, target: float, k: int, size: int) -> DataFrame:
    """One row for each query and leaf that it visits: the range of strings that it takes there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = sent.value
        for batch in batches:
            if not len(batch):
                continue
            asked = np.array(batch.column("asked").to_pylist(), np.int64)
            owner, leaf, low, high = [], [], [], []
            depth = np.where(np.asarray(batch.column("size")) == size, levels(trie, asked, target, k), 0)
            for i, level in enumerate(depth.tolist()):
                shift = trie.bits * (trie.symbols - level)
                for tree in range(asked.shape[1] if level else 1):  # at the root all trees are the same set
                    prefix = int(asked[i, tree]) >> shift
                    a, b = prefix << shift, (prefix + 1) << shift
                    for x in trie.leaves(tree, a, b):
                        owner.append(i), leaf.append(x), low.append(a), high.append(b)
            own = pa.array(owner, pa.int64())
            columns = [pa.array(leaf, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), *(batch.column(c).take(own) for c in ("row", "vec_id", "size", "raw"))]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "low", "high", "row", "vec_id", "size", "raw"])

    return hashed.where("ask").mapInArrow(run, "leaf bigint, low bigint, high bigint, row bigint, vec_id bigint, size int, raw binary")


def _placed(hashed: DataFrame, sent: Broadcast, chunks: Broadcast, block: int) -> DataFrame:
    """Every row once for each tree whose leaf is visited, and each chunk of the leaf's queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, asks = sent.value, chunks.value
        for batch in batches:
            codes = np.array(batch.column("codes").to_pylist(), np.int64).reshape(len(batch), -1)
            rows = np.asarray(batch.column("row"))
            for tree in range(codes.shape[1]):
                leaf = trie.leaf_of(tree, codes[:, tree])
                copies = asks[leaf]
                own = np.repeat(np.arange(len(batch)), copies)
                chunk = np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
                blocks = -(-trie.rows[leaf] // block)
                part = (rows * 2654435761 >> 7) % blocks
                taken = pa.array(own)
                columns = [pa.array(leaf[own]), pa.array(part[own]), pa.array(chunk), pa.array(codes[own, tree]), *(batch.column(c).take(taken) for c in ("row", "vec_id", "size", "raw"))]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "block", "chunk", "code", "row", "vec_id", "size", "raw"])

    return hashed.mapInArrow(run, "leaf bigint, block bigint, chunk bigint, code bigint, row bigint, vec_id bigint, size int, raw binary")


LAST = np.iinfo(np.int64).max


def best_of(asks: np.ndarray, ask_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best, ties by smaller id.

    A matrix product sorts out; the scores of what may be among the k best are then summed anew, component by component
    in one order, so that equal vectors have equal scores wherever they stand.
    """
    near = asks @ vectors.T
    own = ask_rows[:, None] == rows[None, :]
    near[own] = -np.inf
    if near.shape[1] > k:
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        slack = 1e-12 * np.linalg.norm(asks, axis=1) * np.linalg.norm(vectors, axis=1).max()
        i, j = np.nonzero((near >= (kth - slack)[:, None]) & ~own)
    else:
        i, j = np.nonzero(~own)
    score = np.empty(len(i))
    for at in range(0, len(i), 100_000):
        score[at : at + 100_000] = (asks[i[at : at + 100_000]] * vectors[j[at : at + 100_000]]).sum(1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k]


def _search(kind: str, k: int) -> Callable:
    schema = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table, size: int) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(-1, size).astype(np.float64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for size in pc.unique(right.column("size")).to_pylist() if len(left) else []:
            rows = left.filter(pc.equal(left.column("size"), size)).sort_by("code")
            asks = right.filter(pc.equal(right.column("size"), size))
            if not len(rows):
                continue
            codes, vectors, wanted = np.asarray(rows.column("code")), matrix(rows, size), matrix(asks, size)
            row, ask = np.asarray(rows.column("row")), np.asarray(asks.column("row"))
            ids = rows.column("vec_id").fill_null(LAST).to_numpy()
            low, high = (np.searchsorted(codes, np.asarray(asks.column(c)), "left") for c in ("low", "high"))
            ranges, group = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
            for g, (a, b) in enumerate(ranges.tolist()):
                own = np.flatnonzero(group.ravel() == g)
                i, j, score = best_of(wanted[own], ask[own], vectors[a:b], row[a:b], ids[a:b], k) if b > a else (own[:0], own[:0], np.empty(0))
                i, j = pa.array(own[i]), pa.array(a + j)
                columns = [asks.column("row").take(i), asks.column("vec_id").take(i), rows.column("row").take(j), rows.column("vec_id").take(j), pa.array(score)]
                out.append(pa.table(columns, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def nearest(df: DataFrame, asks: Column, k: int = 20, share: float = SHARE, trees: int = TREES, symbols: int = SYMBOLS, axes: int = AXES, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that `asks` selects, its k rows of largest inner product among its candidates."""
    spark, staging = df.sparkSession, Staging()
    ship(spark)
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = staging.put(_vectors(df, id_column, vector, asks), "vectors")
    sizes = vectors.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # one row for each length
    if not sizes:
        staging.drop()
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total, size = sum(r.n for r in sizes), max(sizes, key=lambda r: (r.n, r["size"]))["size"]
    turns = Turns(size, trees, symbols, axes, SEED)
    hashed = staging.put(_hashed(vectors, spark.sparkContext.broadcast(turns), kind, max(r.top for r in sizes)), "hashed")
    trie = count_prefixes(hashed, turns.bits, symbols, 4 * share * total / trees, size)
    sent = spark.sparkContext.broadcast(trie)
    visits = staging.put(_visits(hashed, sent, share * total, k, size), "visits")
    asked = np.zeros(len(trie.rows), np.int64)
    for r in visits.groupBy("leaf").count().collect():  # one row for each leaf
        asked[r[0]] = r[1]
    chunks = -(-asked // ASKS)
    blocks = -(-trie.rows // BLOCK)
    per_leaf = spark.createDataFrame([(int(x), int(chunks[x]), int(blocks[x])) for x in np.flatnonzero(chunks)], "leaf bigint, chunks bigint, blocks bigint")
    dealt = visits.join(F.broadcast(per_leaf), "leaf").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")
    placed = _placed(hashed, sent, spark.sparkContext.broadcast(chunks), BLOCK)
    keys = ["leaf", "block", "chunk"]
    found = placed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search(kind, k), "ask bigint, query_id bigint, row bigint, vec_id bigint, score double")
    found = staging.put(found.groupBy("ask", "query_id", "row", "vec_id").agg(F.max("score").alias("score")), "found")
    staging.drop(found)
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
