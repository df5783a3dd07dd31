"""Importance resampling to a target distribution over hashed word n-grams, by a vectorised byte automaton.

The bytes of an Arrow string buffer are classified by a lookup table, words begin and end where the class changes, and
the CRC-32 of every run of words advances by one table step a byte for all runs at once. A run of j words goes on from
the state of the run of j - 1 words: one space, then the next word of the same text.

1. Every text becomes its feature buckets, packed; the text is read once and the packed rows are staged.
2. Bucket counts of corpus and target are partial sums; no more than `buckets` rows reach the driver.
3. A bucket's gain is a floored scaled log ratio; a document's weight is the sum over its features.
4. The draw is Gumbel top-k: a noise of the document's id is added to the weight and the highest scores are drawn. Ranks
   are global without a single sorting task: a range partitioning by score, and each part's offset.

Null and empty texts have no features and weight 0. A null id is hashed as an empty string and comes last among ties.
Repeated rows are rows of their own; equal ones share out their ranks in no stated order. Other columns are ignored, so
clashing names do no harm. An empty target or corpus counts nothing; gains are then those of the other side alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.chunks import raw_texts
from cairn.session import Staging, ship

POLYNOMIAL = 0xEDB88320
#: Words are taken in blocks of so many, and by zlib where they are longer than LONG bytes.
STEP, LONG = 1 << 17, 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def find_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words of texts that stand in a row in raw, and the bounds of each text's words."""
    solid = _WORD[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes raw[starts:ends] of each run; raw is already lower-cased."""
    state = state.copy()
    length = ends - starts
    for i in np.flatnonzero(length > LONG):
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    length = np.where(length > LONG, 0, length)
    order = np.argsort(-length, kind="stable")
    at, now = starts[order], state[order]
    longer = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")  # how many runs have more than k bytes
    for k, n in enumerate(longer.tolist()):
        part = now[:n]
        now[:n] = _CRC[(part ^ raw[at[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    state[order] = now
    return state


def buckets_of(raw: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of all texts (a text's features in a row), their bounds, and each text's words.

    Features are the runs of 1 to `longest` words of one text, joined by a space, A-Z as a-z.
    """
    starts, ends, words = find_words(raw, bounds)
    raw = _LOWER[raw]
    last = np.repeat(words[1:], np.diff(words))  # the index after the last word of a word's text
    found, owner = [], []
    space = np.array([32], np.uint8)
    for at in range(0, len(starts), STEP):
        run = np.arange(at, min(at + STEP, len(starts)))
        state = np.full(len(run), 0xFFFFFFFF, np.uint32)
        for j in range(longest):
            if j:
                keep = run + j < last[run]
                run, state = run[keep], state[keep]
                state = advance(state, space, np.zeros(len(run), np.int64), np.ones(len(run), np.int64))
            state = advance(state, raw, starts[run + j], ends[run + j])
            found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
            owner.append(run)
    if not found:
        return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64), words
    values, owner = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, np.searchsorted(owner, words), words


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _packed(longest: int, buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            raw, bounds = raw_texts(texts)
            values, cuts, words = buckets_of(raw, bounds, longest, buckets)
            size = np.dtype(_width(buckets)).itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values.astype(_width(buckets))))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words)), pa.array(np.diff(cuts)), packed.cast(pa.binary())], names=["doc_id", "n_words", "n_features", "packed"])

    return run


def features(df: DataFrame, id_column: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, packed (the buckets of all features as little-endian numbers), one row a text."""
    ship(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_packed(longest, buckets), "doc_id bigint, n_words bigint, n_features bigint, packed binary")


def bucket_counts(made: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs; a task sends one row for each bucket that it has, at most `buckets`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), _width(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = made.select("packed").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, target over corpus, for each bucket."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_corpus + n)) / float((s + 1) * (all_target + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(sent: Broadcast, buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(sent.value[np.frombuffer(x.as_buffer(), _width(buckets))].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """A scaled, floored Gumbel number by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def top_ranks(df: DataFrame, order: list[Column], k: int, staging: Staging) -> DataFrame:
    """df with `rank`: 1 to k in the given order, null beyond; the order must be total. No task sees more than its range."""
    spark = df.sparkSession
    parts = staging.put(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    at, offsets = 0, []
    for r in sorted(parts.groupBy("__part").count().collect()):  # one row for each partition
        offsets.append((r[0], at))
        at += r[1]
    offsets = spark.createDataFrame(offsets, "__part int, __before bigint")
    placed = parts.join(F.broadcast(offsets), "__part")
    numbered = placed.where(F.col("__before") < k).withColumn("rank", F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = placed.where(F.col("__before") >= k).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(rest).drop("__part", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_column: str = "doc_id", text: str = "text", target_id: str = "item_id") -> DataFrame:
    """Every document's id, n_features, weight, score and rank; rank is null unless the document is drawn.

    Drawn are floor(percent * N / 100) of the N documents with at least least_words words, by highest score, ties by
    smaller id.
    """
    spark, staging = docs.sparkSession, Staging()
    made = staging.put(features(docs, id_column, text, longest, buckets), "features")
    gain = gains(bucket_counts(made, buckets), bucket_counts(features(target, target_id, text, longest, buckets), buckets))
    sent = spark.sparkContext.broadcast(gain)
    scored = made.mapInArrow(_weighed(sent, buckets), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = staging.put(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(), F.col("__row").asc()]
    staging.drop(scored)
    ranked = top_ranks(able, order, k, staging)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.unionByName(rest)
    return out.select(F.col("doc_id").alias(id_column), "n_features", "weight", "score", "rank")
