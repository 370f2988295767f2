"""Length buckets with the least padding, and token-budget batches inside each.

A dynamic programme over the global histogram of lengths places the bucket boundaries. Every document then
has a place in its bucket from counts of small shards and its rank in one, so a bucket that holds a
third of all rows is still many groups, and batches are full but for the last of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACE, Scratch, text_blocks, word_bounds

#: Rows of a shard.
SHARD_ROWS = 4096


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding, from a histogram.

    Every distinct length is a candidate. Costs form a Monge array, so the best cut before a length never
    moves back as lengths grow, and halving the lengths gives each step in ``n * log(n)``.
    """
    lengths, at = np.unique(np.asarray(lengths, np.int64), return_inverse=True)
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    number = np.zeros(n, np.int64)
    np.add.at(number, at, np.asarray(counts, np.int64))
    exact = np.int64 if int(lengths[-1]) * int(number.sum()) < 1 << 61 else object  # whole numbers at every size
    top, number = np.append(0, lengths).astype(exact), np.append(0, number).astype(exact)
    rows, tokens = np.cumsum(number), np.cumsum(number * top)
    best, back = top * rows - tokens, []
    for k in range(1, min(buckets, n)):  # one more bucket never pads more
        best, cut = _step(best + tokens, top, rows, tokens, k)
        back.append(cut)
    out, j = [n], n
    for cut in reversed(back):
        j = int(cut[j])
        out.append(j)
    return lengths[np.array(out[::-1]) - 1]


def _step(before: np.ndarray, top: np.ndarray, rows: np.ndarray, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of lengths ``1..j`` for each ``j > least`` and the cut ``i`` it comes from, ``least <= i < j``."""
    n = len(top) - 1
    best, cut = np.zeros_like(before), np.zeros(n + 1, np.int32)
    a, b, lo, hi = (np.array([x]) for x in (least + 1, n, least, n - 1))
    while len(a):
        mid = (a + b) // 2
        size = np.minimum(hi, mid - 1) - lo + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) + np.repeat(lo - starts, size)
        total = before[i] - np.repeat(top[mid], size) * rows[i]
        least_of = np.minimum.reduceat(total, starts)
        hits = np.flatnonzero(total == np.repeat(least_of, size))
        first = i[hits[np.searchsorted(hits, starts)]]
        best[mid], cut[mid] = least_of + top[mid] * rows[mid] - tokens[mid], first
        a, b, lo, hi = (np.concatenate(x) for x in ((a, mid + 1), (mid - 1, b), (lo, first), (first, hi)))
        on = a <= b
        a, b, lo, hi = a[on], b[on], lo[on], hi[on]
        order = np.argsort(a)
        a, b, lo, hi = a[order], b[order], lo[order], hi[order]
    return best, cut


def word_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``length``: words and an end mark."""
    docs = docs.drop("length")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(word_bounds(data, at, SPACE)[2]) + 1, pa.int64())], [*names, "length"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("length", T.LongType())]))


def pack(docs: DataFrame, budget: int = 65_536, buckets: int = 16, length: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, length, bucket, batch, slot, padded``: bucket (upper bound of length), batch and place of every document.

    The length is column ``length`` (null or below 1: 1) or else words plus an end mark. A batch of bucket ``b``
    has ``max(1, budget // b)`` documents, so padded to ``b`` it keeps to the budget unless one
    document alone exceeds it. Batches are numbered from 0 in each bucket, in the order of a hash of
    the id. Null texts have length 1; rows with a null id and rows that repeat an id are packed like
    others. Further columns are ignored. An empty table gives an empty result.
    """
    if budget < 1 or buckets < 1:
        raise ValueError("budget and buckets must be positive")
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select("doc_id", F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)).alias("length")) if length else word_lengths(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "length")
    sized = scratch.save(source.select(F.col("doc_id").cast("long").alias("doc_id"), "length"), "lengths")
    top = boundaries(*_histogram(sized), buckets).tolist()
    bucket = F.element_at(F.filter(F.array(*(F.lit(x).cast("long") for x in top or [1])), lambda b: b >= F.col("length")), 1)
    placed = sized.withColumn("bucket", bucket)
    shards = placed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).alias("shards"))
    shards = {r.bucket: int(r.shards) for r in shards.collect()}  # one row a bucket
    number = F.element_at(F.create_map(*(F.lit(x) for b, n in shards.items() for x in (b, n))), F.col("bucket")) if shards else F.lit(1)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length"), number))
    count = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id"), "doc_id", "length")) - 1
    ranked = placed.withColumn("rank", rank).join(before, ["bucket", "shard"])
    place, size = F.col("before") + F.col("rank"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return ranked.select("doc_id", "length", "bucket", F.floor(place / size).cast("long").alias("batch"), F.pmod(place, size).cast("long").alias("slot"), (F.col("bucket") - F.col("length")).alias("padded"))


def _histogram(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths and their counts; ``n`` lengths of words take texts of ``n * n / 2`` words, so they are few."""
    found = sized.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    return found.column("length").to_numpy(), found.column("n").to_numpy()
