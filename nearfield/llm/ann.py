"""Nearest neighbours by largest inner product with an adaptive dimension scan.

Vectors get one more dimension that makes all of them equally long, so the largest inner product is the
smallest distance; a random rotation spreads each vector evenly over its dimensions, and an
inverted file of k-means lists holds them. Within a probed list, distances grow by blocks of
columns; after each block a hypothesis test (is the full distance, judged by the dimensions seen
so far, above the query's bound?) abandons most candidates early. Bounds come from a first scan of
the list nearest to each query. What survives is scored in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch

#: Rows that fit lists and rotation at most, and rows of a list or queries in one block.
SAMPLE_ROWS, CHUNK_ROWS, CHUNK_QUERIES = 20_000, 8192, 4096
COLUMN_BLOCK, EPSILON = 16, 2.1


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Model:
    """Rotation, length of the extended vectors, and list centres, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        self.longest = longest * (1 + 1e-6)
        x = self.extended(sample)
        self.centres = x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(10):
            near = self.nearest(x, 1)[:, 0]
            total = np.zeros((len(self.centres), d))
            np.add.at(total, near, x)
            count = np.bincount(near, minlength=len(self.centres))
            self.centres[count > 0] = (total[count > 0] / count[count > 0, None]).astype(np.float32)

    def extended(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the extra dimension, which is zero for queries; queries are scaled to the common length."""
        size = np.einsum("ij,ij->i", x, x)
        if query:
            x = x * (self.longest / np.sqrt(size))[:, None]
            extra = np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(self.longest**2 - size, 0))
        return np.concatenate([x, extra[:, None]], axis=1).astype(np.float32) @ self.rotation

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """Lists by distance from each row."""
        d = (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)
        if count == 1:
            return d.argmin(axis=1)[:, None]
        part = np.argpartition(d, count - 1, axis=1)[:, :count] if count < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(x), 1))
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(axis=1, kind="stable"), 1)

    def probes(self, sample: np.ndarray, k: int, aim: float, seed: int = 3) -> int:
        """How many lists a query needs for ``aim`` of its neighbours, measured on the sample."""
        queries = sample[np.random.default_rng(seed).permutation(len(sample))[:200]]
        rows, asked = self.extended(sample), self.extended(queries, True)
        of = self.nearest(rows, 1)[:, 0]
        order = self.nearest(asked, len(self.centres))
        k = min(k, len(sample))
        best = np.argpartition(-(queries @ sample.T), k - 1, axis=1)[:, :k]
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        needed = np.sort(np.take_along_axis(rank, of[best], 1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1


def scan(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, epsilon: float = EPSILON, block: int = COLUMN_BLOCK) -> Iterator[np.ndarray]:
    """For each query, the rows whose squared distance is not found to be above its bound."""
    d = rows.shape[1]
    first = slice(0, block)
    head = (rows[:, first] ** 2).sum(axis=1)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        start = head + (q[:, first] ** 2).sum(axis=1)[:, None] - 2 * (q[:, first] @ rows[:, first].T)
        for i in range(len(q)):
            limit = bounds[a + i] * (1 + 1e-5) + 1e-6
            seen = min(block, d)
            alive = np.flatnonzero(start[i] <= limit * (seen / d) * (1 + epsilon / np.sqrt(seen)) ** 2) if seen < d else np.arange(len(rows))
            partial = start[i, alive]
            while seen < d and len(alive):
                more = slice(seen, min(seen + block, d))
                partial = partial + ((rows[alive, more] - q[i, more]) ** 2).sum(axis=1)
                seen = more.stop
                scale = (seen / d) * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < d else 1.0
                keep = partial <= limit * min(scale, 1.0 if seen == d else scale)
                alive, partial = alive[keep], partial[keep]
            yield alive


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", lists: int | None = None, aim: float = 0.985, scratch: Scratch | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose id is divisible by ``every``, the ``k`` rows with the largest inner product.

    A row is no candidate of its own query; ties go to the smaller id; if fewer than ``k`` candidates
    are found, all are returned. Rows with a null id, a null or zero vector, or null or non-finite components
    take no part. Vectors of different lengths have no inner product: each length is searched on its own.
    Rows that repeat an id are separate candidates; as queries they share one ranking, which holds
    the best of either (a candidate once for each pair). Further columns are ignored; an empty table, or one with a single valid row, gives
    an empty result.

    Rotation and lists are fitted on at most ``SAMPLE_ROWS`` rows, and so is the number of probed lists (the
    fewest that hold ``aim`` of the sample's true neighbours); every row is indexed. Lists are dealt
    to chunks of about ``CHUNK_ROWS`` rows and queries to blocks, so a list that holds a third of all rows is
    many groups.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    scratch = scratch or Scratch(vectors.sparkSession)
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    source = source.where(finite & F.exists("x", lambda v: v != 0))
    result = "query_id long, rank int, vec_id long, score double"
    sizes = sorted(tuple(r) for r in source.groupBy(F.size("x").alias("d")).count().collect())  # few: one row a length
    found = [_nearest_of_length(source.where(F.size("x") == d), d, n, k, every, lists, aim, scratch) for d, n in sizes]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], result)


def _nearest_of_length(source: DataFrame, d: int, n: int, k: int, every: int, lists: int | None, aim: float, scratch: Scratch) -> DataFrame:
    spark = source.sparkSession
    longest = source.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0] ** 0.5
    share = min(1.0, 0.9 * SAMPLE_ROWS / n)
    drawn = source.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_ROWS).select("x") if share < 1 else source.select("x")
    sample = np.array([r.x for r in drawn.toLocalIterator()], np.float64).reshape(-1, d)
    lists = lists or max(1, min(4096, round(n**0.5), len(sample) // 4 or 1))
    model = Model(sample, longest, min(lists, len(sample)))
    probed = model.probes(sample, k, aim)
    shared = spark.sparkContext.broadcast(model)  # at most 4096 centres and a square matrix

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            near = shared.value.nearest(shared.value.extended(x), 1)[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(near, pa.int32())], ["id", "x", "list"])

    rows = scratch.save(source.mapInArrow(assign, "id long, x array<double>, list int"), f"rows-{d}")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            near = shared.value.nearest(shared.value.extended(x, True), min(probed, len(shared.value.centres)))
            take = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("x").take(take), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(near.shape[1]), len(x)), pa.int32())], ["id", "x", "list", "nth"])

    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "x").mapInArrow(choose, "id long, x array<double>, list int, nth int")
    asked = scratch.save(asked, f"probes-{d}")

    def blocks(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        chunks = rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)).cast("int").alias("chunks"))
        parts = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(CHUNK_QUERIES)).cast("int").alias("parts"))
        plan = chunks.join(parts, "list")
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.join(plan, "list").withColumn("chunk", deal("chunks")).withColumn("part", every_one("parts"))
        right = asked.join(plan, "list").withColumn("part", deal("parts")).withColumn("chunk", every_one("chunks"))
        return left.select("list", "chunk", "part", "id", "x"), right.select("list", "chunk", "part", "id", "x", "bound")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("id").to_numpy(), right.column("id").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(qids):
            x, q = _matrix(left.column("x").combine_chunks()), _matrix(right.column("x").combine_chunks())
            longest = shared.value.longest
            # a score of b means a squared distance of 2 L^2 - 2 L b / |q| from the scaled query
            bound = right.column("bound").to_numpy(zero_copy_only=False).astype(float)
            limits = np.where(np.isnan(bound), np.inf, 2 * longest**2 - 2 * longest * bound / np.sqrt((q * q).sum(axis=1)))
            for i, alive in enumerate(scan(shared.value.extended(q, True), shared.value.extended(x), limits)):
                alive = alive[ids[alive] != qids[i]]
                score = np.einsum("ij,j->i", x[alive], q[i])  # equal rows give equal sums
                if len(alive) > k:
                    best = np.lexsort((ids[alive], -score))[:k]
                    alive, score = alive[best], score[best]
                for o, v in zip(out, (np.full(len(alive), qids[i]), ids[alive], score), strict=True):
                    o.append(v)
        cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    def probe_all(asked: DataFrame) -> DataFrame:
        left, right = blocks(asked)
        keys = ["list", "chunk", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(probe, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = scratch.save(top(probe_all(asked.where("nth = 0").withColumn("bound", F.lit(None).cast("double")))), f"first-{d}")
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    later = asked.where("nth > 0").join(bounds, asked.id == bounds.query_id, "left").drop("query_id")
    found = first.drop("rank").union(probe_all(later))
    return top(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
