"""Exact k nearest neighbours: blocks of vectors against queries, partial and final top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter
from nearfield.functions.distances import PAIRS, distances, pair_blocks, parse_metric, shortlist

#: Query values (numbers) that one broadcast holds at most; larger sets are dealt in blocks through a shuffle.
BROADCAST_VALUES = 4_000_000
BLOCK = 4096
#: Numbers of a chunk of vectors.
CHUNK_VALUES = 4_000_000
RESULT = "qid long, id long, distance double"


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances in order, ties to the smaller id."""
    if len(distance) > 4 * k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        return near[np.lexsort((ids[near], distance[near]))[:k]]
    return np.lexsort((ids, distance))[:k]


def best_of(found: DataFrame, k: int | None, per_query: DataFrame | None = None) -> DataFrame:
    """``qid, rank, id, distance``: the nearest of each query; ties go to the smaller id, NaN last."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if per_query is not None:
        ranked = ranked.join(per_query, "qid").where("rank <= k").drop("k")
    elif k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", "distance")


def _local(metric: str, ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int | None, limit: float | None) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = [[], [], []]
    if len(ids) and len(qids):
        for a in range(0, len(qids), 256):
            for q, near in enumerate(shortlist(metric, rows, queries[a : a + 256], len(ids) if k is None else k), a):
                d = distances(metric, rows[near], queries[q])
                if limit is not None:
                    near, d = near[d <= limit], d[d <= limit]
                if k is not None and len(near) > k:
                    best = np.lexsort((ids[near], d))[:k]
                    near, d = near[best], d[best]
                for o, x in zip(out, (np.full(len(near), qids[q]), ids[near], d), strict=True):
                    o.append(x)
    cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.RecordBatch.from_arrays([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], ["qid", "id", "distance"])


def knn(vectors: DataFrame, queries: DataFrame, k: int | None = 10, metric: str = "euclidean", max_distance: float | None = None, per_query_k: bool = False) -> DataFrame:
    """``vectors(id, embedding)`` against ``queries(qid, embedding[, k])`` -> ``qid, rank, id, distance``.

    Each block of vectors keeps ``k`` rows a query, so a shuffle moves ``blocks * k`` rows a query at
    most. Queries within ``BROADCAST_VALUES`` numbers are broadcast. More are dealt in blocks of that size, and
    vectors in chunks of that size: each vector is sent once for every block of queries, each query
    once for every chunk, so a task holds two bounded blocks whatever the tables' sizes. With ``k`` None it is a range search: all
    rows within ``max_distance``, however many.
    """
    metric = parse_metric(metric)
    if not per_query_k and k is None and max_distance is None:
        raise InvalidParameter("a search without k needs max_distance")
    if not per_query_k and k is not None and k < 1:
        raise InvalidParameter("k must be at least 1")
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    wanted = queries.select("qid", F.col("k").cast("int").alias("k")) if per_query_k else None
    if per_query_k:
        k = queries.agg(F.max("k")).first()[0] or 1
    queries = queries.select(F.col("qid").cast("long").alias("qid"), "embedding").where("embedding is not null")
    count, narrow, width = queries.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if narrow != width:
        raise DimensionMismatch(width, narrow)
    if count:  # the check is part of the scan, so a row of another length fails its task
        same = F.assert_true(F.size("embedding") == width, F.format_string(f"expected dimension {width}, got %d", F.size("embedding")))
        vectors = vectors.where(same.isNull())
    if count * (width or 1) <= BROADCAST_VALUES:
        rows = queries.collect()
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            step = 256 if k is None else max(1, len(qids))  # a range search may find every row
            for batch in batches:
                for a in range(0, len(qids), step):
                    yield _local(metric, batch.column("id").to_numpy(), matrix(batch.column("embedding")), qids[a : a + step], q[a : a + step], k, max_distance)

        return best_of(vectors.mapInArrow(run, RESULT), k, wanted)
    width = max(width or 1, 1)
    parts = -(-count // max(1, min(BLOCK, BROADCAST_VALUES // width)))
    chunks = max(1, vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() * width // CHUNK_VALUES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("chunk", deal("id", chunks)).withColumn("part", spread(parts))
    right = queries.withColumn("part", deal("qid", parts)).withColumn("chunk", spread(chunks))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        one = lambda t: matrix(t.column("embedding").combine_chunks())
        return pa.Table.from_batches([_local(metric, a.column("id").to_numpy(), one(a), b.column("qid").to_numpy(), one(b).astype(np.float64), k, max_distance)])

    found = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(both, RESULT)
    return best_of(found, k, wanted)


def in_rounds(queries: DataFrame, width: int, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scan`` of the queries, in parts of about ``BROADCAST_VALUES`` numbers where they hold more."""
    rounds = max(1, -(-queries.count() * max(1, width) // BROADCAST_VALUES))
    if rounds == 1:
        return scan(queries)
    found = [scan(queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r)) for r in range(rounds)]
    return reduce(DataFrame.union, found)


def all_pairs(vectors: DataFrame, queries: DataFrame, measures: dict[str, str], digits: int | None = None, strict: bool = False) -> DataFrame:
    """``qid, id`` and a column for each of ``measures`` (name: metric, or ``similarity``) for every pair of a query and a vector.

    Queries are broadcast, in rounds of at most ``BROADCAST_VALUES`` numbers; tasks make blocks of pairs. A vector that is null or
    holds a null has null distances, as vectors of different lengths have, unless ``strict`` makes those an error.
    """
    whole = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding").cast("array<double>")).alias("embedding"))
    vectors, names = whole(vectors, "id"), ["qid", "id", *measures]
    schema = "qid long, id long, " + ", ".join(f"`{n}` double" for n in measures)

    def scan(part: DataFrame) -> DataFrame:
        rows = whole(part, "qid").collect()
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), [None if r.embedding is None else np.array(r.embedding) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in pair_blocks(list(measures.values()), batch.column("id"), batch.column("embedding"), *shared.value, digits, strict):
                    yield pa.RecordBatch.from_arrays(block, names)

        return vectors.mapInArrow(run, schema)

    return in_rounds(queries, queries.agg(F.max(F.size("embedding"))).first()[0] or 1, scan)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``qid, recall``: how many of the first ``k`` true ids are among the first ``k`` found, over ``k``."""
    t = truth.where(F.col("rank") <= k).select("qid", "id").distinct()
    f = found.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    joined = t.join(f, ["qid", "id"], "left")
    return joined.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(k)).alias("recall"))
