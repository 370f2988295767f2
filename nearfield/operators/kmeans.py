"""Lloyd's k-means with seeded starts; rows stay on the executors, centres on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyTrainingSet, InsufficientVectors, InvalidParameter

from .topk import matrix

PLUS_PLUS_MAX = 64
#: Numbers of one matrix of distances.
MATRIX_VALUES = 4_000_000
CONVERGED = 0.001
#: Sums of tasks are added in two steps, the first of so many groups a cell.
TASKS_AT_ONCE = 32


def _exact_cells(rows: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    d = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1) if len(centres) else np.zeros((len(rows), 0))
    return np.argsort(d, axis=1, kind="stable")[:, :count]


def cells_of(rows: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Nearest cells by squared distance, ties to the lower cell.

    One matrix product ranks the cells; rows whose choice its rounding could change are done again by
    differences. Rows are taken in chunks, so a matrix holds at most ``MATRIX_VALUES`` numbers.
    """
    rows, centres = np.asarray(rows, np.float64), np.asarray(centres, np.float64)
    k, count = len(centres), min(count, len(centres))
    if k <= 8 or count > k // 2:
        return _exact_cells(rows, centres, count)
    size, out = (centres**2).sum(axis=1), np.empty((len(rows), count), np.int64)
    step = max(1, MATRIX_VALUES // k)
    for a in range(0, len(rows), step):
        x = rows[a : a + step]
        score = size - 2 * (x @ centres.T)
        margin = 1e-12 * (size.max(initial=0) + np.einsum("ij,ij->i", x, x)) * max(8, x.shape[1])
        if count == 1:
            best = score.argmin(axis=1)[:, None]
            unsure = (score <= np.take_along_axis(score, best, 1) + margin[:, None]).sum(axis=1) > 1
        else:
            near = np.argpartition(score, count, axis=1)[:, : count + 1]
            order = np.take_along_axis(score, near, 1).argsort(axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            unsure = (np.diff(np.take_along_axis(score, near, 1), axis=1) <= margin[:, None]).any(axis=1)
            best = near[:, :count]
        unsure |= ~np.isfinite(score).all(axis=1)
        if unsure.any():
            best[unsure] = _exact_cells(x[unsure], centres, count)
        out[a : a + step] = best
    return out


def cell_sums(rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows of each cell."""
    order = np.argsort(own, kind="stable")
    n, sums = np.bincount(own, minlength=k), np.zeros((k, rows.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(rows[order], (np.cumsum(n) - n)[some], axis=0)
    return sums, n


def start(rows: np.ndarray, k: int, init: str = "auto", seed: int = 0) -> np.ndarray:
    """``first`` rows, a ``random`` choice, ``plus_plus``, or by size (``auto``); always exactly ``k`` centres."""
    if len(rows) < k:
        raise InsufficientVectors(f"{k} cells need as many vectors; there are {len(rows)}")
    init = ("plus_plus" if k <= PLUS_PLUS_MAX else "random") if init == "auto" else init
    rng = np.random.default_rng(seed)
    if init == "first":
        return rows[:k].astype(np.float64)
    if init == "random":
        return rows[rng.permutation(len(rows))[:k]].astype(np.float64)
    if init != "plus_plus":
        raise InvalidParameter(f"unknown start {init!r}")
    picked = [int(rng.integers(len(rows)))]
    near = ((rows - rows[picked[0]]) ** 2).sum(axis=1).astype(np.float64)
    while len(picked) < k:
        p = int(rng.choice(len(rows), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(rows)))
        picked.append(p)
        near = np.minimum(near, ((rows - rows[p]) ** 2).sum(axis=1))
    return rows[picked].astype(np.float64)


def fit_local(rows: np.ndarray, k: int, rounds: int = 100, init: str = "auto", seed: int = 0, converged: float = CONVERGED) -> np.ndarray:
    """On one block (a bounded sample); an empty cell keeps its centre."""
    rows = rows.astype(np.float64)
    centres = start(rows, k, init, seed)
    for _ in range(rounds):
        sums, n = cell_sums(rows, cells_of(rows, centres)[:, 0], k)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        moved = ((new - centres) ** 2).sum() / k
        centres = new
        if moved < converged:
            break
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, count: int = 1, key: str = "id") -> DataFrame:
    """``vectors`` with ``cell`` (and ``nth``, from 0): one row for each of the ``count`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = [key, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = cells_of(matrix(batch.column("embedding")).astype(np.float64), shared.value, count) if batch.num_rows else np.zeros((0, 1), int)
            take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(near.shape[1]), batch.num_rows), pa.int32())], [*names, "cell", "nth"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select(F.col(key).cast("long").alias(key), "embedding").mapInArrow(run, f"{key} long, embedding {kind}, cell int, nth int")


def drawn(vectors: DataFrame, count: int, init: str, seed: int) -> np.ndarray:
    """At most ``count`` rows: the smallest ids for the start ``first``, else the smallest hashes of the id."""
    order = ["id"] if init == "first" else [F.xxhash64("id", F.lit(seed)), "id"]
    # as Arrow: a collect would send up to ``count`` rows of each task to the driver, and make an object of each number
    rows = vectors.orderBy(*order).limit(count).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(rows):
        raise EmptyTrainingSet("no vectors")
    width = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if width.min() != width.max():
        raise DimensionMismatch(int(width.max()), int(width.min()))
    return matrix(rows).astype(np.float64)


def summed(vectors: DataFrame, cells: int, width: int, local: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of all rows by cell, as ``local`` gives them for a block of rows, in one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((cells, width)), np.zeros(cells, np.int64)
        for batch in batches:
            rows = matrix(batch.column("embedding")).astype(np.float64)
            if len(rows):
                more, count = local(rows)
                sums += more
                n += count
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(sums[some]), pa.list_(pa.float64())), pa.array(n[some])], ["cell", "total", "n"])

    sums, n = np.zeros((cells, width)), np.zeros(cells, np.int64)
    parts = vectors.select("embedding").mapInArrow(run, "cell int, total array<double>, n long")
    zero = F.array_repeat(F.lit(0.0), width)
    add = lambda x: F.aggregate(F.collect_list(x), zero, lambda s, y: F.zip_with(s, y, lambda p, q: p + q))
    some = parts.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(TASKS_AT_ONCE))).groupBy("cell", "task").agg(add("total").alias("total"), F.sum("n").alias("n"))
    for r in some.groupBy("cell").agg(add("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[r.cell], n[r.cell] = r.total, r.n
    return sums, n


def fit(vectors: DataFrame, k: int, rounds: int = 100, init: str = "auto", seed: int = 0, converged: float = CONVERGED, sample_rows: int = 30_000) -> np.ndarray:
    """Centres fitted on all rows: a round is one job, whose tasks add up their rows by cell; Spark adds the sums of
    tasks, and the driver gets ``k`` rows.

    Starts are chosen on at most ``sample_rows`` rows (the smallest ids, or the smallest hashes of the id).
    """
    if k < 1:
        raise InvalidParameter("k must be at least 1")
    centres = start(drawn(vectors, k if init == "first" else sample_rows, init, seed), k, init, seed)
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centres)
        sums, n = summed(vectors, *centres.shape, lambda rows, shared=shared: cell_sums(rows, cells_of(rows, shared.value)[:, 0], k))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        moved = ((new - centres) ** 2).sum() / k
        centres = new
        if moved < converged:
            break
    return centres
