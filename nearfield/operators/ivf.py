"""Inverted file of full vectors: cells from k-means, probes by squared L2, scores by the metric."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyIndex, InvalidParameter
from nearfield.functions.distances import parse_metric

from . import kmeans
from .topk import BROADCAST_VALUES, RESULT, _local, best_of, matrix

#: Rows of a cell in one block; larger cells are dealt to several.
CELL_ROWS = 100_000


#: Takes a cell, its rows (Arrow columns by name), query ids and query vectors; gives query ids, row ids and distances.
Local = Callable[[int, dict[str, pa.Array], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    cat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
    return [pa.array(x.astype(kind)) for x, kind in zip(cat, (np.int64, np.int64, np.float64), strict=True)]


def best_rows(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each query."""
    qid, id, d = found
    order = np.lexsort((id, d, qid))
    qid, id, d = qid[order], id[order], d[order]
    head = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.zeros(0, np.int64)
    rank = np.arange(len(qid)) - np.repeat(head, np.diff(np.append(head, len(qid))))
    return qid[rank < k], id[rank < k], d[rank < k]


def scan_cells(cells: DataFrame, probes: DataFrame, local: Local, columns: list[str], k: int) -> DataFrame:
    """``qid, id, distance`` of the rows of the cells that each query probes (``probes(qid, embedding, cell)``).

    Probes within ``BROADCAST_VALUES`` numbers are broadcast: tasks read the probed cells where they lie and send ``k`` rows
    a query. More meet the probed cells in a shuffle, in blocks of bounded size; other cells never move.
    """
    spark = cells.sparkSession
    count, width = probes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if count * max(width or 1, k) <= BROADCAST_VALUES:
        asked: dict[int, tuple[list, list]] = {}
        for r in probes.select("cell", "qid", "embedding").collect():
            own = asked.setdefault(r.cell, ([], []))
            own[0].append(r.qid)
            own[1].append(r.embedding)
        shared = spark.sparkContext.broadcast({c: (np.array(q, np.int64), np.array(v, np.float64)) for c, (q, v) in asked.items()})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for batch in batches:
                own = batch.column("cell").to_numpy()
                order = np.argsort(own, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else ():
                    cell = int(own[group[0]])
                    take = pa.array(group)
                    held.append(local(cell, {c: batch.column(c).take(take) for c in columns}, *shared.value[cell]))
                    rows += len(held[-1][0])
                if rows > 4 * count * k:
                    held = [best_rows(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                    rows = len(held[0][0])
            if held:
                held = [best_rows(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)]
            yield pa.RecordBatch.from_arrays(_found(held), ["qid", "id", "distance"])

        probed = cells.where(F.col("cell").isin(sorted(asked)) if asked else F.lit(False))
        return probed.select("cell", *columns).mapInArrow(scan, RESULT)

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            rows = {c: a.column(c).combine_chunks() for c in columns}
            parts.append(local(key[0].as_py(), rows, b.column("qid").to_numpy(), matrix(b.column("embedding").combine_chunks()).astype(np.float64)))
        return pa.table(dict(zip(("qid", "id", "distance"), _found(parts), strict=True)))

    cells = cells.join(F.broadcast(probes.select("cell").distinct()), "cell", "left_semi")
    size = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("blocks"))
    left = cells.join(F.broadcast(size), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = probes.join(F.broadcast(size), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "block"]
    return left.select(*keys, *columns).groupBy(*keys).cogroup(right.select(*keys, "qid", "embedding").groupBy(*keys)).applyInArrow(meet, RESULT)


class IvfIndex:
    """``cells(cell, id, embedding)`` and the centres; build with :meth:`build`."""

    def __init__(self, centres: np.ndarray, cells: DataFrame, metric: str, nprobe: int = 1):
        self.centres, self.cells, self.metric = centres, cells, parse_metric(metric)
        self.nprobe = self.clamped(nprobe)

    @classmethod
    def build(cls, vectors: DataFrame, n_clusters: int, metric: str = "euclidean", rounds: int = 100, init: str = "auto", seed: int = 0, nprobe: int = 1) -> IvfIndex:
        centres = kmeans.fit(vectors, n_clusters, rounds, init, seed)
        return cls(centres, kmeans.assign(vectors, centres).select("cell", "id", "embedding"), metric, nprobe)

    def clamped(self, nprobe: int) -> int:
        if nprobe < 1:
            raise InvalidParameter("nprobe must be at least 1")
        return min(nprobe, len(self.centres))

    def set_nprobe(self, nprobe: int) -> None:
        self.nprobe = self.clamped(nprobe)

    @property
    def dimension(self) -> int:
        return self.centres.shape[1] if len(self.centres) else 0

    @property
    def n_partitions(self) -> int:
        return len(self.centres)

    def count(self) -> int:
        return self.cells.count()

    def is_empty(self) -> bool:
        return self.cells.isEmpty()

    def sizes(self) -> DataFrame:
        """``cell, n`` of every cell, empty ones included."""
        every = self.cells.sparkSession.range(len(self.centres)).select(F.col("id").cast("int").alias("cell"))
        return every.join(self.cells.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))

    def batch_search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, max_distance: float | None = None) -> DataFrame:
        """``qid, rank, id, distance``."""
        if k < 1:
            raise InvalidParameter("k must be at least 1")
        metric = self.metric
        probes = kmeans.assign(queries, self.centres, self.clamped(nprobe or self.nprobe), "qid")

        def local(cell: int, rows: dict[str, pa.Array], qids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = _local(metric, rows["id"].to_numpy(), matrix(rows["embedding"]), qids, q, k, max_distance)
            return tuple(found.column(i).to_numpy() for i in range(3))

        return best_of(scan_cells(self.cells, probes, local, ["id", "embedding"], k), k)

    def search(self, query: list[float], k: int = 10, nprobe: int | None = None) -> DataFrame:
        """One query; its probes are known on the driver, so other cells are filtered out of the scan (a snapshot is sorted by cell)."""
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        if not len(self.centres):
            raise EmptyIndex("no cells")
        near = kmeans.cells_of(np.array([query], np.float64), self.centres, self.clamped(nprobe or self.nprobe))[0]
        one = IvfIndex(self.centres, self.cells.where(F.col("cell").isin([int(c) for c in near])), self.metric, len(near))
        return one.batch_search(query_frame(self.cells.sparkSession, query), k).drop("qid")


def query_frame(spark, query: list[float]) -> DataFrame:
    return spark.createDataFrame([(0, [float(x) for x in query])], "qid long, embedding array<double>")
