"""Inverted file of product-quantized residuals, with filters, re-ranking, updates, statistics and checks."""

from __future__ import annotations

import math
import threading
import time
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, DimensionNotDivisible, EmptyIndex, EmptyTrainingSet, InvalidParameter, MemoryLimitExceeded, SearchTimeout, VectorLimitExceeded
from nearfield.functions.distances import distance, parse_metric

from . import kmeans
from .ivf import IvfIndex, query_frame, scan_cells
from .pq import ProductQuantizer, residuals
from .topk import best_of, matrix, nearest

MAX_VECTORS, MAX_BYTES = 100_000_000, 8 << 30
FILTER_OVERSAMPLING = 4
#: Rows of a short list (two numbers each) that is broadcast for re-ranking at most.
SHORTLIST_ROWS = 1_000_000
#: Training rows a cell that samples hold at least.
ROWS_A_CELL = 4


@dataclass(frozen=True)
class SearchConfig:
    """One entry point for a search: ``k``, a filter on metadata, a greatest distance, seconds of time."""

    k: int = 10
    nprobe: int | None = None
    filter: Column | None = None
    max_distance: float | None = None
    timeout: float | None = None


@dataclass(frozen=True)
class IvfPqIndex:
    """Centres, quantizer, ``cells(cell, id, codes)``, ``tombstones(id)`` and, for re-ranking, ``originals(id, embedding)``.

    Distances are L2 (square roots with and without re-ranking); re-ranking uses the index's metric.
    An index does not change: updates give a new one.
    """

    centres: np.ndarray
    pq: ProductQuantizer
    cells: DataFrame
    originals: DataFrame | None = None
    tombstones: DataFrame | None = None
    metric: str = "euclidean"
    nprobe: int = 1
    rerank_factor: int = 1
    parameters: dict = field(default_factory=dict)

    @classmethod
    def build(cls, vectors: DataFrame, n_clusters: int, m: int, bits: int = 8, metric: str = "euclidean", nprobe: int = 1, rerank_factor: int = 1, keep_originals: bool = True, init: str = "auto", seed: int = 0, rounds: int = 25, pq_rounds: int = 25, sample_rows: int | None = 30_000, pq_sample_rows: int | None = 100_000) -> IvfPqIndex:
        """Centres from at most ``sample_rows`` rows (``ROWS_A_CELL`` for each cell if those are more), the quantizer from at most
        ``pq_sample_rows`` residuals, everything encoded. Without a bound (None) they are fitted on all rows, a job a round.
        """
        vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding")
        most = None if sample_rows is None else max(sample_rows, ROWS_A_CELL * n_clusters)
        bounds = [x for x in (most, pq_sample_rows) if x is not None]
        sample = kmeans.drawn(vectors, max(bounds), init, seed) if bounds else None
        centres = kmeans.fit(vectors, n_clusters, rounds, init, seed) if most is None else kmeans.fit_local(sample[:most], n_clusters, rounds, init, seed)
        if pq_sample_rows is None:
            pq = ProductQuantizer.fit(vectors, m, bits, pq_rounds, init, seed, centres)
        else:
            pq = ProductQuantizer.train(residuals(sample[:pq_sample_rows], centres), m, bits, pq_rounds, init, seed)
        made = {"n_clusters": n_clusters, "m": m, "bits": bits, "init": init, "seed": seed, "rounds": rounds, "pq_rounds": pq_rounds, "sample_rows": sample_rows, "pq_sample_rows": pq_sample_rows}
        index = cls(centres, pq, _encoded(vectors, centres, pq), vectors if keep_originals else None, None, parse_metric(metric), 1, max(1, rerank_factor), made)
        return index.with_nprobe(nprobe)

    def with_nprobe(self, nprobe: int) -> IvfPqIndex:
        return replace(self, nprobe=self._clamped(nprobe))

    def with_reranking(self, factor: int) -> IvfPqIndex:
        return replace(self, rerank_factor=max(1, factor))

    def _clamped(self, nprobe: int) -> int:
        if nprobe < 1:
            raise InvalidParameter("nprobe must be at least 1")
        return min(nprobe, len(self.centres))

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    @property
    def n_partitions(self) -> int:
        return len(self.centres)

    def live(self) -> DataFrame:
        return self.cells if self.tombstones is None else self.cells.join(self.tombstones, "id", "left_anti").select("cell", "id", "codes")

    def count(self) -> int:
        return self.live().count()

    def count_with_tombstones(self) -> int:
        return self.cells.count()

    def num_tombstones(self) -> int:
        return 0 if self.tombstones is None else self.cells.join(self.tombstones, "id", "left_semi").count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def fragmentation_ratio(self) -> float:
        """Tombstones over live rows (infinite if none live)."""
        gone, live = self.num_tombstones(), self.count()
        return gone / live if live else (math.inf if gone else 0.0)

    def batch_search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, metadata: DataFrame | None = None, condition: Column | None = None, max_distance: float | None = None) -> DataFrame:
        """``qid, rank, id, distance``. A ``condition`` on ``metadata(id, ...)`` limits candidates before they are scored; ids without metadata never match."""
        if k < 1:
            raise InvalidParameter("k must be at least 1")
        reranked = self.originals is not None and self.rerank_factor > 1
        small = reranked and queries.count() * self._fetch(k, condition) <= SHORTLIST_ROWS
        if reranked and not small and self._fetch(k, condition) >= self.count():
            return self._exact(queries, k, nprobe, metadata, condition, max_distance)
        found = best_of(self._scored(queries, nprobe, metadata, condition, k), self._fetch(k, condition))
        if reranked:
            asked = queries.select("qid", F.col("embedding").alias("query"))
            near = found.select("qid", "id")
            if small:  # the short list goes to the originals, which stay where they lie
                near = F.broadcast(near)
            near = self.originals.join(near, "id").join(asked, "qid")
            found = near.select("qid", "id", distance(self.metric, F.col("embedding"), F.col("query")).alias("distance"))
        if max_distance is not None:
            found = found.where(F.col("distance") <= max_distance)
        return best_of(found, k)

    def _exact(self, queries: DataFrame, k: int, nprobe: int | None, metadata: DataFrame | None, condition: Column | None, max_distance: float | None) -> DataFrame:
        """What re-ranking gives where the short list holds every row of the probed cells, without making that list."""
        cells = self._candidates(metadata, condition).select("cell", "id").join(self.originals, "id").select("cell", "id", "embedding")
        return IvfIndex(self.centres, cells, self.metric).batch_search(queries, k, self._clamped(nprobe or self.nprobe), max_distance)

    def _candidates(self, metadata: DataFrame | None, condition: Column | None) -> DataFrame:
        if condition is None:
            return self.live()
        if metadata is None:
            raise InvalidParameter("a condition needs metadata")
        return self.live().join(metadata.where(condition).select("id"), "id", "left_semi").select("cell", "id", "codes")

    def _fetch(self, k: int, condition: Column | None) -> int:
        factor = self.rerank_factor if self.originals is not None else 1
        return k * factor * (FILTER_OVERSAMPLING if condition is not None and factor > 1 else 1)

    def _scored(self, queries: DataFrame, nprobe: int | None, metadata: DataFrame | None, condition: Column | None, k: int) -> DataFrame:
        cells = self._candidates(metadata, condition)
        shared = cells.sparkSession.sparkContext.broadcast((self.centres, self.pq))
        fetch = self._fetch(k, condition)
        probes = kmeans.assign(queries, self.centres, self._clamped(nprobe or self.nprobe), "qid")

        def local(cell: int, rows: dict[str, pa.Array], qids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            centres, pq = shared.value
            codes, ids, out = pq.places(pq.loaded(rows["codes"])), rows["id"].to_numpy(), []
            for qid, q in zip(qids, queries, strict=True):
                d = pq.looked_up(pq.table(q - centres[cell]), codes)
                best = nearest(d, ids, fetch)
                out.append((np.full(len(best), qid), ids[best], np.sqrt(d[best])))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return scan_cells(cells, probes, local, ["id", "codes"], fetch)

    def search(self, query: list[float], config: SearchConfig | None = None, metadata: DataFrame | None = None) -> DataFrame:
        """One query. With a timeout the result is computed at once, or :class:`SearchTimeout` is raised."""
        config = config or SearchConfig()
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        near = kmeans.cells_of(np.array([query], np.float64), self.centres, self._clamped(config.nprobe or self.nprobe))[0]
        one = replace(self, cells=self.cells.where(F.col("cell").isin([int(c) for c in near])), nprobe=len(near))
        found = one.batch_search(query_frame(self.cells.sparkSession, query), config.k, len(near), metadata, config.filter, config.max_distance).drop("qid")
        return found if config.timeout is None else _within(found, config.timeout)

    def search_stats(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """``qid, cells_probed, vectors_scanned, distance_computations, reranked``; times: :meth:`timed_search`."""
        probes = kmeans.assign(queries, self.centres, self._clamped(nprobe or self.nprobe), "qid").select("qid", "cell")
        sizes = self.live().groupBy("cell").agg(F.count("*").alias("n"))
        seen = probes.join(sizes, "cell", "left").groupBy("qid").agg(F.count("*").alias("cells_probed"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors_scanned"))
        again = F.least("vectors_scanned", F.lit(self._fetch(k, None))) if self.originals is not None and self.rerank_factor > 1 else F.lit(0)
        return seen.select("qid", "cells_probed", "vectors_scanned", F.col("vectors_scanned").alias("distance_computations"), again.cast("long").alias("reranked"))

    def timed_search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> tuple[DataFrame, dict[str, float]]:
        """The result, computed, and a summary over the queries: milliseconds in all and a query, means of the counts."""
        begin = time.perf_counter()
        found = self.batch_search(queries, k, nprobe)
        rows = found.collect()  # k rows a query
        spent = 1000 * (time.perf_counter() - begin)
        s = self.search_stats(queries, k, nprobe).agg(F.count("*").alias("queries"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("cells_probed", "vectors_scanned", "distance_computations", "reranked"))).first().asDict()
        return self.cells.sparkSession.createDataFrame(rows, found.schema), s | {"total_ms": spent, "ms_a_query": spent / max(1, s["queries"])}

    def insert(self, rows: DataFrame) -> IvfPqIndex:
        """With new rows under the present model; the last write of an id wins and revives it."""
        rows = rows.select(F.col("id").cast("long").alias("id"), "embedding")
        ids = rows.select("id").distinct()
        cells = self.cells.join(ids, "id", "left_anti").select("cell", "id", "codes").unionByName(_encoded(rows, self.centres, self.pq))
        originals = None if self.originals is None else self.originals.join(ids, "id", "left_anti").unionByName(rows)
        gone = None if self.tombstones is None else self.tombstones.join(ids, "id", "left_anti")
        return replace(self, cells=cells, originals=originals, tombstones=gone)

    def delete(self, ids: DataFrame) -> IvfPqIndex:
        """Tombstones for ``ids`` that the index has."""
        new = self.cells.select("id").join(ids.select("id"), "id", "left_semi").distinct()
        originals = None if self.originals is None else self.originals.join(ids.select("id"), "id", "left_anti")
        return replace(self, tombstones=new if self.tombstones is None else self.tombstones.union(new).distinct(), originals=originals)

    def add(self, rows: DataFrame) -> IvfPqIndex:
        """:meth:`insert` after a check of the dimension."""
        odd = rows.where(F.size("embedding") != self.dimension).select(F.size("embedding").alias("d")).first()
        if odd:
            raise DimensionMismatch(self.dimension, odd.d)
        return self.insert(rows)

    def remove(self, ids: DataFrame) -> IvfPqIndex:
        return self.delete(ids)

    def compact(self) -> IvfPqIndex:
        return replace(self, cells=self.live(), tombstones=None)

    def rebuild(self) -> IvfPqIndex:
        """A new model from the originals, with the same parameters."""
        if self.originals is None or self.originals.isEmpty():
            raise EmptyIndex("no originals to rebuild from")
        p = self.parameters
        return IvfPqIndex.build(self.originals, p["n_clusters"], p["m"], p["bits"], self.metric, self.nprobe, self.rerank_factor, True, p["init"], p["seed"], p["rounds"], p["pq_rounds"], p.get("sample_rows", 30_000), p.get("pq_sample_rows", 100_000))

    def cell_sizes(self) -> DataFrame:
        """``cell, n`` of every cell; live rows."""
        every = self.cells.sparkSession.range(len(self.centres)).select(F.col("id").cast("int").alias("cell"))
        return every.join(self.live().groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))

    def stats(self) -> DataFrame:
        """One row: counts, cell sizes, bytes, compression and both fragmentation measures."""
        gone = self.num_tombstones()
        s = self.cell_sizes().agg(F.sum("n").alias("n_vectors"), F.count("*").alias("n_partitions"), F.sum((F.col("n") == 0).cast("long")).alias("empty_partitions"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"))
        size = F.col("n_vectors") * F.lit(self.pq.bytes_per_vector + 8) + F.lit(self.centres.size * 4 + self.pq.books.size * 4)
        if self.originals is not None:
            size = size + F.col("n_vectors") * F.lit(self.dimension * 4 + 8)
        live = F.col("n_vectors")
        return s.select("*", F.lit(gone).cast("long").alias("n_tombstones"), size.cast("long").alias("memory_bytes"), F.lit(self.dimension * 4 / self.pq.bytes_per_vector).alias("compression_ratio"), F.when(live > 0, F.lit(gone) / live).otherwise(F.lit(math.inf if gone else 0.0)).alias("tombstones_per_live"), F.when(live + gone > 0, F.lit(gone) / (live + gone)).otherwise(F.lit(0.0)).alias("tombstones_per_row"))

    def check_limits(self, max_vectors: int = MAX_VECTORS, max_bytes: int = MAX_BYTES) -> None:
        row = self.stats().first()
        if row.memory_bytes > max_bytes:
            raise MemoryLimitExceeded(f"{row.memory_bytes} bytes; the limit is {max_bytes}")
        if row.n_vectors > max_vectors:
            raise VectorLimitExceeded(f"{row.n_vectors} vectors; the limit is {max_vectors}")

    def validate(self) -> DataFrame:
        """``check, violations``."""
        width = F.octet_length("codes") != self.pq.bytes_per_vector
        checks = [("code length", self.cells.where(width)), ("cell range", self.cells.where((F.col("cell") < 0) | (F.col("cell") >= len(self.centres)))), ("repeated id", self.live().groupBy("id").count().where("count > 1"))]
        if self.tombstones is not None:
            checks.append(("tombstone without row", self.tombstones.join(self.cells, "id", "left_anti")))
        if self.originals is not None:
            checks.append(("original's dimension", self.originals.where(F.size("embedding") != self.dimension)))
        rows = [x.agg(F.lit(n).alias("check"), F.count("*").alias("violations")) for n, x in checks]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out

    def health(self) -> dict:
        """``status`` (healthy, degraded, unhealthy), ``errors`` and ``warnings``."""
        s, errors, notes = self.stats().first(), [], []
        errors += [f"{r.check}: {r.violations}" for r in self.validate().where("violations > 0").collect()]
        ratio = s.tombstones_per_live
        if ratio > 0.5:
            errors.append(f"fragmentation {ratio:.2f}")
        elif ratio > 0.2:
            notes.append(f"fragmentation {ratio:.2f}")
        if s.n_vectors == 0:
            notes.append("empty")
        elif s.max_size > 10 * s.mean_size:
            notes.append("uneven cells")
        if s.empty_partitions:
            notes.append(f"{s.empty_partitions} empty cells")
        if self.nprobe > s.n_partitions / 2:
            notes.append("nprobe above half the cells")
        return {"status": "unhealthy" if errors else "degraded" if notes else "healthy", "errors": errors, "warnings": notes}


def _encoded(vectors: DataFrame, centres: np.ndarray, pq: ProductQuantizer) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((centres, pq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, pq = shared.value
        for batch in batches:
            rows = matrix(batch.column("embedding")).astype(np.float64)
            own = kmeans.cells_of(rows, centres)[:, 0] if len(rows) else np.zeros(0, int)
            codes = pq.stored(pq.encode(rows - centres[own])) if len(rows) else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("id"), pa.array(codes, pa.binary())], ["cell", "id", "codes"])

    return vectors.select("id", "embedding").mapInArrow(run, "cell int, id long, codes binary")


def _within(df: DataFrame, seconds: float) -> DataFrame:
    """Rows computed now; the job is cancelled after ``seconds``."""
    sc, tag = df.sparkSession.sparkContext, f"search-{time.monotonic_ns()}"
    if seconds <= 0:
        raise SearchTimeout(f"no time: {seconds} s")
    timer, late = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobsWithTag(tag))), threading.Event()
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = df.collect()  # at most k rows
    except Exception as e:
        if late.is_set():
            raise SearchTimeout(f"took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return df.sparkSession.createDataFrame(rows, df.schema)


@dataclass
class IvfPqBuilder:
    """Chooses parameters from the number of rows, the dimension and targets, and builds."""

    clusters: int | None = None
    subvectors: int | None = None
    bits: int = 8
    metric: str = "euclidean"
    auto_tune: bool = True
    memory_target_mib: int | None = None
    recall_target: float | None = None
    nprobe: int = 1
    rerank_factor: int = 1
    reranking: bool = False
    seed: int = 0

    def tuned(self, n: int, dim: int) -> dict:
        root = round(math.sqrt(n))
        clusters = self.clusters or (min(max(root, min(256, n)), min(65_536, n)) if self.auto_tune else root)
        parts = self.subvectors or (max((m for m in range(1, dim // 4 + 1) if dim % m == 0), default=1) if self.auto_tune else max(1, dim // 4))
        share = 0.0 if self.recall_target is None else next((s for least, s in ((0.95, 0.1), (0.9, 0.05), (0.8, 0.02)) if min(max(self.recall_target, 0), 1) >= least), 0.0)
        nprobe = self.nprobe if self.nprobe > 1 else min(max(1, math.ceil(clusters * share)), clusters)
        return {"clusters": clusters, "subvectors": parts, "nprobe": nprobe}

    def memory_mib(self, n: int, dim: int, clusters: int, parts: int) -> int:
        return (n * (parts * self.bits // 8 + 8) + clusters * dim * 4 + (1 << self.bits) * dim * 4) >> 20

    def build(self, vectors: DataFrame) -> IvfPqIndex:
        n, low, high = vectors.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n:
            raise EmptyTrainingSet("no vectors")
        if low != high:
            raise DimensionMismatch(high, low)
        p = self.tuned(n, high)
        if p["clusters"] > n:
            raise InvalidParameter(f"{p['clusters']} cells for {n} vectors")
        if high % p["subvectors"]:
            raise DimensionNotDivisible(f"dimension {high} is no multiple of {p['subvectors']}")
        if self.memory_target_mib is not None and (mib := self.memory_mib(n, high, p["clusters"], p["subvectors"])) > self.memory_target_mib:
            warnings.warn(f"about {mib} MiB; the target is {self.memory_target_mib}", stacklevel=2)
        return IvfPqIndex.build(vectors, p["clusters"], p["subvectors"], self.bits, self.metric, p["nprobe"], self.rerank_factor, self.reranking or self.rerank_factor > 1, seed=self.seed)
