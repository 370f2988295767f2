"""Navigable small-world graphs, one for each shard of the vectors; searches merge the shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter, NotSupported
from nearfield.functions.distances import distances, parse_metric

from .ivf import query_frame
from .topk import BROADCAST_VALUES, RESULT, best_of, matrix

#: Nodes of the highest levels that a search may begin at; the nearest to the query is taken.
ENTRIES = 8
#: Queries that are checked against a shard at once.
CHECKED = 64
SHARD = "shard int, n long, ids binary, vectors binary, first binary, offsets binary, links binary"


class Graph:
    """One graph in memory. Levels come from a hash of the id, so a build is reproducible.

    A finalized graph has its links in three arrays: the links of node ``i`` in a layer are
    ``flat[offsets[first[i] + layer] : offsets[first[i] + layer + 1]]``.
    """

    def __init__(self, m: int = 16, ef_construction: int = 200, metric: str = "euclidean", seed: int = 0):
        if m < 2:
            raise InvalidParameter("m must be at least 2")
        if ef_construction < m:
            raise InvalidParameter("ef_construction must be at least m")
        self.m, self.ef, self.metric, self.seed = m, ef_construction, parse_metric(metric), seed
        self.ids: list[int] = []
        self.rows: np.ndarray | None = None
        self.links: list[list[list[int]]] = []
        self.arrays: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.top: int | None = None
        self.entries: list[int] = []

    def level(self, id: int) -> int:
        u = np.random.default_rng([self.seed, id & (1 << 63) - 1]).random()
        return int(-np.log(max(u, 1e-300)) / np.log(self.m))

    def _near(self, node: int, layer: int) -> list[int]:
        if self.arrays is None:
            return self.links[node][layer]
        first, offsets, flat = self.arrays
        at = first[node] + layer
        return flat[offsets[at] : offsets[at + 1]].tolist()

    def _level_of(self, node: int) -> int:
        return len(self.links[node]) - 1 if self.arrays is None else int(self.arrays[0][node + 1] - self.arrays[0][node]) - 1

    def finalize(self) -> Graph:
        """Links as arrays; adding turns them into lists again."""
        if self.arrays is None:
            first = np.concatenate([[0], np.cumsum([len(x) for x in self.links])]).astype(np.int64)
            size = [len(layer) for x in self.links for layer in x]
            flat = np.fromiter((n for x in self.links for layer in x for n in layer), np.int32, sum(size))
            self.arrays, self.links = (first, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat), []
            level = np.diff(first)
            self.entries = np.lexsort((np.arange(len(level)), -level))[:ENTRIES].tolist()
        return self

    def is_finalized(self) -> bool:
        return self.arrays is not None

    def __len__(self) -> int:
        return len(self.ids)

    def row(self, shard: int) -> dict:
        """What :meth:`of_row` reads: plain little-endian arrays."""
        first, offsets, flat = self.finalize().arrays
        return {"shard": shard, "n": len(self.ids), "ids": np.array(self.ids, "<i8").tobytes(), "vectors": self.rows.astype("<f8").tobytes(), "first": first.astype("<i8").tobytes(), "offsets": offsets.astype("<i8").tobytes(), "links": flat.astype("<i4").tobytes()}

    @classmethod
    def of_row(cls, row: dict, metric: str) -> Graph:
        graph = cls(metric=metric)
        graph.ids = np.frombuffer(row["ids"], "<i8").tolist()
        graph.rows = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1) if row["n"] else np.zeros((0, 0))
        graph.arrays = tuple(np.frombuffer(row[c], kind) for c, kind in (("first", "<i8"), ("offsets", "<i8"), ("links", "<i4")))
        level = np.diff(graph.arrays[0])
        graph.entries = np.lexsort((np.arange(len(level)), -level))[:ENTRIES].tolist()
        graph.top = graph.entries[0] if graph.entries else None
        return graph

    def _far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return distances(self.metric, self.rows[nodes], q)

    def _beam(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        d = self._far(q, starts).tolist()
        seen = set(starts)
        open_ = list(zip(d, starts, strict=True))
        heapq.heapify(open_)
        best = [(-x, -n) for x, n in open_]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while open_:
            x, node = heapq.heappop(open_)
            if len(best) >= ef and x > -best[0][0]:
                break
            fresh = [n for n in self._near(node, layer) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for y, n in zip(self._far(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or y < -best[0][0]:
                    heapq.heappush(open_, (y, n))
                    heapq.heappush(best, (-y, -n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-x, -n) for x, n in best)

    def build(self, ids: np.ndarray, rows: np.ndarray) -> Graph:
        if self.arrays is not None:  # adding goes on with lists
            links = [[self._near(n, layer) for layer in range(self._level_of(n) + 1)] for n in range(len(self.ids))]
            self.arrays, self.links = None, links
        rows, had = np.asarray(rows, np.float64), len(self.ids)
        if had and len(rows) and rows.shape[1] != self.rows.shape[1]:
            raise DimensionMismatch(self.rows.shape[1], rows.shape[1])
        self.rows = np.concatenate([self.rows, rows]) if had else rows
        for i, id in enumerate(ids.tolist(), had):
            self._add(i, id)
        return self

    def bulk(self, ids: np.ndarray, rows: np.ndarray) -> Graph:
        """A graph of all rows at once: what adding them one by one gives if every search for neighbours were exact.

        In each layer a node is linked with its ``m`` nearest among those before it, found by matrix products in blocks, and
        every node then keeps its nearest links within the bound. The link with the nearest node before is kept
        beyond it, so every node of a layer can be reached from any other.
        """
        self.rows, self.ids, n = np.asarray(rows, np.float64), ids.tolist(), len(ids)
        if not n:
            return self
        level = np.array([self.level(i) for i in self.ids])
        per_layer = []
        for layer in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= layer)
            a, b, d = self._earlier(self.rows[nodes])
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]  # the nearest before comes first
            x, y, far, must = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]), np.concatenate([first, first])
            order = np.lexsort((y, far, x))
            x, y, must = x[order], y[order], must[order]
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            keep = must | (rank < (2 * self.m if layer == 0 else self.m))
            x, y = x[keep], nodes[y[keep]]
            at = np.searchsorted(x, np.arange(len(nodes) + 1))
            per_layer.append((np.searchsorted(nodes, np.arange(n)), at, y))
        self.links = [[y[at[place[i]] : at[place[i] + 1]].tolist() for place, at, y in per_layer[: level[i] + 1]] for i in range(n)]
        self.top = int(level.argmax())
        return self.finalize()

    def _earlier(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a row and one of its ``m`` nearest before it, with their distance; nearest first for each row."""
        size, out = np.einsum("ij,ij->i", rows, rows), []
        for a in range(0, len(rows), 512):
            part, seen = rows[a : a + 512], rows[: a + 512]
            if self.metric == "manhattan":
                d = np.stack([np.abs(seen - r).sum(axis=1) for r in part])
            else:
                d = -(part @ seen.T)
                if self.metric == "cosine":
                    norm = np.sqrt(size[a : a + 512, None] * size[: a + 512])
                    d = np.where(norm == 0, 0.0, 1 + d / np.where(norm == 0, 1, norm))
                elif self.metric != "dot":
                    d = size[a : a + 512, None] + size[: a + 512] + 2 * d
            i = np.arange(a, a + len(part))
            d[np.arange(len(seen)) >= i[:, None]] = np.inf
            m = min(self.m, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            far = np.take_along_axis(d, near, 1)
            order = np.lexsort((near, far), axis=1)
            near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
            real = np.isfinite(far)
            out.append((np.repeat(i, m)[real.ravel()], near[real], far[real]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _add(self, i: int, id: int) -> None:
        level = self.level(id)
        self.ids.append(id)
        self.links.append([[] for _ in range(level + 1)])
        if self.top is None:
            self.top = i
            return
        q, entry, high = self.rows[i], [self.top], len(self.links[self.top]) - 1
        for layer in range(high, level, -1):
            entry = [self._beam(q, entry, 1, layer)[0][1]]
        for layer in range(min(level, high), -1, -1):
            near = self._beam(q, entry, self.ef, layer)
            bound = 2 * self.m if layer == 0 else self.m
            chosen = [n for _, n in near[: self.m]]
            self.links[i][layer] = list(chosen)
            for n in chosen:
                own = self.links[n][layer]
                own.append(i)
                if len(own) > bound:
                    far = self._far(self.rows[n], own)
                    self.links[n][layer] = [own[j] for j in np.argsort(far, kind="stable")[:bound]]
            entry = [n for _, n in near]
        if level > high:
            self.top = i

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """``(distance, id)``, nearest first."""
        if self.top is None:
            return []
        q = np.asarray(query, np.float64)
        starts = self.entries or [self.top]
        entry = [starts[int(self._far(q, starts).argmin())]]
        for layer in range(self._level_of(entry[0]), 0, -1):
            entry = [self._beam(q, entry, 1, layer)[0][1]]
        return sorted((d, self.ids[n]) for d, n in self._beam(q, entry, max(ef, k), 0))[:k]

    def checked_search(self, queries: np.ndarray, k: int, ef: int) -> list[list[tuple[float, int]]]:
        """:meth:`search` of each query, then an exact check: nodes within the last distance found that the search missed come in."""
        out = []
        for a in range(0, len(queries), CHECKED):
            part = queries[a : a + CHECKED]
            found = [self.search(q, k, ef) for q in part]
            bounds = np.array([x[-1][0] if len(x) == k else np.inf for x in found])
            for q, own, near in zip(part, found, self._within(part, bounds), strict=True):
                if len(near) > len(own):
                    d, ids = self._far(q, near), self.id_array()[near]
                    best = np.lexsort((ids, d))[:k]
                    own = list(zip(d[best].tolist(), ids[best].tolist(), strict=True))
                out.append(own)
        return out

    def id_array(self) -> np.ndarray:
        return np.asarray(self.ids, np.int64)

    def _within(self, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Nodes within the bound of each query, and those that rounding might put there."""
        if self.metric == "manhattan" or not len(self.ids):
            score, bounds, slack = np.array([distances(self.metric, self.rows, q) for q in queries]).reshape(len(queries), -1), bounds, np.abs(bounds)
        else:
            size, own = np.einsum("ij,ij->i", self.rows, self.rows), np.einsum("ij,ij->i", queries, queries)
            score = -(queries @ self.rows.T)
            slack = np.sqrt(own * size.max(initial=0))
            if self.metric == "cosine":
                norm = np.sqrt(size[None, :] * own[:, None])
                score, slack = np.where(norm == 0, 0.0, 1 + score / np.where(norm == 0, 1, norm)), np.ones(len(queries))
            elif self.metric != "dot":
                score, slack = own[:, None] + size + 2 * score, own + size.max(initial=0)
                bounds = bounds**2 if self.metric == "euclidean" else bounds
        limit = bounds + 1e-9 * slack + 1e-12
        return [np.flatnonzero(~(s > x)) for s, x in zip(score, limit, strict=True)]

    def reachable(self) -> int:
        """Nodes that the base layer reaches from the entry."""
        seen, todo = {self.top}, [self.top]
        while todo:
            for n in self._near(todo.pop(), 0):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return len(seen)


class HnswIndex:
    """``graphs``: a row of arrays for each shard of about ``shard_rows`` vectors, so no task holds more."""

    def __init__(self, graphs: DataFrame, metric: str, dimension: int, ef_search: int, parameters: tuple[int, int, int, int] = (16, 200, 50_000, 0), check: bool = False):
        self.graphs, self.metric, self.dimension, self.ef_search, self.parameters, self.check = graphs, metric, dimension, ef_search, parameters, check

    @classmethod
    def build(cls, vectors: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "euclidean", shard_rows: int = 50_000, seed: int = 0) -> HnswIndex:
        Graph(m, ef_construction, metric)
        return cls(*cls._shards(vectors, m, ef_construction, metric, shard_rows, seed), ef_construction, (m, ef_construction, shard_rows, seed))

    @staticmethod
    def _shards(vectors: DataFrame, m: int, ef_construction: int, metric: str, shard_rows: int, seed: int) -> tuple[DataFrame, str, int]:
        n, low, high = vectors.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high:
            raise DimensionMismatch(high, low)
        shards = max(1, -(-n // shard_rows))

        def run(key: tuple, table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("id").to_numpy(), kind="stable")
            table = table.take(pa.array(order)).combine_chunks()
            graph = Graph(m, ef_construction, metric, seed).bulk(table.column("id").to_numpy(), matrix(table.column("embedding").combine_chunks()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.table({c: pa.array([x], kind) for (c, x), kind in zip(graph.row(key[0].as_py()).items(), kinds, strict=True)})

        rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), "embedding")
        return rows.groupBy("shard").applyInArrow(run, SHARD), parse_metric(metric), high or 0

    def add(self, vectors: DataFrame) -> HnswIndex:
        """With graphs of new vectors beside the old ones; ids may repeat."""
        graphs, _, d = self._shards(vectors, *self.parameters[:2], self.metric, *self.parameters[2:])
        if d and self.dimension and d != self.dimension:
            raise DimensionMismatch(self.dimension, d)
        return HnswIndex(self.graphs.union(graphs), self.metric, self.dimension or d, self.ef_search, self.parameters, self.check)

    def count(self) -> int:
        return self.graphs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def is_empty(self) -> bool:
        return self.count() == 0

    def with_ef_search(self, ef: int) -> HnswIndex:
        if ef < 1:
            raise InvalidParameter("ef must be at least 1")
        return HnswIndex(self.graphs, self.metric, self.dimension, ef, self.parameters, self.check)

    def with_check(self) -> HnswIndex:
        """Searches end with an exact check, so they miss nothing: each shard is compared with the distances that its graph found."""
        return HnswIndex(self.graphs, self.metric, self.dimension, self.ef_search, self.parameters, True)

    def batch_search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``qid, rank, id, distance``; queries are broadcast to the shards, in rounds of at most ``BROADCAST_VALUES`` numbers."""
        if k < 1:
            raise InvalidParameter("k must be at least 1")
        rounds = max(1, -(-queries.count() * max(1, self.dimension) // BROADCAST_VALUES))
        found = None
        for r in range(rounds):  # one round but for very many queries
            one = self._scan(queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r), k)
            found = one if found is None else found.union(one)
        return best_of(found, k)

    def _scan(self, queries: DataFrame, k: int) -> DataFrame:
        metric = self.metric
        rows = [(r.qid, np.array(r.embedding, np.float64)) for r in queries.select("qid", "embedding").collect()]
        if odd := next((len(q) for _, q in rows if len(q) != self.dimension), None):
            raise DimensionMismatch(self.dimension, odd)
        shared, ef, check = self.graphs.sparkSession.sparkContext.broadcast(rows), self.ef_search, self.check

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    graph = Graph.of_row({c: batch.column(c)[i].as_py() for c in batch.schema.names}, metric)
                    asked = shared.value
                    near = graph.checked_search(np.array([q for _, q in asked]), k, ef) if check and len(graph) else (graph.search(q, k, ef) for _, q in asked)
                    found = [(qid, id, d) for (qid, _), own in zip(asked, near, strict=True) for d, id in own]
                    qid, id, d = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(id, pa.int64()), pa.array(d, pa.float64())], ["qid", "id", "distance"])

        return self.graphs.mapInArrow(run, RESULT)

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        return self.batch_search(query_frame(self.graphs.sparkSession, query), k).drop("qid")

    def remove(self, ids: DataFrame) -> None:
        raise NotSupported("a graph keeps its nodes; filter results or rebuild")
