"""Named collections in a folder: create, upsert, delete, search, build, checkpoint, compact."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import AlreadyExists, DimensionMismatch, InvalidConfig, InvalidParameter, NotFound
from nearfield.functions.filters import Condition, Tagged
from nearfield.operators.brute import BruteForceIndex
from nearfield.operators.hnsw import HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.ivfpq import IvfPqIndex
from nearfield.functions.vectors import bad_vectors
from nearfield.operators.metadata import from_json
from nearfield.operators.topk import best_of

from . import snapshot
from .config import CollectionConfig, check_batch, check_name, check_top_k
from .oplog import OpLog, state
from .snapshot import Store


class Collection:
    """Rows are the last snapshot with the operations after it; the last write of an id wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark, root)
        body = json.loads(self.store.read("collection.json"))
        self.name, self.config = body["name"], CollectionConfig.from_dict(body["config"])
        self.log = OpLog(spark, f"{root}/log")
        self.counters = json.loads(self.store.read("counters.json")) if self.store.exists("counters.json") else {"searches": 0, "upserts": 0, "deletes": 0, "search_ms": 0.0}

    def _snapshot_seq(self) -> int:
        return snapshot.manifest(f"{self.root}/rows", self.spark)["extra"]["seq"] if self.store.exists("rows/manifest.json") else -1

    def _count(self, name: str, ms: float = 0.0) -> None:
        self.counters[name] += 1
        self.counters["search_ms"] += ms

    def save_counters(self) -> None:
        """Keeps the counters for the next session; a checkpoint does too."""
        self.store.write("counters.json", json.dumps(self.counters))

    def rows(self) -> DataFrame:
        """``id, embedding, metadata`` (JSON)."""
        new = self.log.replay_after(self._snapshot_seq())
        alive = state(new).select("id", F.col("vector").alias("embedding"), "metadata")
        if not self.store.exists("rows/manifest.json"):
            return alive
        base = snapshot.load(f"{self.root}/rows", self.spark, verify=False).vectors.join(snapshot.load_metadata(f"{self.root}/rows", self.spark), "id", "left")
        return base.join(new.where("op in ('insert', 'delete')").select("id").distinct(), "id", "left_anti").unionByName(alive)

    def dimension(self) -> int:
        if self.config.dimension:
            return self.config.dimension
        row = self.rows().select(F.size("embedding").alias("d")).first()
        return row.d if row else 0

    def count(self) -> int:
        return self.rows().count()

    def upsert(self, rows: DataFrame, bulk: bool = False) -> int:
        """``rows(id, embedding[, metadata])``, validated whole before anything is logged; returns the last sequence.

        A batch has at most ``MAX_BATCH`` rows unless ``bulk``.
        """
        if not bulk:
            check_batch(rows.count())
        d = self.dimension() or (rows.select(F.size("embedding").alias("d")).first() or {"d": 0})["d"]
        odd = rows.where(F.col("id").isNull() | (F.size("embedding") != d)).select(F.size("embedding").alias("d")).first()
        if odd:
            raise DimensionMismatch(d, odd.d)
        if not bad_vectors(rows, d).isEmpty():
            raise InvalidParameter("ids must not be negative, and values must be finite")
        meta = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
        self._count("upserts")
        return self.log.append(rows.select(F.lit("insert").alias("op"), "id", F.col("embedding").cast("array<float>").alias("vector"), meta.alias("metadata")))

    def delete(self, ids: DataFrame) -> int:
        """Deletes the ids that exist; returns how many."""
        found = self.rows().join(ids.select("id").distinct(), "id", "left_semi").select("id")
        n = found.count()
        if n:
            self.log.append(found.select(F.lit("delete").alias("op"), "id"))
        self._count("deletes")
        return n

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, condition: Condition | None = None, max_distance: float | None = None, with_metadata: bool = False, per_query_k: bool = False) -> DataFrame:
        """``queries(qid, embedding[, k])`` -> ``qid, rank, id, distance[, metadata]``; the filter limits candidates before they are scored.

        An index, once built, serves all searches but those with a ``k`` of each query's own; rows written since its build are
        searched exactly beside it, and rows deleted or written anew are left out of it.
        """
        check_top_k(k)
        begin, rows, ids = time.perf_counter(), self.rows(), None
        if condition is not None:
            tagged = from_json(rows.select("id", F.col("metadata").alias("json")).where("json is not null"))
            ids = tagged.where(condition.compile(Tagged("metadata"))).select("id")
        if not per_query_k and self.store.exists("index/manifest.json"):
            found = self._through_index(rows, queries, k, nprobe, ids, max_distance)
        else:
            rows = rows if ids is None else rows.join(ids, "id", "left_semi")
            found = BruteForceIndex(rows, self.config.metric).batch_search(queries, k, max_distance, per_query_k)
        self._count("searches", 1000 * (time.perf_counter() - begin))
        return found.join(self.rows().select("id", "metadata"), "id", "left").select("qid", "rank", "id", "distance", "metadata") if with_metadata else found

    def _through_index(self, rows: DataFrame, queries: DataFrame, k: int, nprobe: int | None, ids: DataFrame | None, max_distance: float | None) -> DataFrame:
        index = snapshot.load(f"{self.root}/index", self.spark, verify=False)
        changed = self.log.replay_after(snapshot.manifest(f"{self.root}/index", self.spark)["extra"]["seq"]).where("op in ('insert', 'delete')").select("id").distinct()
        gone = None if changed.isEmpty() else changed
        if isinstance(index, HnswIndex) and (ids is not None or gone is not None):
            rows = rows if ids is None else rows.join(ids, "id", "left_semi")
            return BruteForceIndex(rows, self.config.metric).batch_search(queries, k, max_distance)  # a graph can't leave rows out
        if isinstance(index, IvfPqIndex):
            index = index if gone is None else index.delete(gone)
            meta, condition = (None, None) if ids is None else (ids, F.lit(True))
            found = index.batch_search(queries, k, nprobe, meta, condition, max_distance)
        elif isinstance(index, IvfIndex):
            cells = index.cells if gone is None else index.cells.join(gone, "id", "left_anti").select("cell", "id", "embedding")
            cells = cells if ids is None else cells.join(ids, "id", "left_semi").select("cell", "id", "embedding")
            found = IvfIndex(index.centres, cells, index.metric, index.nprobe).batch_search(queries, k, nprobe, max_distance)
        elif isinstance(index, HnswIndex):
            found = index.batch_search(queries, k)
            found = found.where(F.col("distance") <= max_distance) if max_distance is not None else found
        else:
            left = index.vectors if gone is None else index.vectors.join(gone, "id", "left_anti")
            left = left if ids is None else left.join(ids, "id", "left_semi")
            found = BruteForceIndex(left, index.metric).batch_search(queries, k, max_distance)
        if gone is None:
            return found
        new = rows.join(gone, "id", "left_semi")
        new = new if ids is None else new.join(ids, "id", "left_semi")
        metric = "euclidean" if isinstance(index, IvfPqIndex) and index.rerank_factor == 1 else self.config.metric
        return best_of(found.drop("rank").union(BruteForceIndex(new, metric).batch_search(queries, k, max_distance).drop("rank")), k)

    def build_index(self) -> None:
        """The index of the configuration over the present rows."""
        c, rows = self.config, self.rows().select("id", "embedding")
        if c.index_type == "ivf_pq":
            index = IvfPqIndex.build(rows, c.ivf.n_clusters, c.pq.n_subvectors, c.pq.bits, c.metric, c.ivf.nprobe, c.pq.rerank_factor, rounds=c.ivf.max_iterations)
        elif c.index_type == "ivf":
            index = IvfIndex.build(rows, c.ivf.n_clusters, c.metric, c.ivf.max_iterations, nprobe=c.ivf.nprobe)
        elif c.index_type == "hnsw":
            index = HnswIndex.build(rows, c.hnsw.m, c.hnsw.ef_construction, c.metric).with_ef_search(c.hnsw.ef_search)
        else:
            index = BruteForceIndex(rows, c.metric)
        snapshot.save(index, f"{self.root}/index", self.spark, extra={"seq": self.log.next_sequence() - 1})

    def checkpoint(self) -> int:
        """Writes the rows as a snapshot and notes it in the log; returns the sequence it covers."""
        seq, rows = self.log.next_sequence() - 1, self.rows()
        snapshot.save(BruteForceIndex(rows, self.config.metric), f"{self.root}/rows", self.spark, rows.select("id", "metadata"), {"seq": seq})
        self.log.checkpoint(seq)
        self.save_counters()
        return seq

    def compact(self) -> int:
        """A checkpoint that also drops what the log no longer needs; returns the number of dropped entries.

        An index that the dropped entries would bring up to date is built anew first.
        """
        if self.store.exists("index/manifest.json"):
            seq = snapshot.manifest(f"{self.root}/index", self.spark)["extra"]["seq"]
            if not self.log.replay_after(seq).where("op in ('insert', 'delete')").isEmpty():
                self.build_index()
        self.checkpoint()
        return self.log.truncate_to_checkpoint()

    def info(self) -> dict:
        d, n = self.dimension(), self.count()
        return {"name": self.name, "count": n, "dimension": d, "metric": self.config.metric, "index_type": self.config.index_type, "memory_bytes": n * d * 4, "health": self.health()}

    def health(self) -> str:
        if not self.store.exists("index/manifest.json"):
            return "healthy"
        index = snapshot.load(f"{self.root}/index", self.spark, verify=False)
        return index.health()["status"] if isinstance(index, IvfPqIndex) else "healthy"

    def stats(self) -> DataFrame:
        c = self.counters
        mean = c["search_ms"] / c["searches"] if c["searches"] else 0.0
        row = (self.name, self.count(), c["searches"], c["upserts"], c["deletes"], self.log.pending(), float(c["search_ms"]), float(mean))
        return self.spark.createDataFrame([row], "name string, n_vectors long, searches long, upserts long, deletes long, pending_operations long, search_ms double, mean_search_ms double")


class Catalog:
    """Collections in the folders of one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def create(self, name: str, config: CollectionConfig | None = None) -> Collection:
        check_name(name)
        config = config or CollectionConfig()
        config.validate()
        if self.store.exists(f"{name}/collection.json"):
            raise AlreadyExists(name)
        self.store.write(f"{name}/collection.json", json.dumps({"name": name, "config": asdict(config)}))
        return self.get(name)

    def get(self, name: str) -> Collection:
        check_name(name)
        if not self.store.exists(f"{name}/collection.json"):
            raise NotFound(name)
        return Collection(self.spark, self.store.uri(name))

    def drop(self, name: str) -> bool:
        check_name(name)
        if not self.store.exists(f"{name}/collection.json"):
            return False
        self.store.delete(name)
        return True

    def list(self, offset: int = 0, limit: int = 100) -> list[str]:
        """Names in order."""
        if offset < 0 or not 0 <= limit <= 1000:
            raise InvalidConfig("limit must be 0 to 1000, offset not negative")
        return [n for n in self.store.list() if self.store.exists(f"{n}/collection.json")][offset : offset + limit]

    def health(self) -> dict[str, str]:
        return {n: self.get(n).health() for n in self.list(limit=1000)}
