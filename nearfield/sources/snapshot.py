"""Versioned snapshots: Parquet tables and a manifest that is renamed into place last."""

from __future__ import annotations

import json
import uuid
import zlib
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import ChecksumMismatch, CorruptedData, InsufficientDiskSpace, NotFound, UnsupportedVersion
from nearfield.operators.brute import BruteForceIndex
from nearfield.operators.hnsw import HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.ivfpq import IvfPqIndex
from nearfield.operators.pq import ProductQuantizer

FORMAT, VERSION = "nearfield-snapshot", 1
TYPES = {1: "ivf_pq", 2: "hnsw", 3: "ivf", 4: "brute_force"}


#: Share of its estimated size that a snapshot needs free beside it.
MARGIN = 0.1


class Persistable(Protocol):
    """What :func:`save` takes and :func:`load` gives."""

    metric: str

    @property
    def dimension(self) -> int: ...

    def batch_search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


class Store:
    """Small files and renames through Hadoop's file systems, so a folder may be on any of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.uri(name)))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.uri(name)))) if self.exists(name) else []

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise NotFound(self.uri(name))
        rows = self.spark.read.format("binaryFile").load(self.uri(name)).select("content").collect()
        return bytes(rows[0].content).decode(errors="replace")

    def write(self, name: str, text: str) -> None:
        """The file appears whole or not at all, in place of an older one."""
        temporary = self.uri(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(self._path(temporary), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.replace(f"{name}", temporary)

    def replace(self, name: str, source: str) -> None:
        """Renames ``source`` (a whole path) to a name over what is there, in one step where the file system can."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        options = sc._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE
        context.rename(self._path(source), self._path(self.uri(name)), options)

    def free(self) -> int:
        """Bytes free on the file system, as far as it says."""
        path = self._path(self.root)
        self._fs.mkdirs(path)
        return int(self._fs.getStatus(path).getRemaining())

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.uri(name)), True)


def _ordered(name: str, df: DataFrame) -> DataFrame:
    """Cells are written sorted, so a search that filters on them reads few row groups."""
    return df.repartitionByRange("cell").sortWithinPartitions("cell", "id") if name == "cells" else df


def _estimate(index) -> int:
    """Bytes of the vectors or codes of an index."""
    if isinstance(index, HnswIndex):
        return 0  # its graphs would have to be built
    each = index.pq.bytes_per_vector + 12 if isinstance(index, IvfPqIndex) else 4 * index.dimension + 12
    if isinstance(index, IvfPqIndex) and index.originals is not None:
        each += 4 * index.dimension + 8
    return index.count() * each


def checksum(df: DataFrame) -> list[int]:
    """Rows, and an order-free sum of row hashes."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))).first()
    return [int(row[0]), int(row[1])]


def _parts(index) -> tuple[int, dict, dict[str, DataFrame]]:
    plain = lambda a: np.asarray(a).tolist()
    if isinstance(index, IvfPqIndex):
        tables = {"cells": index.cells, "originals": index.originals, "tombstones": index.tombstones}
        return 1, {"centres": plain(index.centres), "books": plain(index.pq.books), "metric": index.metric, "nprobe": index.nprobe, "rerank_factor": index.rerank_factor, "parameters": index.parameters}, {k: v for k, v in tables.items() if v is not None}
    if isinstance(index, HnswIndex):
        return 2, {"metric": index.metric, "dimension": index.dimension, "ef_search": index.ef_search, "build": list(index.parameters)}, {"graphs": index.graphs}
    if isinstance(index, IvfIndex):
        return 3, {"centres": plain(index.centres), "metric": index.metric, "nprobe": index.nprobe}, {"cells": index.cells}
    return 4, {"metric": index.metric}, {"vectors": index.vectors}


def save(index: Persistable, root: str, spark: SparkSession, metadata: DataFrame | None = None, extra: dict | None = None) -> int:
    """Writes the next version and returns its number. Readers of an older version are not disturbed."""
    store = Store(spark, root)
    needed, free = int(_estimate(index) * (1 + MARGIN)), store.free()
    if needed > free:
        raise InsufficientDiskSpace(needed, free)
    version = max((int(x[1:]) for x in store.list() if x.startswith("v") and x[1:].isdigit()), default=0) + 1
    kind, parameters, tables = _parts(index)
    tables = tables | ({"metadata": metadata} if metadata is not None else {})
    sums = {}
    for name, df in tables.items():
        _ordered(name, df).write.mode("overwrite").parquet(store.uri(f"v{version}/{name}"))
        sums[name] = checksum(spark.read.parquet(store.uri(f"v{version}/{name}")))
    body = {"format": FORMAT, "version": VERSION, "type": kind, "flags": {"rerank": "originals" in tables, "metadata": metadata is not None, "compression": spark.conf.get("spark.sql.parquet.compression.codec")}, "folder": f"v{version}", "tables": sums, "parameters": parameters, "extra": extra or {}}
    text = json.dumps(body, sort_keys=True)
    store.write("manifest.json", json.dumps({"crc32": zlib.crc32(text.encode()), "body": text}))
    return version


def manifest(root: str, spark: SparkSession) -> dict:
    text = Store(spark, root).read("manifest.json")
    try:
        outer = json.loads(text)
        crc, body = outer["crc32"], outer["body"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptedData(f"no manifest: {e}") from e
    if zlib.crc32(body.encode()) != crc:
        raise ChecksumMismatch("the manifest does not match its checksum")
    got = json.loads(body)
    if got.get("format") != FORMAT:
        raise CorruptedData("not a snapshot")
    if got["version"] > VERSION:
        raise UnsupportedVersion(f"version {got['version']}")
    if got["type"] not in TYPES:
        raise CorruptedData(f"unknown index type {got['type']}")
    return got


def load(root: str, spark: SparkSession, verify: bool = True):
    """The index of the present manifest; tables are read lazily unless ``verify`` checks them first."""
    got = manifest(root, spark)
    tables = {name: spark.read.parquet(f"{root.rstrip('/')}/{got['folder']}/{name}") for name in got["tables"]}
    if verify:
        for name, df in tables.items():
            if checksum(df) != got["tables"][name]:
                raise ChecksumMismatch(f"table {name}")
    p = got["parameters"]
    if got["type"] == 1:
        return IvfPqIndex(np.array(p["centres"]), ProductQuantizer(np.array(p["books"])), tables["cells"], tables.get("originals"), tables.get("tombstones"), p["metric"], p["nprobe"], p["rerank_factor"], p["parameters"])
    if got["type"] == 2:
        return HnswIndex(tables["graphs"], p["metric"], p["dimension"], p["ef_search"], tuple(p["build"]))
    if got["type"] == 3:
        return IvfIndex(np.array(p["centres"]), tables["cells"], p["metric"], p["nprobe"])
    return BruteForceIndex(tables["vectors"], p["metric"])


def load_metadata(root: str, spark: SparkSession) -> DataFrame | None:
    got = manifest(root, spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{got['folder']}/metadata") if "metadata" in got["tables"] else None
