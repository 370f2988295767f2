"""fvecs and ivecs files: repeated little-endian ``[dimension][values]`` records."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import CorruptedData, NotFound
from nearfield.functions.vectors import random_vectors
from nearfield.operators.topk import knn


#: Bytes of a file that one task reads whole.
WHOLE_BYTES = 64 << 20


def records(data: bytes, kind: str) -> list[np.ndarray]:
    """Vectors of a file; a short header ends it, a short body is an error."""
    out, at = [], 0
    while len(data) - at >= 4:
        (dim,) = struct.unpack_from("<i", data, at)
        if dim < 0 or len(data) - at - 4 < 4 * dim:
            raise CorruptedData(f"record at byte {at} is cut short")
        out.append(np.frombuffer(data, kind, dim, at + 4))
        at += 4 + 4 * dim
    return out


def _read(spark: SparkSession, path: str, kind: str, element: str) -> DataFrame:
    """``id, embedding``: ids are positions in the file, counted anew in each.

    Files up to ``WHOLE_BYTES`` are read whole, one task a file. Larger ones, whose records must have one dimension, are
    read in splits.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    files = [s for f in found or [] for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]) if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    if not files:
        raise NotFound(path)
    small = [s.getPath().toString() for s in files if s.getLen() <= WHOLE_BYTES]
    parts = [_whole(spark, small, kind, element)] if small else []
    parts += [_in_splits(spark, fs, s, kind, element) for s in files if s.getLen() > WHOLE_BYTES]
    return reduce(DataFrame.union, parts)


def _in_splits(spark: SparkSession, fs, status, kind: str, element: str) -> DataFrame:
    path, size = status.getPath(), status.getLen()
    stream = fs.open(path)
    (dim,) = struct.unpack("<i", struct.pack(">i", stream.readInt()))
    stream.close()
    if dim < 1 or size % (4 + 4 * dim):
        raise CorruptedData(f"{path.toString()} does not hold whole records of dimension {dim}")
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    rows = spark.sparkContext._jsc.binaryRecords(path.toString(), 4 + 4 * dim).rdd()
    raw = DataFrame(session.createDataset(rows, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("record")
    counts = {r.part: r["count"] for r in raw.groupBy(F.spark_partition_id().alias("part")).count().collect()}  # one row a split
    before = dict(zip(sorted(counts), np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(x.as_py() for x in batch.column("record")), "<i4").reshape(n, dim + 1)
            if (values[:, 0] != dim).any():
                raise CorruptedData(f"records of {path_name} have other dimensions than {dim}")
            flat = pa.array(np.ascontiguousarray(values[:, 1:]).view(kind).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), flat)], ["id", "embedding"])
            at += n

    path_name = path.toString()
    return raw.mapInArrow(run, f"id long, embedding array<{element}>")


def _whole(spark: SparkSession, paths: list[str], kind: str, element: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = records(data.as_py(), kind)
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    values = pa.array(np.concatenate(part) if part else np.zeros(0, kind))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in part])]), pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), lists], ["path", "at", "embedding"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, f"path string, at long, embedding array<{element}>").select(F.col("at").alias("id"), "embedding")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<i4", "int")


def write_vecs(rows: list, path: str, kind: str = "<f4") -> None:
    """A small file, for tests and exchange."""
    with open(path, "wb") as f:
        for r in rows:
            v = np.asarray(r, kind)
            f.write(struct.pack("<i", len(v)) + v.tobytes())


def load_dataset(spark: SparkSession, base: str, queries: str, truth: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base vectors, queries (``qid``) and true neighbours (``qid, rank, id``)."""
    t = read_ivecs(spark, truth).select(F.col("id").alias("qid"), F.posexplode("embedding").alias("rank", "id"))
    return read_fvecs(spark, base), read_fvecs(spark, queries).withColumnRenamed("id", "qid"), t.select("qid", F.col("rank") + 1, F.col("id").cast("long")).toDF("qid", "rank", "id")


def synthetic(spark: SparkSession, n: int, queries: int, dimension: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vectors with ids 0 to n-1, and queries with the ids after them."""
    return random_vectors(spark, n, dimension, seed), random_vectors(spark, queries, dimension, seed, n).withColumnRenamed("id", "qid")


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return knn(vectors, queries, k, "euclidean")
