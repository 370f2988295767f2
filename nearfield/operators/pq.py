"""Product quantization with 8- or 4-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, DimensionNotDivisible, EmptyTrainingSet, InvalidParameter
from nearfield.functions.distances import rounded

from . import kmeans
from .topk import BROADCAST_VALUES, PAIRS, RESULT, best_of, in_rounds, matrix, nearest

TRAINING_ROUNDS = 25


def pack4(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the first in the low half; an odd last one alone."""
    c = np.asarray(codes, np.uint8)
    if c.shape[-1] % 2:
        c = np.concatenate([c, np.zeros((*c.shape[:-1], 1), np.uint8)], axis=-1)
    return c[..., ::2] | c[..., 1::2] << 4


def unpack4(packed: np.ndarray, m: int) -> np.ndarray:
    p = np.asarray(packed, np.uint8)
    return np.stack([p & 15, p >> 4], axis=-1).reshape(*p.shape[:-1], -1)[..., :m]


def residuals(rows: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """What is left of rows beside their nearest centres; without centres, the rows."""
    return rows if centres is None else rows - centres[kmeans.cells_of(rows, centres)[:, 0]]


class ProductQuantizer:
    """``books[m, code, dim // m]``."""

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, np.float64)

    @classmethod
    def fit(cls, vectors: DataFrame, m: int, bits: int = 8, rounds: int = TRAINING_ROUNDS, init: str = "auto", seed: int = 0, centres: np.ndarray | None = None, sample_rows: int = 30_000) -> ProductQuantizer:
        """What :meth:`train` gives for all rows, or for what is left of them beside the nearest of ``centres``; a round is one job.

        Starts are chosen on at most ``sample_rows`` rows, as those of :func:`kmeans.fit`.
        """
        if bits not in (4, 8):
            raise InvalidParameter("bits must be 4 or 8")
        k = 1 << bits
        rows = kmeans.drawn(vectors, k if init == "first" else sample_rows, init, seed)
        if m < 1 or rows.shape[1] % m:
            raise DimensionNotDivisible(f"dimension {rows.shape[1]} is no multiple of {m} parts")
        books = np.stack([kmeans.start(p, k, init, seed + i) for i, p in enumerate(np.split(residuals(rows, centres), m, axis=1))])
        moving = np.ones(m, bool)
        for _ in range(rounds):
            shared = vectors.sparkSession.sparkContext.broadcast((books, centres))

            def local(rows: np.ndarray, shared=shared) -> tuple[np.ndarray, np.ndarray]:
                books, centres = shared.value
                parts = [kmeans.cell_sums(p, kmeans.cells_of(p, b)[:, 0], k) for p, b in zip(np.split(residuals(rows, centres), m, axis=1), books, strict=True)]
                return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

            sums, n = kmeans.summed(vectors, m * k, books.shape[2], local)
            sums, n = sums.reshape(books.shape), n.reshape(m, k, 1)
            new = np.where((n > 0) & moving[:, None, None], sums / np.maximum(n, 1), books)
            moving &= ((new - books) ** 2).sum(axis=(1, 2)) / k >= kmeans.CONVERGED
            books = new
            if not moving.any():
                break
        return cls(books)

    @classmethod
    def train(cls, rows: np.ndarray, m: int, bits: int = 8, rounds: int = TRAINING_ROUNDS, init: str = "auto", seed: int = 0) -> ProductQuantizer:
        """One k-means for each part, on a bounded sample in memory."""
        if bits not in (4, 8):
            raise InvalidParameter("bits must be 4 or 8")
        if not len(rows):
            raise EmptyTrainingSet("no vectors to train on")
        if m < 1 or rows.shape[1] % m:
            raise DimensionNotDivisible(f"dimension {rows.shape[1]} is no multiple of {m} parts")
        parts = np.split(rows.astype(np.float64), m, axis=1)
        return cls(np.stack([kmeans.fit_local(p, 1 << bits, rounds, init, seed + i) for i, p in enumerate(parts)]))

    @property
    def parts(self) -> int:
        return self.books.shape[0]

    @property
    def bits(self) -> int:
        return 4 if self.books.shape[1] <= 16 else 8

    @property
    def dimension(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    @property
    def bytes_per_vector(self) -> int:
        return -(-self.parts * self.bits // 8)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Nearest code of each part, ties to the lower code."""
        if len(rows) and rows.shape[1] != self.dimension:
            raise DimensionMismatch(self.dimension, rows.shape[1])
        parts = np.split(np.asarray(rows, np.float64).reshape(len(rows), self.dimension), self.parts, axis=1)
        return np.stack([kmeans.cells_of(p, b)[:, 0] for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """``table[m, code]``: squared distance of the query's part from the code."""
        q = np.asarray(query, np.float64).reshape(self.parts, 1, -1)
        return ((self.books - q) ** 2).sum(axis=2)

    def squared(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of all codes."""
        return self.looked_up(table, self.places(codes))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where a table, laid flat, has the values of codes; worth keeping for many tables."""
        return codes.astype(np.intp) + np.arange(self.parts, dtype=np.intp) * self.books.shape[1]

    def looked_up(self, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.take(table.ravel(), places).sum(axis=1)

    def distance(self, query: np.ndarray, codes: np.ndarray) -> float:
        return float(np.sqrt(self.squared(self.table(query), np.asarray(codes)[None, :])[0]))

    def stored(self, codes: np.ndarray) -> list[bytes]:
        return [c.tobytes() for c in (pack4(codes) if self.bits == 4 else codes)]

    def loaded(self, column: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return unpack4(flat, self.parts) if self.bits == 4 else flat

    def encode_frame(self, vectors: DataFrame) -> DataFrame:
        """``id, codes``."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pq = shared.value
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pq.stored(pq.encode(matrix(batch.column("embedding")))), pa.binary())], ["id", "codes"])

        return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, codes binary")


class CompressedVectors:
    """Codes of a table of vectors, searched whole; distances are square roots."""

    def __init__(self, pq: ProductQuantizer, codes: DataFrame):
        self.pq, self.codes = pq, codes

    @classmethod
    def build(cls, vectors: DataFrame, m: int, bits: int = 8, sample_rows: int = 100_000, init: str = "auto", seed: int = 0, rounds: int = TRAINING_ROUNDS) -> CompressedVectors:
        order = [F.col("id")] if init == "first" else [F.xxhash64("id", F.lit(seed)), F.col("id")]
        rows = vectors.orderBy(*order).limit(sample_rows).select("embedding").collect()
        pq = ProductQuantizer.train(np.array([r.embedding for r in rows], np.float64), m, bits, rounds, init, seed)
        return cls(pq, pq.encode_frame(vectors))

    def count(self) -> int:
        return self.codes.count()

    def batch_search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Query vectors are broadcast (their tables are made by the tasks), in rounds of at most ``BROADCAST_VALUES`` numbers."""
        if k < 1:
            raise InvalidParameter("k must be at least 1")
        spark, most = self.codes.sparkSession, max(1, BROADCAST_VALUES // self.pq.dimension)
        rounds = max(1, -(-queries.count() // most))
        found = None
        for r in range(rounds):  # one round but for very many queries
            part = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r)
            one = self._scan(part.select("qid", "embedding").collect(), k, spark)
            found = one if found is None else found.union(one)
        return best_of(found, k)

    def distances(self, queries: DataFrame, digits: int | None = None) -> DataFrame:
        """``qid, id, distance`` of all pairs (rounded, if ``digits`` says so)."""
        return in_rounds(queries, self.pq.dimension, lambda part: self._pairs(part, digits))

    def _pairs(self, queries: DataFrame, digits: int | None) -> DataFrame:
        rows = queries.select("qid", "embedding").collect()
        shared = self.codes.sparkSession.sparkContext.broadcast((self.pq, [(r.qid, np.array(r.embedding, np.float64)) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pq, asked = shared.value
            for batch in batches:
                codes = pq.places(pq.loaded(batch.column("codes")))
                step = max(1, PAIRS // max(1, len(codes)))
                for a in range(0, len(asked) if len(codes) else 0, step):
                    some = asked[a : a + step]
                    d = np.sqrt(np.concatenate([pq.looked_up(pq.table(q), codes) for _, q in some]))
                    qid = np.repeat(np.array([i for i, _ in some], np.int64), len(codes))
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.concat_arrays([batch.column("id")] * len(some)), pa.array(d if digits is None else rounded(d, digits))], ["qid", "id", "distance"])

        return self.codes.mapInArrow(run, RESULT)

    def get_codes(self, id: int) -> list[int] | None:
        """The codes of one vector."""
        row = self.codes.where(F.col("id") == id).first()
        return None if row is None else self.pq.loaded(pa.array([bytes(row.codes)], pa.binary()))[0].tolist()

    def _scan(self, rows: list, k: int, spark) -> DataFrame:
        shared = spark.sparkContext.broadcast((self.pq, [(r.qid, np.array(r.embedding, np.float64)) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pq, asked = shared.value
            tables = [(qid, pq.table(q)) for qid, q in asked] if len(asked) <= 256 else None
            for batch in batches:
                codes, ids = pq.places(pq.loaded(batch.column("codes"))), batch.column("id").to_numpy()
                out = []
                for qid, table in tables or ((i, pq.table(q)) for i, q in asked):
                    d = np.sqrt(pq.looked_up(table, codes))
                    best = nearest(d, ids, k)
                    out.append((np.full(len(best), qid), ids[best], d[best]))
                q, i, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["qid", "id", "distance"])

        return self.codes.mapInArrow(run, RESULT)

    search_parallel = batch_search
