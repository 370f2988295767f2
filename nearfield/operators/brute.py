"""Exact index over a DataFrame of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch
from nearfield.functions.distances import parse_metric

from .ivf import query_frame
from .topk import knn


class BruteForceIndex:
    """``vectors(id, embedding)``; each change gives a new index, the last row of an id wins on upsert."""

    def __init__(self, vectors: DataFrame, metric: str = "euclidean"):
        self.vectors, self.metric = vectors.select(F.col("id").cast("long").alias("id"), "embedding"), parse_metric(metric)

    @property
    def dimension(self) -> int:
        row = self.vectors.select(F.size("embedding").alias("d")).first()
        return row.d if row else 0

    def count(self) -> int:
        return self.vectors.count()

    def is_empty(self) -> bool:
        return self.vectors.isEmpty()

    def add(self, rows: DataFrame, check: bool = True) -> BruteForceIndex:
        """Appends; ids may repeat."""
        if check and (d := self.dimension):
            odd = rows.where(F.size("embedding") != d).select(F.size("embedding").alias("d")).first()
            if odd:
                raise DimensionMismatch(d, odd.d)
        return BruteForceIndex(self.vectors.unionByName(rows.select("id", "embedding")), self.metric)

    def remove(self, ids: DataFrame) -> BruteForceIndex:
        """Without the rows whose ``id`` is in ``ids``."""
        return BruteForceIndex(self.vectors.join(ids.select("id"), "id", "left_anti"), self.metric)

    def get(self, id: int) -> DataFrame:
        return self.vectors.where(F.col("id") == id)

    def batch_search(self, queries: DataFrame, k: int = 10, max_distance: float | None = None, per_query_k: bool = False) -> DataFrame:
        return knn(self.vectors, queries, k, self.metric, max_distance, per_query_k)

    def search(self, query: list[float], k: int = 10, max_distance: float | None = None) -> DataFrame:
        d = self.dimension
        if d and len(query) != d:
            raise DimensionMismatch(d, len(query))
        return self.batch_search(query_frame(self.vectors.sparkSession, query), k, max_distance).drop("qid")

    search_parallel = search_prefetch = search
