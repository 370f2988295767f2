"""Vector columns: seeded random vectors, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vector(id: Column, dimension: int, seed: int = 0) -> Column:
    """Uniform in [-1, 1), the same for the same id and seed."""
    unit = lambda i: F.pmod(F.xxhash64(id, i, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 51)) - 1
    return F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: unit(i).cast("float"))


def random_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 0, first_id: int = 0) -> DataFrame:
    """``id, embedding`` of ``n`` rows."""
    return spark.range(first_id, first_id + n).select("id", random_vector(F.col("id"), dimension, seed).alias("embedding"))


def bad_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows without an id, or whose vector is null, of another length, or holds null, NaN or infinity."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("id").isNull() | (F.col("id") < 0) | F.col("embedding").isNull() | (F.size("embedding") != dimension) | F.coalesce(odd, F.lit(True)))
