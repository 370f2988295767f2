"""Five distances as column expressions and as NumPy kernels; a smaller value is nearer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter

METRICS = ("euclidean", "euclidean_squared", "cosine", "dot", "manhattan")
_ALIASES = {"l2": "euclidean", "l2_squared": "euclidean_squared", "l2sq": "euclidean_squared", "squared_euclidean": "euclidean_squared", "ip": "dot", "dot_product": "dot", "dotproduct": "dot", "inner_product": "dot", "l1": "manhattan"}


def parse_metric(name: str) -> str:
    """The metric a name stands for, in any case; unknown names are an error."""
    key = str(name).strip().lower()
    key = _ALIASES.get(key, key)
    if key not in METRICS:
        raise InvalidParameter(f"unknown metric {name!r}")
    return key


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine(a: Column, b: Column) -> Column:
    """Distance 0 where a norm is 0."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(1 - dot(a, b) / size)


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


_COLUMN = {"euclidean": euclidean, "euclidean_squared": squared, "cosine": cosine, "dot": dot_distance, "manhattan": manhattan}


def distance(metric: str, a: Column, b: Column) -> Column:
    return _COLUMN[parse_metric(metric)](a, b)


def checked(metric: str, a: Column, b: Column) -> Column:
    """:func:`distance`, or an error in the task for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), distance(metric, a, b)).otherwise(F.raise_error(F.lit("dimension mismatch")))


def distances(metric: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of all rows from one query, in double precision."""
    rows, query = rows.astype(np.float64, copy=False), query.astype(np.float64, copy=False)
    if metric == "manhattan":
        return np.abs(rows - query).sum(axis=1)
    if metric == "dot":
        return -np.einsum("ij,j->i", rows, query)
    if metric == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", rows, rows) * (query @ query))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size == 0, 0.0, 1 - np.einsum("ij,j->i", rows, query) / size)
    out = ((rows - query) ** 2).sum(axis=1)
    return np.sqrt(out) if metric == "euclidean" else out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to ``digits`` decimals, halves away from zero (NumPy's own rounding takes halves to even)."""
    y = np.abs(x) * 10.0**digits
    whole = np.floor(y)
    with np.errstate(invalid="ignore"):
        whole += y - whole >= 0.5
    return np.where(np.isfinite(whole), np.copysign(whole / 10.0**digits, x), x)


def paired(measures: Sequence[str], rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """For each measure (a metric, or ``similarity`` for :func:`cosine_similarity`) the matrix of all rows against all queries.

    Components are added in their order, as in the column expressions, so the values are the same to the last bit.
    """
    shape = len(rows), len(queries)
    spread, product = {"euclidean", "euclidean_squared"} & set(measures), {"dot", "cosine", "similarity"} & set(measures)
    sq, far, dots, t, u = (np.zeros(shape) for _ in range(5))
    for x, y in zip(rows.T[:, :, None], queries.T[:, None, :], strict=True):
        if spread or "manhattan" in measures:
            np.subtract(x, y, out=t)
        if spread:
            sq += np.multiply(t, t, out=u)
        if "manhattan" in measures:
            far += np.abs(t, out=t)
        if product:
            dots += np.multiply(x, y, out=u)
    if {"cosine", "similarity"} & set(measures):
        a, b = (np.cumsum(z * z, axis=1)[:, -1] if z.shape[1] else np.zeros(len(z)) for z in (rows, queries))
        size = np.sqrt(a[:, None] * b[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            near = dots / size
    one = {
        "euclidean": lambda: np.sqrt(sq), "euclidean_squared": lambda: sq, "dot": lambda: -dots, "manhattan": lambda: far,
        "cosine": lambda: np.where(size == 0, 0.0, 1 - near), "similarity": lambda: np.where(size == 0, 0.0, near),
    }
    return [one[m]() for m in measures]


def shortlist(metric: str, rows: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, rows that hold its ``k`` nearest: one matrix product ranks, and a margin covers its rounding."""
    n = len(rows)
    if n <= 4 * k or metric == "manhattan":
        return [np.arange(n)] * len(queries)
    r, q = rows.astype(np.float32), queries.astype(np.float32)
    product = q @ r.T
    size = np.einsum("ij,ij->i", r, r)
    if metric == "dot":
        score, scale = -product, np.sqrt(size.max() * np.einsum("ij,ij->i", q, q))
    elif metric == "cosine":
        norm = np.sqrt(size[None, :] * np.einsum("ij,ij->i", q, q)[:, None])
        score = np.where(norm == 0, -1, -product / np.where(norm == 0, 1, norm))
        scale = np.ones(len(q))
    else:
        score, scale = size - 2 * product, size.max() + 2 * np.abs(product).max(axis=1)
    if not np.isfinite(score).all():
        return [np.arange(n)] * len(queries)
    limit = np.partition(score, k - 1, axis=1)[:, k - 1] + 1e-5 * scale + 1e-12
    return [np.flatnonzero(s <= x) for s, x in zip(score, limit, strict=True)]


#: Pairs in one block of a result that holds all pairs.
PAIRS = 65_536


def pair_blocks(measures: Sequence[str], ids: pa.Array, column: pa.Array, qids: np.ndarray, queries: list[np.ndarray | None], digits: int | None, strict: bool) -> Iterator[list[pa.Array]]:
    """Columns ``qid, id`` and the measures (rounded, if ``digits`` says so) for all pairs, in blocks.

    Where vectors differ in length, or one is missing, values are null; if ``strict``, other lengths are an error.
    """
    width = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    asked = np.array([-1 if q is None else len(q) for q in queries])
    if strict and (odd := (set(width.tolist()) | set(asked.tolist())) - {-1}) and len(odd) > 1 and len(asked) and len(width):
        raise DimensionMismatch(max(odd), min(odd))
    step = max(1, min(len(qids), PAIRS))
    rows = max(1, PAIRS // step)
    for b in range(0, len(qids), step):
        wide = asked[b : b + step]
        for a in range(0, len(ids), rows):
            own = width[a : a + rows]
            values, known = [np.zeros((len(own), len(wide))) for _ in measures], np.zeros((len(own), len(wide)), bool)
            for w in (set(own.tolist()) & set(wide.tolist())) - {-1}:
                i, j = np.flatnonzero(own == w), np.flatnonzero(wide == w)
                x = column.take(pa.array(a + i)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), w)
                y = np.array([queries[b + k] for k in j], np.float64).reshape(len(j), w)
                for v, d in zip(values, paired(measures, x, y), strict=True):
                    v[np.ix_(i, j)] = d if digits is None else rounded(d, digits)
                known[np.ix_(i, j)] = True
            null = None if known.all() else ~known.ravel()
            place = pa.array(np.repeat(np.arange(a, a + len(own)), len(wide)))
            yield [pa.array(np.tile(qids[b : b + step], len(own))), ids.take(place), *(pa.array(v.ravel(), mask=null) for v in values)]


_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
_SIZE = "sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"
SQL_FUNCTIONS = {
    "vec_l2": f"sqrt({_SUM.format('(x - y) * (x - y)')})",
    "vec_l2sq": _SUM.format("(x - y) * (x - y)"),
    "vec_cosine": f"if({_SIZE} = 0, 0D, 1 - {_SUM.format('x * y')} / {_SIZE})",
    "vec_dot": f"-{_SUM.format('x * y')}",
    "vec_l1": _SUM.format("abs(x - y)"),
}


def register(spark) -> None:
    """SQL functions ``vec_l2``, ``vec_l2sq``, ``vec_cosine``, ``vec_dot`` and ``vec_l1`` on arrays; SQL inlines their
    expressions. Arrays of different lengths are an error.
    """
    for name, body in SQL_FUNCTIONS.items():
        checked_body = f"if(size(a) <> size(b), raise_error('dimension mismatch'), {body})"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {checked_body}")


def register_pairs(spark, queries: list[tuple[int, list[float]]], name: str = "vec_pairs", digits: int | None = None) -> None:
    """A SQL table function ``name(TABLE(rows))`` over ``id, embedding`` (arrays of doubles): a row for each row and query, with
    ``qid, id`` and what the functions of :func:`register` give, by their names; made in blocks of pairs.
    """
    shared = spark.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), [None if v is None else np.array(v, np.float64) for _, v in queries]))
    columns = ["qid", "id", *SQL_FUNCTIONS]
    measures = ["euclidean", "euclidean_squared", "cosine", "dot", "manhattan"]

    @F.arrow_udtf(returnType="qid long, id long, " + ", ".join(f"{n} double" for n in SQL_FUNCTIONS))
    class Pairs:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for block in pair_blocks(measures, batch.column("id"), batch.column("embedding"), *shared.value, digits, True):
                yield pa.table(dict(zip(columns, block, strict=True)))

    spark.udtf.register(name, Pairs)


def register_knn(spark, view: str, k: int = 10, name: str = "knn", metric: str = "euclidean") -> None:
    """A SQL table function ``name(query)`` over the view's ``id, embedding``: ``rank, id, distance`` of the ``k`` nearest rows.

    SQL inlines it as an order with a limit, so each partition keeps its best ``k`` rows before they meet.
    """
    if k < 1:
        raise InvalidParameter("k must be at least 1")
    register(spark)
    by_metric = dict(zip(("euclidean", "euclidean_squared", "cosine", "dot", "manhattan"), SQL_FUNCTIONS, strict=True))
    inner = f"SELECT id, {by_metric[parse_metric(metric)]}(embedding, query) AS distance FROM {view} WHERE id IS NOT NULL AND embedding IS NOT NULL ORDER BY distance, id LIMIT {int(k)}"
    ranked = f"SELECT CAST(row_number() OVER (ORDER BY distance, id) AS BIGINT), id, distance FROM ({inner})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>) RETURNS TABLE (rank BIGINT, id BIGINT, distance DOUBLE) RETURN {ranked}")
