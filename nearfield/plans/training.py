"""Registered queries of trained models, updates, checks and tuning of the indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield import errors
from nearfield.functions import distances as d
from nearfield.functions import filters as f
from nearfield.functions.vectors import bad_vectors
from nearfield.operators import kmeans
from nearfield.operators.brute import BruteForceIndex
from nearfield.operators.hnsw import Graph, HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.ivfpq import IvfPqBuilder, IvfPqIndex, SearchConfig
from nearfield.operators.metadata import MetadataStore, from_json
from nearfield.operators.pq import CompressedVectors, ProductQuantizer
from nearfield.operators.protocols import FinalizableIndex, MutableVectorIndex, VectorIndex
from nearfield.operators.topk import all_pairs, knn, recall

from .queries import ADC, CELLS, DOCS, EVERY, K, PARTS, PLAIN, SCALED, WHOLE, _folder, _ivfpq, _sql_books, _sql_cells, _sql_codes, _sql_distance, _sql_ivfpq, _sql_knn, _sql_probes, _sql_reranked, _sql_top, _sql_trained, asked, documents, query, scaled, shown, table, vectors

ROUNDS = 3


def _rows(spark, rows: list, schema: str):
    return spark.createDataFrame(rows, schema)


def _raises(kind: type[Exception], run) -> bool:
    try:
        run()
    except kind:
        return True
    return False


# --- distances ---------------------------------------------------------------

ALIASES = [("L2", "euclidean"), ("l2_squared", "euclidean_squared"), ("l2sq", "euclidean_squared"), ("Cosine", "cosine"), ("IP", "dot"), ("dot_product", "dot"), ("l1", "manhattan"), ("Manhattan", "manhattan")]


@query("metric_names", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{m}')" for a, m in ALIASES) + ", ('hamming', 'error')) AS t(alias, metric)")
def metric_names(spark, sf_dir):
    def parsed(name: str) -> str:
        return "error" if _raises(errors.InvalidParameter, lambda: d.parse_metric(name)) else d.parse_metric(name)

    return _rows(spark, [(a, parsed(a)) for a, _ in [*ALIASES, ("hamming", "")]], "alias string, metric string")


@query("dimension_check", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0")
def dimension_check(spark, sf_dir):
    """Rows that a check of vectors finds: cut short, with NaN, or null."""
    e = F.col("embedding")
    odd = F.when(F.col("id") % 7 == 0, F.slice(e, 1, 63)).when(F.col("id") % 11 == 0, F.transform(e, lambda x: x * float("nan"))).when(F.col("id") % 13 != 0, e)
    return bad_vectors(vectors(spark, sf_dir).select("id", odd.alias("embedding")), 64).select("id")


_SQL_NAMES = {"vec_l2": "euclidean", "vec_l2sq": "euclidean_squared", "vec_cosine": "cosine", "vec_dot": "dot", "vec_l1": "manhattan"}


@query("sql_distances", f"WITH {SCALED} SELECT q.id AS qid, e.id AS id, " + ", ".join(f"round({_sql_distance(m, 'e.v', 'q.v')}, 6) AS {n}" for n, m in _SQL_NAMES.items()) + f" FROM e, e AS q WHERE q.id % {EVERY} = 0")
def sql_distances(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    rows.createOrReplaceTempView("nearfield_scaled")
    d.register_pairs(spark, [(r.qid, r.embedding) for r in asked(rows).collect()], "nearfield_pairs", 6)
    return spark.sql(f"SELECT qid, id, {', '.join(_SQL_NAMES)} FROM nearfield_pairs(TABLE(SELECT id, embedding FROM nearfield_scaled))")


_FIRST = "(SELECT v FROM e ORDER BY id LIMIT 1) AS q"


@query("sql_knn", f"WITH {PLAIN}, x AS (SELECT e.id, {_sql_distance('manhattan', 'e.v', 'q.v')} AS distance FROM e, {_FIRST}) SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, round(distance, 6) AS distance FROM x QUALIFY rank <= {K}")
def sql_knn(spark, sf_dir):
    """The nearest rows through a table function in SQL."""
    rows = vectors(spark, sf_dir)
    rows.select("id", F.col("embedding").cast("array<double>").alias("embedding")).createOrReplaceTempView("nearfield_rows")
    d.register_knn(spark, "nearfield_rows", K, "nearfield_knn", "l1")
    first = ", ".join(f"{x!r}D" for x in rows.orderBy("id").first().embedding)
    return spark.sql(f"SELECT rank, id, round(distance, 6) AS distance FROM nearfield_knn(array({first}))")


@query("checked_distances", f"WITH {SCALED} SELECT q.id AS qid, e.id AS id, round({_sql_distance('cosine', 'e.v', 'q.v')}, 6) AS distance FROM e, e AS q WHERE q.id % {EVERY} = 0")
def checked_distances(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    return all_pairs(rows, asked(rows), {"distance": "cosine"}, 6, strict=True)


# --- exact index ---------------------------------------------------------------


@query("knn_checked_add", _sql_knn("euclidean", PLAIN))
def knn_checked_add(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    index = BruteForceIndex(rows.where("label < 6")).add(rows.where("label >= 6"))
    return shown(index.batch_search(asked(rows), K))


@query("knn_many_queries", f"WITH {PLAIN}, x AS (SELECT q.id AS qid, e.id AS id, {_sql_distance('euclidean', 'e.v', 'q.v')} AS distance FROM e, e AS q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM x) SELECT qid, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= {K}")
def knn_many_queries(spark, sf_dir):
    """Every vector as a query."""
    rows = vectors(spark, sf_dir)
    return shown(knn(rows, rows.withColumnRenamed("id", "qid"), K))


@query("index_protocols", "SELECT * FROM (VALUES ('brute', true, true), ('ivf', true, false), ('ivf_pq', true, true), ('hnsw', true, false), ('graph', false, false)) AS t(name, searches, changes)")
def index_protocols(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    every = {"brute": BruteForceIndex(rows), "ivf": IvfIndex.build(rows, CELLS, rounds=1, init="first"), "ivf_pq": _ivfpq(rows), "hnsw": HnswIndex(rows, "euclidean", 64, 100), "graph": Graph()}
    assert isinstance(every["graph"], FinalizableIndex)
    mutable = lambda x: isinstance(x, MutableVectorIndex) and not isinstance(x, HnswIndex)  # noqa: E731 a graph takes rows but gives none back
    return _rows(spark, [(n, isinstance(x, VectorIndex), mutable(x)) for n, x in every.items()], "name string, searches boolean, changes boolean")


# --- k-means ---------------------------------------------------------------------


def _trained(spark, sf_dir):
    return kmeans.fit(vectors(spark, sf_dir), CELLS, ROUNDS, "first", converged=0.0)


def _flat(spark, centres: np.ndarray):
    rows = [(c, i + 1, float(x)) for c, row in enumerate(centres) for i, x in enumerate(row)]
    return _rows(spark, rows, "cell int, i int, x double").withColumn("x", F.round("x", 6))


@query("kmeans_rounds", f"WITH {_sql_cells(rounds=ROUNDS)} SELECT cell::INT AS cell, i::INT AS i, round(v[i], 6) AS x FROM c, range(1, 65) AS g(i)")
def kmeans_rounds(spark, sf_dir):
    return _flat(spark, _trained(spark, sf_dir))


@query("kmeans_local", f"WITH {_sql_cells(rounds=ROUNDS)} SELECT cell::INT AS cell, i::INT AS i, round(v[i], 6) AS x FROM c, range(1, 65) AS g(i)")
def kmeans_local(spark, sf_dir):
    """On one block in memory, here the whole (small) table."""
    block = np.array([r.embedding for r in vectors(spark, sf_dir).orderBy("id").collect()], np.float64)
    return _flat(spark, kmeans.fit_local(block, CELLS, ROUNDS, "first", converged=0.0))


@query("kmeans_movement", f"WITH {_sql_cells(rounds=2)} SELECT round(sum((a.v[i] - b.v[i]) * (a.v[i] - b.v[i])) / {CELLS}, 6) AS moved FROM s1 AS a JOIN s2 AS b USING (cell), range(1, 65) AS g(i)")
def kmeans_movement(spark, sf_dir):
    """What is compared with the bound of convergence: mean squared movement of the centres in a round."""
    rows = vectors(spark, sf_dir)
    one, two = (kmeans.fit(rows, CELLS, n, "first", converged=0.0) for n in (1, 2))
    return _rows(spark, [(round(float(((two - one) ** 2).sum() / CELLS), 6),)], "moved double")


@query("kmeans_converged", f"WITH {_sql_cells()} SELECT cell::INT AS cell, i::INT AS i, round(v[i], 6) AS x FROM c, range(1, 65) AS g(i)")
def kmeans_converged(spark, sf_dir):
    """A bound that the first round meets ends it, whatever the number of rounds."""
    return _flat(spark, kmeans.fit(vectors(spark, sf_dir), CELLS, 50, "first", converged=1e9))


@query("kmeans_starts", f"SELECT * FROM (VALUES ('auto', {CELLS}, true, true), ('first', {CELLS}, true, true), ('plus_plus', {CELLS}, true, true), ('random', {CELLS}, true, true)) AS t(start, n, distinct_rows, repeatable)")
def kmeans_starts(spark, sf_dir):
    """Every start gives as many different rows as there are cells, and the same ones for a seed."""
    block = np.array([r.embedding for r in vectors(spark, sf_dir).orderBy("id").collect()], np.float64)
    known, out = {x.tobytes() for x in block}, []
    for init in ("auto", "first", "plus_plus", "random"):
        got, again = (kmeans.start(block, CELLS, init, 5) for _ in range(2))
        out.append((init, len(got), {x.tobytes() for x in got} <= known and len({x.tobytes() for x in got}) == CELLS, bool((got == again).all())))
    return _rows(spark, out, "start string, n int, distinct_rows boolean, repeatable boolean")


@query("kmeans_spread", "SELECT true AS lower_with_rounds, true AS lower_with_cells")
def kmeans_spread(spark, sf_dir):
    """The summed squared distance to the nearest centre falls with more rounds and with more cells."""
    block = np.array([r.embedding for r in vectors(spark, sf_dir).orderBy("id").collect()], np.float64)

    def spread(k: int, rounds: int) -> float:
        c = kmeans.fit_local(block, k, rounds, seed=1)
        return float(((block - c[kmeans.cells_of(block, c)[:, 0]]) ** 2).sum())

    return _rows(spark, [(spread(8, 20) < spread(8, 1), spread(32, 20) < spread(8, 20))], "lower_with_rounds boolean, lower_with_cells boolean")


@query("ivf_trained", f"WITH {_sql_cells(rounds=ROUNDS)}, {_sql_probes(4)}, a AS (SELECT p.qid, own.id, {_sql_distance('euclidean', 'own.v', 'p.q')} AS distance FROM p JOIN own USING (cell))" + _sql_top())
def ivf_trained(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centres = _trained(spark, sf_dir)
    index = IvfIndex(centres, kmeans.assign(rows, centres).select("cell", "id", "embedding"), "euclidean")
    index.set_nprobe(4)
    return shown(index.batch_search(asked(rows), K))


@query("ivf_auto", _sql_knn("cosine", PLAIN))
def ivf_auto(spark, sf_dir):
    """Default start and rounds; with all cells probed the result is exact."""
    rows = vectors(spark, sf_dir)
    return shown(IvfIndex.build(rows, 16, "cosine").batch_search(asked(rows), K, 16))


# --- product quantization -----------------------------------------------------------

_TRAINED = f"WITH {PLAIN}, {_sql_trained('e')}, {_sql_codes('e')}"
_EIGHT = f"WITH {PLAIN}, {_sql_books('e', 256)}, {_sql_codes('e')}"


@query("pq_trained_codes", f"{_TRAINED} SELECT id, m::INT AS m, code::INT AS code FROM k")
def pq_trained_codes(spark, sf_dir):
    """Codes after training, one k-means for each part."""
    rows = vectors(spark, sf_dir).orderBy("id").collect()
    block = np.array([r.embedding for r in rows], np.float64)
    codes = ProductQuantizer.train(block, PARTS, 4, 1, "first").encode(block)
    return _rows(spark, [(r.id, m, int(c)) for r, own in zip(rows, codes, strict=True) for m, c in enumerate(own)], "id long, m int, code int")


@query("pq4_trained_search", _TRAINED + ADC + _sql_top())
def pq4_trained_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(CompressedVectors.build(rows, PARTS, 4, init="first", rounds=1).batch_search(asked(rows), K))


@query("pq8_search", _EIGHT + ADC + _sql_top())
def pq8_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(CompressedVectors.build(rows, PARTS, 8, init="first", rounds=0).batch_search(asked(rows), K))


@query("pq8_codes", f"{_EIGHT} SELECT id, string_agg(lpad(hex(code), 2, '0'), '' ORDER BY m) AS codes FROM k GROUP BY id")
def pq8_codes(spark, sf_dir):
    """Codes from a quantizer made before (``from_pq``)."""
    rows = vectors(spark, sf_dir)
    pq = CompressedVectors.build(rows, PARTS, 8, init="first", rounds=0).pq
    return CompressedVectors(pq, pq.encode_frame(rows)).codes.select("id", F.hex("codes").alias("codes"))


@query("pq_distance", f"{_TRAINED}{ADC} SELECT qid, id, round(distance, 6) AS distance FROM a")
def pq_distance(spark, sf_dir):
    """The distance of a query from one vector's codes, for all pairs of the stated queries."""
    rows = vectors(spark, sf_dir)
    pq = ProductQuantizer.fit(rows, PARTS, 4, 1, "first")
    return CompressedVectors(pq, pq.encode_frame(rows)).distances(asked(rows), 6)


@query("pq_recall", "SELECT * FROM (VALUES (4, true), (8, true)) AS t(bits, enough)")
def pq_recall(spark, sf_dir):
    """Recall of trained codes over ten neighbours: at least 0.35 with 4 bits, 0.5 with 8."""
    rows = vectors(spark, sf_dir)
    truth, out = knn(rows, asked(rows), K), []
    for bits, least in ((4, 0.35), (8, 0.5)):
        found = CompressedVectors.build(rows, 16, bits).batch_search(asked(rows), K)
        out.append((bits, recall(found, truth, K).agg(F.avg("recall")).first()[0] >= least))
    return _rows(spark, out, "bits int, enough boolean")


# --- inverted file of codes -----------------------------------------------------------


def _trained_ivfpq(rows, **more) -> IvfPqIndex:
    return IvfPqIndex.build(rows, CELLS, PARTS, 4, nprobe=2, init="first", rounds=1, pq_rounds=1, **WHOLE, **more)


@query("ivfpq_trained", _sql_ivfpq(K, books=_sql_trained("trr")) + _sql_top())
def ivfpq_trained(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(_trained_ivfpq(rows).batch_search(asked(rows), K))


@query("ivfpq8_search", _sql_ivfpq(K, books=_sql_books("trr", 256)) + _sql_top())
def ivfpq8_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(IvfPqIndex.build(rows, CELLS, PARTS, 8, nprobe=2, init="first", rounds=1, pq_rounds=0, **WHOLE).batch_search(asked(rows), K))


@query("ivfpq_nprobe", _sql_ivfpq(K, nprobe=5) + _sql_top())
def ivfpq_nprobe(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(_ivfpq(rows).with_nprobe(5).batch_search(asked(rows), K))


@query("ivfpq_config", _sql_ivfpq(4 * K, keep="meta.label < 5").replace(f"q.id % {EVERY} = 0", "q.id = (SELECT min(vec_id) FROM embeddings)") + " SELECT row_number() OVER (ORDER BY round(distance, 9), id) AS rank, id, round(distance, 6) AS distance FROM a QUALIFY rank <= 5")
def ivfpq_config(spark, sf_dir):
    """One query through :class:`SearchConfig`, with a filter and a time limit."""
    rows, meta = vectors(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    first = [float(x) for x in rows.orderBy("id").first().embedding]
    config = SearchConfig(5, nprobe=2, filter=f.lt("label", 5).compile(f.Typed(meta)), timeout=600)
    return shown(_ivfpq(rows).search(first, config, meta).withColumn("qid", F.lit(0))).drop("qid")


@query("ivfpq_timeout", "SELECT true AS stopped")
def ivfpq_timeout(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    first = [float(x) for x in rows.orderBy("id").first().embedding]
    return _rows(spark, [(_raises(errors.SearchTimeout, lambda: _ivfpq(rows).search(first, SearchConfig(5, timeout=0.0))),)], "stopped boolean")


@query("ivfpq_rebuild", _sql_ivfpq(K, train="id IN (SELECT vec_id FROM embeddings WHERE label <> 3)", live="meta.label <> 3") + _sql_top())
def ivfpq_rebuild(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    gone = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return shown(_ivfpq(rows).delete(gone).rebuild().with_nprobe(2).batch_search(asked(rows), K))


@query("ivfpq_counts", "SELECT count(*) FILTER (label <> 3) AS live, count(*) AS stored, count(*) FILTER (label = 3) AS tombstones, round(count(*) FILTER (label = 3) / count(*) FILTER (label <> 3), 6) AS fragmentation, false AS empty FROM embeddings")
def ivfpq_counts(spark, sf_dir):
    gone = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    index = _ivfpq(vectors(spark, sf_dir)).delete(gone)
    row = (index.count(), index.count_with_tombstones(), index.num_tombstones(), round(index.fragmentation_ratio(), 6), index.is_empty())
    return _rows(spark, [row], "live long, stored long, tombstones long, fragmentation double, empty boolean")


@query("ivfpq_stats_full", f"WITH {_sql_cells()}, z AS (SELECT c.cell, count(own.id) FILTER (own.id IN (SELECT vec_id FROM embeddings WHERE label <> 3)) AS n FROM c LEFT JOIN own USING (cell) GROUP BY 1), g AS (SELECT count(*) FILTER (label = 3) AS gone FROM embeddings) SELECT sum(n)::BIGINT AS n_vectors, count(*) FILTER (n = 0) AS empty_partitions, any_value(gone) AS n_tombstones, (sum(n) * {PARTS // 2 + 8} + {CELLS * 64 * 4} + {16 * 64 * 4} + sum(n) * {64 * 4 + 8})::BIGINT AS memory_bytes, {64 * 4 / (PARTS // 2)}::DOUBLE AS compression_ratio, round(any_value(gone) / sum(n), 6) AS tombstones_per_live, round(any_value(gone) / (sum(n) + any_value(gone)), 6) AS tombstones_per_row FROM z, g")
def ivfpq_stats_full(spark, sf_dir):
    gone = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    s = _ivfpq(vectors(spark, sf_dir)).delete(gone).stats()
    return s.select("n_vectors", "empty_partitions", "n_tombstones", "memory_bytes", "compression_ratio", F.round("tombstones_per_live", 6).alias("tombstones_per_live"), F.round("tombstones_per_row", 6).alias("tombstones_per_row"))


@query("ivfpq_limits", "SELECT * FROM (VALUES ('vectors', true), ('memory', true), ('neither', false)) AS t(lim, raised)")
def ivfpq_limits(spark, sf_dir):
    index = _ivfpq(vectors(spark, sf_dir))
    out = [("vectors", _raises(errors.VectorLimitExceeded, lambda: index.check_limits(max_vectors=10))), ("memory", _raises(errors.MemoryLimitExceeded, lambda: index.check_limits(max_bytes=10))), ("neither", _raises(errors.VectorError, index.check_limits))]
    return _rows(spark, out, "lim string, raised boolean")


@query("ivfpq_validate", "SELECT * FROM (VALUES ('code length', 3), ('cell range', 2), ('repeated id', 1), ('tombstone without row', 1), ('original''s dimension', 0)) AS t(\"check\", violations)")
def ivfpq_validate(spark, sf_dir):
    """Counts of planted faults."""
    from dataclasses import replace

    index = _ivfpq(vectors(spark, sf_dir))
    bad = _rows(spark, [(0, 10_001, b"x"), (0, 10_002, b"x"), (0, 10_003, b"xyzzy"), (-1, 10_004, b"abcd"), (CELLS, 10_005, b"abcd"), (0, 10_006, b"abcd"), (1, 10_006, b"abcd")], "cell int, id long, codes binary")
    broken = replace(index, cells=index.cells.union(bad), tombstones=_rows(spark, [(99_999,)], "id long"))
    return broken.validate()


@query("ivfpq_health", "SELECT * FROM (VALUES ('whole', 'degraded'), ('a third gone', 'degraded'), ('most gone', 'unhealthy'), ('faulty', 'unhealthy'), ('all cells probed', 'degraded'), ('good', 'healthy')) AS t(state, status)")
def ivfpq_health(spark, sf_dir):
    """Half the cells probed or fewer, none empty and few tombstones are healthy."""
    from dataclasses import replace

    rows = vectors(spark, sf_dir)
    index = _ivfpq(rows).with_nprobe(5)  # above half of the cells
    ids = rows.select("id")
    faulty = replace(index, cells=index.cells.union(_rows(spark, [(0, 10_001, b"x")], "cell int, id long, codes binary")))
    every = {"whole": index, "a third gone": index.delete(ids.where("id % 4 = 0")), "most gone": index.delete(ids.where("id % 3 <> 0")), "faulty": faulty, "all cells probed": index.with_nprobe(CELLS), "good": index.with_nprobe(4)}
    return _rows(spark, [(n, x.health()["status"]) for n, x in every.items()], "state string, status string")


@query("ivfpq_timed", f"SELECT count(*) FILTER (vec_id % {EVERY} = 0) AS queries, 2.0::DOUBLE AS cells_probed, true AS timed FROM embeddings")
def ivfpq_timed(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    _, s = _ivfpq(rows).timed_search(asked(rows), K)
    return _rows(spark, [(s["queries"], s["cells_probed"], s["total_ms"] > 0 and s["ms_a_query"] > 0)], "queries long, cells_probed double, timed boolean")


TUNED = [(500, 64, 256, 16, 1), (100, 30, 100, 6, 1), (10_000, 6, 256, 1, 1), (1_000_000, 128, 1000, 32, 1), (10**10, 768, 65_536, 192, 1)]


@query("builder_tuning", "SELECT * FROM (VALUES " + ", ".join(map(str, TUNED)) + ") AS t(n, dim, clusters, subvectors, nprobe)")
def builder_tuning(spark, sf_dir):
    out = [(n, dim, *(IvfPqBuilder().tuned(n, dim)[c] for c in ("clusters", "subvectors", "nprobe"))) for n, dim, *_ in TUNED]
    return _rows(spark, out, "n long, dim int, clusters int, subvectors int, nprobe int")


@query("builder_recall_target", "SELECT * FROM (VALUES (0.5::DOUBLE, 1), (0.8, 6), (0.9, 13), (0.95, 26), (2.0, 26)) AS t(target, nprobe)")
def builder_recall_target(spark, sf_dir):
    out = [(t, IvfPqBuilder(recall_target=t).tuned(10_000, 6)["nprobe"]) for t in (0.5, 0.8, 0.9, 0.95, 2.0)]
    return _rows(spark, out, "target double, nprobe int")


@query("builder_memory", f"SELECT ((1000000::BIGINT * (16 + 8) + 1000 * 128 * 4 + 256 * 128 * 4) // {1 << 20})::BIGINT AS mib, true AS warned")
def builder_memory(spark, sf_dir):
    import warnings

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        IvfPqBuilder(clusters=4, subvectors=4, bits=4, memory_target_mib=-1).build(vectors(spark, sf_dir))
    return _rows(spark, [(IvfPqBuilder().memory_mib(1_000_000, 128, 1000, 16), any("MiB" in str(w.message) for w in seen))], "mib long, warned boolean")


@query("builder_build", _sql_knn("euclidean", PLAIN))
def builder_build(spark, sf_dir):
    """A tuned build whose short list holds every row: re-ranked, the result is exact."""
    rows = vectors(spark, sf_dir)
    n = rows.count()
    index = IvfPqBuilder(clusters=8, bits=4, nprobe=8, rerank_factor=-(-n // K)).build(rows)
    return shown(index.batch_search(asked(rows), K))


@query("builder_errors", "SELECT * FROM (VALUES ('no vectors', true), ('dimensions differ', true), ('more cells than vectors', true), ('parts do not divide', true)) AS t(fault, raised)")
def builder_errors(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    short = rows.select("id", F.when(F.col("id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3)).alias("embedding"))
    faults = {
        "no vectors": (errors.EmptyTrainingSet, lambda: IvfPqBuilder().build(rows.limit(0))),
        "dimensions differ": (errors.DimensionMismatch, lambda: IvfPqBuilder().build(short)),
        "more cells than vectors": (errors.InvalidParameter, lambda: IvfPqBuilder(clusters=10**6).build(rows)),
        "parts do not divide": (errors.DimensionNotDivisible, lambda: IvfPqBuilder(clusters=4, subvectors=7).build(rows)),
    }
    return _rows(spark, [(n, _raises(*x)) for n, x in faults.items()], "fault string, raised boolean")


# --- graphs -------------------------------------------------------------------------------


@query("hnsw_recall", f"SELECT count(*) FILTER (vec_id % {EVERY} = 0) AS queries, true AS enough FROM embeddings")
def hnsw_recall(spark, sf_dir):
    """Mean recall over ten neighbours of at least 0.95."""
    rows = vectors(spark, sf_dir)
    found = HnswIndex.build(rows, 16, 100, shard_rows=1000).with_ef_search(100).batch_search(asked(rows), K)
    s = recall(found, knn(rows, asked(rows), K), K).agg(F.count("*"), F.avg("recall")).first()
    return _rows(spark, [(s[0], s[1] >= 0.95)], "queries long, enough boolean")


@query("hnsw_size", "SELECT count(*) AS n, 64 AS dimension, 0 AS unreachable, true AS remove_refused, true AS mismatch_refused FROM embeddings")
def hnsw_size(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    index = HnswIndex.build(rows.where("id % 2 = 0"), 16, 100).add(rows.where("id % 2 = 1"))
    data = rows.orderBy("id").collect()
    graph = Graph(16, 100).build(np.array([r.id for r in data]), np.array([r.embedding for r in data], np.float64)).finalize()
    refused = _raises(errors.NotSupported, lambda: index.remove(rows)), _raises(errors.DimensionMismatch, lambda: index.add(rows.select("id", F.slice("embedding", 1, 3).alias("embedding"))))
    return _rows(spark, [(index.count(), index.dimension, len(graph) - graph.reachable(), *refused)], "n long, dimension int, unreachable int, remove_refused boolean, mismatch_refused boolean")


@query("hnsw_levels", "SELECT true AS near_expected, true AS repeatable")
def hnsw_levels(spark, sf_dir):
    """A node has level 1 or more with probability 1/m; here over the ids 0 to 19,999."""
    graph = Graph(16, 100)
    levels = np.array([graph.level(i) for i in range(20_000)])
    return _rows(spark, [(bool(abs((levels > 0).mean() - 1 / 16) < 0.01), bool(all(graph.level(i) == levels[i] for i in range(100))))], "near_expected boolean, repeatable boolean")


# --- metadata -------------------------------------------------------------------------------


def _events(spark, sf_dir) -> MetadataStore:
    return MetadataStore(from_json(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json"))))


@query("filter_indexed", "SELECT event_id AS id FROM events WHERE (props::JSON->>'k')::BIGINT IN (7, 11, 13)")
def filter_indexed(spark, sf_dir):
    store = _events(spark, sf_dir).build_index("k", _folder(spark))
    return store.filter(f.is_in("k", [7, 11, 13]))


@query("filter_indexed_and", "SELECT event_id AS id FROM events WHERE (props::JSON->>'k')::BIGINT = 7")
def filter_indexed_and(spark, sf_dir):
    """An index answers one part, the rows it finds are checked for the other."""
    store = _events(spark, sf_dir).build_index("k")
    return store.filter(f.all_of(f.eq("k", 7), f.gt("k", 2.5)))


@query("filter_indexed_or", "SELECT event_id AS id FROM events WHERE (props::JSON->>'k')::BIGINT IN (3, 5)")
def filter_indexed_or(spark, sf_dir):
    return _events(spark, sf_dir).build_index("k").filter(f.any_of(f.eq("k", 3), f.eq("k", 5)))


@query("metadata_index_state", "SELECT * FROM (VALUES ('built', true, false), ('changed', true, true), ('rebuilt', true, false)) AS t(state, indexed, stale)")
def metadata_index_state(spark, sf_dir):
    built = _events(spark, sf_dir).build_index("k")
    changed = built.remove(spark.range(3))
    every = {"built": built, "changed": changed, "rebuilt": changed.rebuild_dirty()}
    return _rows(spark, [(n, s.is_indexed("k"), s.is_index_stale("k")) for n, s in every.items()], "state string, indexed boolean, stale boolean")


@query("metadata_insert_all", "SELECT event_id AS id FROM events WHERE event_id % 5 = 0 OR (props::JSON->>'k')::BIGINT = 7")
def metadata_insert_all(spark, sf_dir):
    """Whole maps are replaced: every fifth row has nothing but ``new``."""
    store = _events(spark, sf_dir)
    new = from_json(table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit('{"new": true}').alias("json")))
    return store.insert_all(new).filter(f.any_of(f.eq("new", True), f.eq("k", 7)))


@query("metadata_get", "SELECT (props::JSON->>'k')::BIGINT AS k, 1::BIGINT AS fields FROM events WHERE event_id = (SELECT min(event_id) FROM events)")
def metadata_get(spark, sf_dir):
    store = _events(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]
    fields = store.get(first).select(F.size("metadata").cast("long").alias("fields"))
    return store.get_field(first, "k").select(F.col("value.i").alias("k")).join(fields, F.lit(True))  # one row each


@query("metadata_matches", "SELECT * FROM (VALUES ('missing row', false), ('missing field', true), ('value', true)) AS t(asked, found)")
def metadata_matches(spark, sf_dir):
    """An id without metadata matches nothing, not even "is null"."""
    store = _events(spark, sf_dir)
    row = table(spark, sf_dir, "events").orderBy("event_id").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).first()
    out = [("missing row", store.matches(-1, f.is_null("k"))), ("missing field", store.matches(row.event_id, f.is_null("none"))), ("value", store.matches(row.event_id, f.eq("k", row.k)))]
    return _rows(spark, out, "asked string, found boolean")


@query("filter_from_json", f"WITH {DOCS} SELECT doc_id FROM m WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 1500 AND NOT coalesce(toxic = 1, false)")
def filter_from_json(spark, sf_dir):
    """A condition that went through its JSON form."""
    rows = documents(spark, sf_dir)
    condition = f.Condition.from_json(f.all_of(f.eq("lang", "en"), f.between("n_chars", 500, 1500, True, False), f.negate(f.eq("toxic", 1))).to_json())
    return rows.where(condition.compile(f.Typed(rows))).select("doc_id")


@query("filter_fields", "SELECT * FROM (VALUES ('lang', 2), ('n_chars', 1), ('toxic', 1)) AS t(field, uses)")
def filter_fields(spark, sf_dir):
    tree = f.all_of(f.eq("lang", "en"), f.negate(f.any_of(f.gt("n_chars", 5), f.ne("lang", "fr"))), f.is_null("toxic"))
    return _rows(spark, [(x,) for x in tree.fields()], "field string").groupBy("field").agg(F.count("*").cast("int").alias("uses"))
