"""Registered queries of files, logs, snapshots, collections and configuration."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from nearfield import errors
from nearfield.functions import filters as f
from nearfield.operators.brute import BruteForceIndex
from nearfield.operators.hnsw import HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.sources import snapshot
from nearfield.sources.catalog import Catalog
from nearfield.sources.config import CollectionConfig, EngineConfig, IvfConfig, PqConfig
from nearfield.sources.oplog import OpLog, state
from nearfield.sources.vecfiles import ground_truth, load_dataset, read_fvecs, read_ivecs, synthetic, write_vecs

from .queries import CELLS, EVERY, K, PLAIN, _folder, _ivfpq, _sql_cells, _sql_ivfpq, _sql_knn, _sql_top, asked, query, shown, table, vectors
from .training import _raises, _rows

# --- vector files ------------------------------------------------------------


@query("synthetic_vectors", "SELECT 1000 AS n, 12 AS dimension, true AS in_range, true AS same_again, 5 AS queries, 1000 AS first_query")
def synthetic_vectors(spark, sf_dir):
    rows, queries = synthetic(spark, 1000, 5, 12, seed=3)
    low, high = rows.select(F.min(F.array_min("embedding")), F.max(F.array_max("embedding"))).first()
    again = rows.join(synthetic(spark, 1000, 5, 12, seed=3)[0].withColumnRenamed("embedding", "other"), "id").where("embedding <> other").isEmpty()
    s = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    t = queries.agg(F.count("*"), F.min("qid")).first()
    return _rows(spark, [(s[0], s[1], -1 <= low < -0.9 and 0.9 < high < 1, again, t[0], t[1])], "n int, dimension int, in_range boolean, same_again boolean, queries int, first_query int")


def _written(spark, sf_dir, ids: list[int]) -> str:
    """A small file of some vectors, in the folder that executors see."""
    folder = _folder(spark).removeprefix("file:")
    os.makedirs(folder)
    rows = vectors(spark, sf_dir).where(F.col("id").isin(ids)).orderBy("id").collect()
    write_vecs([r.embedding for r in rows], f"{folder}/base.fvecs")
    return folder


@query("fvecs", f"WITH {PLAIN} SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS id, round(list_sum(v), 6) AS total, len(v)::INT AS dimension FROM e WHERE id % {EVERY} = 0")
def fvecs(spark, sf_dir):
    ids = [r.id for r in vectors(spark, sf_dir).where(F.col("id") % EVERY == 0).select("id").collect()]
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return read_fvecs(spark, f"{_written(spark, sf_dir, ids)}/base.fvecs").select("id", F.round(total, 6).alias("total"), F.size("embedding").alias("dimension"))


@query("ivecs_truth", f"WITH {PLAIN} SELECT (qid // {EVERY})::BIGINT AS qid, rank, id FROM ({_sql_knn('euclidean', PLAIN)})")
def ivecs_truth(spark, sf_dir):
    """A set in the usual three files: base, queries, true neighbours."""
    rows = vectors(spark, sf_dir)
    truth = ground_truth(rows, asked(rows), K).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x")).orderBy("qid").collect()
    queries = asked(rows).orderBy("qid").collect()
    folder = _written(spark, sf_dir, [q.qid for q in queries])
    write_vecs([[x.id for x in r.x] for r in truth], f"{folder}/truth.ivecs", "<i4")
    _, _, got = load_dataset(spark, f"{folder}/base.fvecs", f"{folder}/base.fvecs", f"{folder}/truth.ivecs")
    return got.select("qid", F.col("rank").cast("long").alias("rank"), "id")


@query("ivecs", "SELECT * FROM (VALUES (0::BIGINT, 6::BIGINT), (1, 9)) AS t(id, total)")
def ivecs(spark, sf_dir):
    folder = _folder(spark).removeprefix("file:")
    os.makedirs(folder)
    write_vecs([[1, 2, 3], [4, 5]], f"{folder}/a.ivecs", "<i4")
    return read_ivecs(spark, f"{folder}/a.ivecs").select("id", F.aggregate("embedding", F.lit(0), lambda s, x: s + x).cast("long").alias("total"))


# --- the log --------------------------------------------------------------------


def _log(spark, sf_dir) -> OpLog:
    """Inserts of the first 400 vectors, deletes of every fourth, a checkpoint after the inserts, then 50 more."""
    rows, log = vectors(spark, sf_dir), OpLog(spark, f"{_folder(spark)}/log")
    log.append(rows.where("id < 400").select(F.lit("insert").alias("op"), "id", F.col("embedding").alias("vector"), F.format_string('{"n": %d}', "id").alias("metadata")))
    log.append(rows.where("id < 400 and id % 4 = 0").select(F.lit("delete").alias("op"), "id"))
    log.checkpoint(399)
    log.append(rows.where("id >= 400 and id < 450").select(F.lit("insert").alias("op"), "id", F.col("embedding").alias("vector")))
    return log


@query("oplog_append", "SELECT seq, op, id, last_applied_seq FROM (SELECT vec_id AS seq, 'insert' AS op, vec_id AS id, NULL::BIGINT AS last_applied_seq FROM embeddings WHERE vec_id < 400 UNION ALL SELECT 400 + vec_id // 4, 'delete', vec_id, NULL FROM embeddings WHERE vec_id < 400 AND vec_id % 4 = 0 UNION ALL SELECT 500, 'checkpoint', NULL, 399 UNION ALL SELECT 101 + vec_id, 'insert', vec_id, NULL FROM embeddings WHERE vec_id >= 400 AND vec_id < 450)")
def oplog_append(spark, sf_dir):
    return _log(spark, sf_dir).entries().select("seq", "op", "id", "last_applied_seq")


@query("oplog_truncate", "SELECT seq, op FROM (SELECT 400 + vec_id // 4 AS seq, 'delete' AS op FROM embeddings WHERE vec_id < 400 AND vec_id % 4 = 0 UNION ALL SELECT 500, 'checkpoint' UNION ALL SELECT 101 + vec_id, 'insert' FROM embeddings WHERE vec_id >= 400 AND vec_id < 450 UNION ALL SELECT 551, 'delete')")
def oplog_truncate(spark, sf_dir):
    """Numbers go on after a truncation, also in a log that is opened anew."""
    log = _log(spark, sf_dir)
    log.truncate_to_checkpoint()
    again = OpLog(spark, log.store.root)
    again.append(_rows(spark, [("delete", 1)], "op string, id long"))
    return again.entries().select("seq", "op")


@query("oplog_counts", "SELECT 551::BIGINT AS next, 399::BIGINT AS checkpointed, 150::BIGINT AS pending, 400::BIGINT AS dropped, 551::BIGINT AS next_after")
def oplog_counts(spark, sf_dir):
    log = _log(spark, sf_dir)
    row = log.next_sequence(), log.last_checkpoint(), log.pending(), log.truncate_to_checkpoint(), log.next_sequence()
    return _rows(spark, [row], "next long, checkpointed long, pending long, dropped long, next_after long")


@query("oplog_state", "SELECT vec_id AS id, CASE WHEN vec_id < 400 THEN '{\"n\": ' || vec_id || '}' END AS metadata FROM embeddings WHERE vec_id < 450 AND (vec_id >= 400 OR vec_id % 4 <> 0)")
def oplog_state(spark, sf_dir):
    return state(_log(spark, sf_dir).entries()).select("id", "metadata")


@query("oplog_gap", "SELECT vec_id AS seq FROM embeddings WHERE vec_id < 400")
def oplog_gap(spark, sf_dir):
    """What follows missing numbers is not replayed."""
    log = _log(spark, sf_dir)
    log.store.delete("batch-" + f"{400:020d}")
    return log.entries().select("seq")


# --- snapshots ---------------------------------------------------------------------


@query("snapshot_ivfpq", _sql_ivfpq(K, live="meta.label <> 3") + _sql_top())
def snapshot_ivfpq(spark, sf_dir):
    """Search on a saved and loaded index with tombstones."""
    rows, folder = vectors(spark, sf_dir), _folder(spark)
    snapshot.save(_ivfpq(rows).delete(table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))), folder, spark)
    return shown(snapshot.load(folder, spark).batch_search(asked(rows), K))


@query("snapshot_ivf", f"WITH {_sql_cells()} SELECT cell::INT AS cell, id FROM own")
def snapshot_ivf(spark, sf_dir):
    folder = _folder(spark)
    snapshot.save(IvfIndex.build(vectors(spark, sf_dir), CELLS, rounds=1, init="first"), folder, spark)
    return snapshot.load(folder, spark).cells.select("cell", "id")


@query("snapshot_hnsw", _sql_knn("euclidean", PLAIN))
def snapshot_hnsw(spark, sf_dir):
    """A graph read from its arrays; with all nodes visited the search is exact."""
    rows, folder = vectors(spark, sf_dir), _folder(spark)
    snapshot.save(HnswIndex.build(rows, 16, 100, shard_rows=200).with_ef_search(1_000_000), folder, spark)
    return shown(snapshot.load(folder, spark).batch_search(asked(rows), K))


@query("snapshot_versions", "SELECT 1 AS first, 2 AS second, 'ivf_pq' AS kind, true AS rerank, false AS metadata, true AS bad_sum, true AS bad_text, true AS bad_table, true AS newer")
def snapshot_versions(spark, sf_dir):
    """Versions and flags of the manifest, and what damage raises."""
    rows, folder = vectors(spark, sf_dir), _folder(spark)
    store, load = snapshot.Store(spark, folder), lambda: snapshot.load(folder, spark)
    numbers = snapshot.save(BruteForceIndex(rows), folder, spark), snapshot.save(_ivfpq(rows), folder, spark)
    got, text = snapshot.manifest(folder, spark), store.read("manifest.json")
    raised = []
    for kind, body in ((errors.ChecksumMismatch, text.replace("euclidean", "manhattan")), (errors.CorruptedData, "junk")):
        store.write("manifest.json", body)
        raised.append(_raises(kind, load))
    store.write("manifest.json", text)
    spark.read.parquet(f"{folder}/v2/cells").limit(3).write.parquet(f"{folder}/v2/other")
    store.delete("v2/cells")
    spark.read.parquet(f"{folder}/v2/other").write.parquet(f"{folder}/v2/cells")
    raised.append(_raises(errors.ChecksumMismatch, load))
    import zlib

    newer = json.dumps(json.loads(json.loads(text)["body"]) | {"version": snapshot.VERSION + 1}, sort_keys=True)
    store.write("manifest.json", json.dumps({"crc32": zlib.crc32(newer.encode()), "body": newer}))
    raised.append(_raises(errors.UnsupportedVersion, load))
    row = (*numbers, snapshot.TYPES[got["type"]], got["flags"]["rerank"], got["flags"]["metadata"], *raised)
    return _rows(spark, [row], "first int, second int, kind string, rerank boolean, metadata boolean, bad_sum boolean, bad_text boolean, bad_table boolean, newer boolean")


@query("snapshot_space", "SELECT true AS refused")
def snapshot_space(spark, sf_dir):
    rows, folder, old = vectors(spark, sf_dir), _folder(spark), snapshot.Store.free
    snapshot.Store.free = lambda self: 1000
    try:
        return _rows(spark, [(_raises(errors.InsufficientDiskSpace, lambda: snapshot.save(BruteForceIndex(rows), folder, spark)),)], "refused boolean")
    finally:
        snapshot.Store.free = old


# --- collections ----------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.format_string('{"label": %d}', "label").alias("metadata"))


def _collection(spark, sf_dir, config: CollectionConfig | None = None):
    """All vectors but label 9 upserted (a load of a whole table, so in bulk), label 3 deleted."""
    c = Catalog(spark, _folder(spark)).create("rows", config)
    rows = _labelled(spark, sf_dir)
    c.upsert(rows.where("metadata <> '{\"label\": 9}'"), bulk=True)
    c.delete(rows.where("metadata = '{\"label\": 3}'").select("id"))
    return c


def _without(*labels: int) -> str:
    return f"e.id IN (SELECT vec_id FROM embeddings WHERE label NOT IN ({', '.join(map(str, labels))}))"


@query("catalog_search", _sql_knn("euclidean", PLAIN, where=_without(3, 9)))
def catalog_search(spark, sf_dir):
    return shown(_collection(spark, sf_dir).search(asked(vectors(spark, sf_dir)), K))


@query("catalog_filtered", _sql_knn("euclidean", PLAIN, where="e.id IN (SELECT vec_id FROM embeddings WHERE label < 5 AND label <> 3)"))
def catalog_filtered(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c.checkpoint()
    return shown(c.search(asked(vectors(spark, sf_dir)), K, condition=f.lt("label", 5)))


@query("catalog_per_query_k", _sql_knn("euclidean", PLAIN, "1 + qid % 7", _without(3, 9)))
def catalog_per_query_k(spark, sf_dir):
    return shown(_collection(spark, sf_dir).search(asked(vectors(spark, sf_dir)).withColumn("k", 1 + F.col("qid") % 7), K, per_query_k=True))


@query("catalog_max_distance", _sql_knn("euclidean", PLAIN, where=_without(3, 9), per_query="distance <= 1.2"))
def catalog_max_distance(spark, sf_dir):
    return shown(_collection(spark, sf_dir).search(asked(vectors(spark, sf_dir)), K, max_distance=1.2))


@query("catalog_metadata", "SELECT qid, rank, x.id, json_extract_string(x.m, '$.label')::INT AS label FROM (" + _sql_knn("euclidean", PLAIN, where=_without(3, 9)) + ") AS f JOIN (SELECT vec_id AS id, json_object('label', label) AS m FROM embeddings) AS x USING (id)")
def catalog_metadata(spark, sf_dir):
    found = _collection(spark, sf_dir).search(asked(vectors(spark, sf_dir)), K, with_metadata=True)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


_INDEXED = CollectionConfig(index_type="ivf", dimension=64, ivf=IvfConfig(CELLS, CELLS, 3))


@query("catalog_index", _sql_knn("euclidean", PLAIN, where="e.id IN (SELECT vec_id FROM embeddings WHERE label <> 5 AND label <> 3)"))
def catalog_index(spark, sf_dir):
    """An index (all cells probed) with rows that came and went after it was built, and a checkpoint since."""
    c, rows = _collection(spark, sf_dir, _INDEXED), _labelled(spark, sf_dir)
    c.build_index()
    c.checkpoint()
    c.upsert(rows.where("metadata = '{\"label\": 9}'"), bulk=True)
    c.delete(rows.where("metadata = '{\"label\": 5}'").select("id"))
    return shown(c.search(asked(vectors(spark, sf_dir)), K))


@query("catalog_index_filtered", _sql_knn("euclidean", PLAIN, where="e.id IN (SELECT vec_id FROM embeddings WHERE label < 5 AND label <> 3)"))
def catalog_index_filtered(spark, sf_dir):
    c = _collection(spark, sf_dir, _INDEXED)
    c.build_index()
    return shown(c.search(asked(vectors(spark, sf_dir)), K, condition=f.lt("label", 5)))


@query("catalog_ivfpq", _sql_knn("euclidean", PLAIN, where=_without(3, 9)))
def catalog_ivfpq(spark, sf_dir):
    """Codes, re-ranked over all rows of all cells."""
    n = vectors(spark, sf_dir).count()
    c = _collection(spark, sf_dir, CollectionConfig(index_type="ivf_pq", dimension=64, ivf=IvfConfig(CELLS, CELLS, 3), pq=PqConfig(16, 4, -(-n // K))))
    c.build_index()
    return shown(c.search(asked(vectors(spark, sf_dir)), K))


@query("catalog_compact", "SELECT count(*) FILTER (label <> 3) AS n, count(*) FILTER (label <> 9) + count(*) FILTER (label = 3) AS dropped, 0::BIGINT AS pending FROM embeddings WHERE label <> 9")
def catalog_compact(spark, sf_dir):
    c = _collection(spark, sf_dir)
    dropped = c.compact()
    return _rows(spark, [(c.count(), dropped, c.log.pending())], "n long, dropped long, pending long")


@query("catalog_info", "SELECT 'rows' AS name, count(*) AS n, 64 AS dimension, 'euclidean' AS metric, 'brute_force' AS index_type, (count(*) * 256)::BIGINT AS memory_bytes, 'healthy' AS health FROM embeddings WHERE label NOT IN (3, 9)")
def catalog_info(spark, sf_dir):
    i = _collection(spark, sf_dir).info()
    return _rows(spark, [(i["name"], i["count"], i["dimension"], i["metric"], i["index_type"], i["memory_bytes"], i["health"])], "name string, n long, dimension int, metric string, index_type string, memory_bytes long, health string")


@query("catalog_stats", "SELECT count(*) AS n, 2::BIGINT AS searches, 1::BIGINT AS upserts, 1::BIGINT AS deletes, true AS timed FROM embeddings WHERE label NOT IN (3, 9)")
def catalog_stats(spark, sf_dir):
    """Counters outlive the object that counted."""
    c = _collection(spark, sf_dir)
    for _ in range(2):
        c.search(asked(vectors(spark, sf_dir)), K)
    c.checkpoint()
    again = type(c)(spark, c.root)
    return again.stats().select(F.col("n_vectors").alias("n"), "searches", "upserts", "deletes", (F.col("mean_search_ms") > 0).alias("timed"))


@query("catalog_names", "SELECT * FROM (VALUES ('listed', 'a,b,c'), ('second', 'b'), ('after drop', 'a,c'), ('taken', 'true'), ('missing', 'true'), ('bad name', 'true'), ('reopened', 'a')) AS t(asked, answer)")
def catalog_names(spark, sf_dir):
    catalog = Catalog(spark, _folder(spark))
    for n in ("b", "a", "c"):
        catalog.create(n)
    out = [("listed", ",".join(catalog.list())), ("second", ",".join(catalog.list(1, 1)))]
    catalog.drop("b")
    out.append(("after drop", ",".join(catalog.list())))
    faults = (("taken", errors.AlreadyExists, lambda: catalog.create("a")), ("missing", errors.NotFound, lambda: catalog.get("b")), ("bad name", errors.InvalidConfig, lambda: catalog.create("a/b")))
    out += [(n, str(_raises(kind, run)).lower()) for n, kind, run in faults]
    out.append(("reopened", Catalog(spark, catalog.store.root).get("a").name))
    return _rows(spark, out, "asked string, answer string")


@query("catalog_validation", "SELECT * FROM (VALUES ('dimension', true), ('not finite', true), ('negative id', true), ('batch size', true), ('k', true)) AS t(fault, raised)")
def catalog_validation(spark, sf_dir):
    c = _collection(spark, sf_dir)
    rows = lambda id, x: _rows(spark, [(id, x)], "id long, embedding array<float>")
    many = spark.range(100_001).select("id", F.array(F.lit(1.0)).alias("embedding"))
    faults = {
        "dimension": (errors.DimensionMismatch, lambda: c.upsert(rows(1, [1.0]))),
        "not finite": (errors.InvalidParameter, lambda: c.upsert(rows(1, [float("nan")] * 64))),
        "negative id": (errors.InvalidParameter, lambda: c.upsert(rows(-1, [1.0] * 64))),
        "batch size": (errors.InvalidConfig, lambda: c.upsert(many)),
        "k": (errors.InvalidConfig, lambda: c.search(asked(vectors(spark, sf_dir)), 100_000)),
    }
    return _rows(spark, [(n, _raises(*x)) for n, x in faults.items()], "fault string, raised boolean")


# --- configuration ----------------------------------------------------------------------


@query("config_defaults", "SELECT 1024 AS cells, 16 AS nprobe, 16 AS m, 200 AS ef_construction, 50 AS ef_search, 32 AS subvectors, 8 AS bits, 4 AS rerank, 8589934592 AS max_memory_bytes, './data/wal' AS log_folder")
def config_defaults(spark, sf_dir):
    e = EngineConfig()
    i = e.default_index
    row = (i.ivf.n_clusters, i.ivf.nprobe, i.hnsw.m, i.hnsw.ef_construction, i.hnsw.ef_search, i.pq.n_subvectors, i.pq.bits, i.pq.rerank_factor, e.max_memory_bytes, e.log_folder())
    return _rows(spark, [row], "cells int, nprobe int, m int, ef_construction int, ef_search int, subvectors int, bits int, rerank int, max_memory_bytes long, log_folder string")


@query("config_toml", "SELECT * FROM (VALUES ('nprobe', 'error'), ('ef', 'error'), ('bits', 'error'), ('memory', 'error'), ('syntax', 'error'), ('unknown', 'error'), ('good', '7'), ('again', 'same')) AS t(text, result)")
def config_toml(spark, sf_dir):
    texts = {
        "nprobe": "[default_index.ivf]\nn_clusters = 4\nnprobe = 5", "ef": "[default_index.hnsw]\nm = 16\nef_construction = 8", "bits": "[default_index.pq]\nbits = 5",
        "memory": "max_memory_bytes = 0", "syntax": "= 1", "unknown": "colour = 1", "good": "[default_index.ivf]\nnprobe = 7",
    }
    out = [(n, "error" if _raises(errors.InvalidConfig, lambda t=t: EngineConfig.from_toml(t)) else str(EngineConfig.from_toml(t).default_index.ivf.nprobe)) for n, t in texts.items()]
    good = EngineConfig.from_toml(texts["good"])
    out.append(("again", "same" if EngineConfig.from_toml(good.to_toml()) == good else "other"))
    return _rows(spark, out, "text string, result string")


@query("type_codes", "SELECT * FROM (VALUES (1, 'ivf_pq'), (2, 'hnsw'), (3, 'ivf'), (4, 'brute_force')) AS t(code, kind)")
def type_codes(spark, sf_dir):
    return _rows(spark, sorted(snapshot.TYPES.items()), "code int, kind string")


@query("error_names", "SELECT unnest(['AlreadyExists', 'ChecksumMismatch', 'ConvergenceFailure', 'CorruptedData', 'DimensionMismatch', 'DimensionNotDivisible', 'EmptyIndex', 'EmptyTrainingSet', 'IndexNotBuilt', 'InsufficientDiskSpace', 'InsufficientVectors', 'InvalidConfig', 'InvalidParameter', 'MemoryLimitExceeded', 'MetadataFieldNotFound', 'MetadataTypeMismatch', 'NotFound', 'NotSupported', 'SearchTimeout', 'SerializationError', 'StaleIndex', 'StorageError', 'UnsupportedVersion', 'VectorLimitExceeded', 'VectorNotFound']) AS name")
def error_names(spark, sf_dir):
    found = [(n,) for n, x in vars(errors).items() if isinstance(x, type) and issubclass(x, errors.VectorError) and x is not errors.VectorError]
    return _rows(spark, found, "name string")


# --- streams ------------------------------------------------------------------------------


@query("stream_log", "SELECT user_id AS id, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stream_log(spark, sf_dir):
    """A stream of operations into a log, then its state."""
    from nearfield.streaming.upkeep import stream_operations

    folder = _folder(spark)
    log = OpLog(spark, f"{folder}/log")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    table(spark, sf_dir, "events").write.parquet(f"{folder}/in")
    files = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    stream = files.select(op.alias("op"), F.col("user_id").alias("id"), F.col("event_type").alias("metadata"), F.col("event_id").alias("n"))
    stream_operations(stream, log, f"{folder}/state").awaitTermination()
    return state(log.entries()).select("id", F.col("metadata").alias("op"))


@query("stream_counts", "SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    """Windowed counts of a stream, here added up over the windows (all closed by a last, empty step)."""
    from nearfield.streaming.upkeep import running_counts

    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("op"))
    return running_counts(rows).groupBy("op").agg(F.sum("n").alias("n"))
