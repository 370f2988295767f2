"""Known answers, properties and round trips of the vector operators."""

import math
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield import errors
from nearfield.functions import filters as f
from nearfield.functions import distances as distances_module
from nearfield.functions.distances import METRICS, cosine_similarity, distance, distances, parse_metric, rounded, shortlist
from nearfield.functions.vectors import bad_vectors, random_vectors
from nearfield.operators import ivfpq, kmeans, topk
from nearfield.operators import pq as pq_module
from nearfield.operators.brute import BruteForceIndex
from nearfield.operators.hnsw import Graph, HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.ivfpq import IvfPqBuilder, IvfPqIndex, SearchConfig
from nearfield.operators.metadata import MetadataStore, from_json
from nearfield.operators.pq import CompressedVectors, ProductQuantizer, pack4, unpack4
from nearfield.operators.topk import knn, recall
from nearfield.plans import queries as core
from nearfield.plans import storage, training  # noqa: F401 their queries join those of core
from nearfield.sources import config, snapshot, vecfiles
from nearfield.sources.catalog import Catalog
from nearfield.sources.config import CollectionConfig
from nearfield.sources.oplog import OpLog, state
from nearfield.sources.vecfiles import ground_truth, read_fvecs, read_ivecs, records, synthetic, write_vecs


def one(metric, a, b):
    return distances(metric, np.array([a], float), np.array(b, float))[0]


def test_known_distances():
    assert one("euclidean", [0, 0], [3, 4]) == 5 and one("manhattan", [0, 0], [3, 4]) == 7
    assert one("dot", [1, 0], [1, 0]) == -1 and one("cosine", [1, 0], [0, 1]) == 1 and one("cosine", [2, 0], [2, 0]) == 0
    assert one("cosine", [0] * 8, [1] * 8) == 0
    assert one("manhattan", [1, -2, 3], [-1, 2, -3]) == 12
    assert parse_metric("L2_Squared") == "euclidean_squared" and parse_metric("IP") == "dot" and parse_metric("l1") == "manhattan"
    with pytest.raises(errors.InvalidParameter):
        parse_metric("hamming")


@given(st.sampled_from(["euclidean", "dot", "cosine", "manhattan"]), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_shortlist_holds_the_nearest(metric, k, seed):
    rng = np.random.default_rng(seed)
    rows, q = rng.standard_normal((300, 7)), rng.standard_normal((3, 7))
    for near, x in zip(shortlist(metric, rows, q, k), q, strict=True):
        assert set(np.argsort(distances(metric, rows, x))[:k]) <= set(near)


def test_knn_equals_brute_force_on_both_ways(spark, monkeypatch):
    rows, asked = synthetic(spark, 300, 7, 12, seed=3)
    x = {r.id: np.array(r.embedding, float) for r in rows.collect()}
    q = {r.qid: np.array(r.embedding, float) for r in asked.collect()}
    want = {k: [i for _, i in sorted((float(((v - w) ** 2).sum()), i) for i, v in x.items())[:5]] for k, w in q.items()}

    def got(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
            out.setdefault(r.qid, []).append(r.id)
        return out

    assert got(knn(rows, asked, 5)) == want
    from nearfield.operators import topk

    monkeypatch.setattr(topk, "BROADCAST_VALUES", 1)
    monkeypatch.setattr(topk, "BLOCK", 3)
    assert got(knn(rows, asked, 5)) == want
    assert knn(rows, asked.limit(0), 5).count() == 0 and knn(rows.limit(0), asked, 5).count() == 0
    with pytest.raises(errors.InvalidParameter):
        knn(rows, asked, 0)


def test_range_search_has_no_limit_of_rows(spark, monkeypatch, tmp_path):
    rows, asked = synthetic(spark, 300, 7, 12, seed=3)
    x = {r.id: np.array(r.embedding, float) for r in rows.collect()}
    q = {r.qid: np.array(r.embedding, float) for r in asked.collect()}
    want = {(k, i) for k, w in q.items() for i, v in x.items() if np.sqrt(((v - w) ** 2).sum()) <= 3}
    from nearfield.operators import topk
    from nearfield.plans import queries

    assert {(r.qid, r.id) for r in knn(rows, asked, None, max_distance=3).collect()} == want and len(want) > 60
    monkeypatch.setattr(topk, "BROADCAST_VALUES", 1)
    monkeypatch.setattr(topk, "BLOCK", 3)
    assert {(r.qid, r.id) for r in knn(rows, asked, None, max_distance=3).collect()} == want
    with pytest.raises(errors.InvalidParameter):
        knn(rows, asked, None)
    monkeypatch.undo()
    copies = spark.range(100_010).selectExpr("id as vec_id", "if(id < 100005, array(1f, 2f), array(9f, 9f)) as embedding", "0 as label")
    copies.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(queries, "asked", lambda rows: rows.where("id = 0").selectExpr("id as qid", "embedding"))
    assert queries.knn_radius(spark, str(tmp_path)).agg({"*": "count", "rank": "max"}).first()[:] == (100_005, 100_005)


def test_brute_force_changes(spark):
    rows = spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "id long, embedding array<float>")
    index = BruteForceIndex(rows)
    assert index.search([5.0] * 4, 3).first().id == 5 and index.search([5.0] * 4, 3).first().distance == 0
    less = index.remove(spark.createDataFrame([(5,)], "id long"))
    assert less.count() == 9 and 5 not in {r.id for r in less.search([5.0] * 4, 9).collect()}
    assert less.add(rows.where("id = 5")).count() == 10
    with pytest.raises(errors.DimensionMismatch):
        index.search([1.0], 1)
    with pytest.raises(errors.DimensionMismatch):
        index.add(spark.createDataFrame([(11, [1.0])], "id long, embedding array<float>"))
    assert bad_vectors(spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (3, None)], "id long, embedding array<float>"), 2).count() == 3


@given(st.integers(1, 40), st.integers(9, 60), st.integers(0, 2**32 - 1))
def test_cells_equal_those_by_differences(count, k, seed):
    rng = np.random.default_rng(seed)
    centres = np.round(rng.standard_normal((k, 3)), 1)  # with ties
    rows = np.concatenate([np.round(rng.standard_normal((50, 3)), 1), centres[:5], 1e8 + rng.standard_normal((5, 3))])
    assert (kmeans.cells_of(rows, centres, count) == kmeans._exact_cells(rows, centres, min(count, k))).all()


def test_vectors_of_another_length_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, embedding array<float>")
    with pytest.raises(Exception, match="expected dimension 2"):
        knn(rows, asked, 1).collect()
    with pytest.raises(errors.DimensionMismatch):
        knn(rows, rows.withColumnRenamed("id", "qid"), 1)
    assert knn(rows.where("id = 1"), asked, 1).first().id == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, float(i), str(i), None if i % 2 else i) for i in range(9)], "id long, x double, name string, y int").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    every = {f.eq("name", "3"): "EqualTo", f.gt("x", 2): "GreaterThan", f.gte("id", 2): "GreaterThanOrEqual", f.lt("y", 5): "LessThan", f.lte("id", 5): "LessThanOrEqual", f.between("id", 2, 5): "GreaterThanOrEqual", f.is_in("id", [1, 2]): "In", f.starts_with("name", "3"): "StringStartsWith", f.exists("y"): "IsNotNull"}
    for condition, name in every.items():
        plan = rows.where(condition.compile(f.Typed(rows)))._jdf.queryExecution().executedPlan().toString()
        assert f"{name}(" in plan.split("PushedFilters: ")[1].split("\n")[0], condition
    ids = lambda c: sorted(r.id for r in rows.where(c.compile(f.Typed(rows))).collect())
    assert ids(f.negate(f.gt("y", 3))) == [0, 1, 2, 3, 5, 7] and ids(f.negate(f.any_of(f.is_in("y", [2]), f.lt("id", 4)))) == [4, 5, 6, 7, 8]
    assert ids(f.is_in("id", [2.0, "2", 3])) == [3] and ids(f.not_in("y", [2, 4])) == [0, 1, 3, 5, 6, 7, 8]


def test_lookups_equal_scans(spark, tmp_path):
    rows = spark.createDataFrame([(i, '{"a": %s, "b": "%s", "c": %s}' % ((i % 3, 0.0, -0.0, "true", "null")[i % 5], i % 2, i)) for i in range(40)], "id long, json string")
    plain = MetadataStore(from_json(rows))
    store = plain.build_index("a", str(tmp_path / "a")).build_index("b")
    ids = lambda s, c: sorted(r.id for r in s.filter(c).collect())
    for c in (f.eq("a", 1), f.eq("a", 0.0), f.eq("a", -0.0), f.eq("a", True), f.eq("a", None), f.eq("a", float("nan")), f.is_in("a", [0, True]), f.is_in("a", []), f.eq("b", "1"), f.all_of(f.eq("a", 0), f.eq("b", "0")), f.all_of(f.eq("b", "1"), f.gt("c", 20)), f.any_of(f.eq("a", 1), f.eq("b", "1")), f.any_of(f.eq("a", 1), f.gt("c", 30)), f.all_of(f.any_of(f.eq("a", 1), f.eq("a", True)), f.negate(f.eq("b", "0")))):
        assert ids(store, c) == ids(plain, c), c
    assert store._looked_up(f.any_of(f.eq("a", 1), f.gt("c", 30)))[0] is None and store._looked_up(f.all_of(f.eq("a", 1), f.gt("c", 30)))[1] is not None


def test_kmeans(spark):
    rows = random_vectors(spark, 300, 8, seed=1)
    local = np.array([r.embedding for r in rows.orderBy("id").collect()])
    assert np.allclose(kmeans.fit(rows, 5, 3, "first"), kmeans.fit_local(local, 5, 3, "first"))
    c = np.array([[0, 0], [10, 0], [5, 10]], float)
    assert kmeans.cells_of(np.array([[0.1, 0.1]]), c, 2)[0, 0] == 0
    assert len(kmeans.start(np.zeros((9, 2)), 4)) == 4
    with pytest.raises(errors.InsufficientVectors):
        kmeans.fit_local(local[:3], 5)
    with pytest.raises(errors.EmptyTrainingSet):
        kmeans.fit(rows.limit(0), 2)


@given(st.lists(st.integers(0, 15), min_size=1, max_size=9))
def test_nibbles(codes):
    assert unpack4(pack4(np.array(codes)), len(codes)).tolist() == codes


def test_pq():
    rows = np.random.default_rng(0).uniform(-1, 1, (400, 8))
    pq = ProductQuantizer.train(rows, 4, 8, 3)
    codes = pq.encode(rows[:5])
    for r, c in zip(rows[:5], codes, strict=True):
        assert pq.distance(rows[7], c) == pytest.approx(math.sqrt(((rows[7] - pq.decode(c[None, :])[0]) ** 2).sum()))
        assert ((r - pq.decode(c[None, :])[0]) ** 2).sum() < 0.2
    with pytest.raises(errors.DimensionNotDivisible):
        ProductQuantizer.train(rows, 3)
    with pytest.raises(errors.EmptyTrainingSet):
        ProductQuantizer.train(rows[:0], 4)


def test_pq_of_a_table(spark, monkeypatch):
    rows, asked = synthetic(spark, 700, 7, 12, seed=8)
    block = np.array([r.embedding for r in rows.orderBy("id").collect()], np.float64)
    centres = block[:5]
    rest = block - centres[kmeans.cells_of(block, centres)[:, 0]]
    for rounds in (0, 1, 6):
        assert np.allclose(ProductQuantizer.fit(rows, 3, 4, rounds, "first").books, ProductQuantizer.train(block, 3, 4, rounds, "first").books)
        assert np.allclose(ProductQuantizer.fit(rows, 3, 4, rounds, "first", centres=centres).books, ProductQuantizer.train(rest, 3, 4, rounds, "first").books)
    pq = ProductQuantizer.train(block, 3, 4, 1, "first")
    queries, codes = {r.qid: np.array(r.embedding, float) for r in asked.collect()}, pq.encode(block)
    want = {(q, i): pq.distance(x, codes[i]) for q, x in queries.items() for i in range(700)}
    compressed = CompressedVectors(pq, pq.encode_frame(rows))
    found = lambda: {(r.qid, r.id): r.distance for r in compressed.distances(asked).collect()}
    assert found() == pytest.approx(want)
    monkeypatch.setattr(topk, "BROADCAST_VALUES", 30)  # in rounds
    monkeypatch.setattr(pq_module, "PAIRS", 10)
    assert found() == pytest.approx(want) and compressed.distances(asked, 2).count() == 4900
    assert rounded(np.array([0.125, -0.125, 2.0, np.inf]), 2).tolist() == [0.13, -0.13, 2.0, np.inf]


def test_all_distances_of_codes_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(ProductQuantizer, "train", None)
    monkeypatch.setattr(training, "_rows", None)
    assert core.QUERIES["pq_distance"](spark, "/root/testdata/sf0.001").count() == 10 * 500


@pytest.fixture(scope="module")
def indexed(spark):
    rows, asked = synthetic(spark, 500, 10, 32, seed=5)
    return rows, asked, IvfPqIndex.build(rows, 8, 4, 4, nprobe=8, rerank_factor=4)


def test_ivfpq_recall_and_updates(spark, indexed):
    rows, asked, index = indexed
    truth = ground_truth(rows, asked, 10)
    plain, again = (np.mean([r.recall for r in recall(i.batch_search(asked, 10), truth, 10).collect()]) for i in (index.with_reranking(1), index))
    assert plain <= again
    gone = spark.range(50).withColumnRenamed("id", "id")
    less = index.delete(gone)
    assert (less.count(), less.num_tombstones(), less.count_with_tombstones()) == (450, 50, 500)
    assert not {r.id for r in less.batch_search(asked, 20).collect()} & set(range(50))
    assert less.compact().num_tombstones() == 0 and less.compact().count_with_tombstones() == 450
    back = less.insert(rows.where("id < 50"))
    assert back.count() == 500 and back.num_tombstones() == 0 and back.cells.where("id = 3").count() == 1
    assert index.delete(spark.range(300)).health()["status"] == "unhealthy" and less.rebuild().count() == 450
    assert all(r.violations == 0 for r in index.validate().collect())
    with pytest.raises(errors.VectorLimitExceeded):
        index.check_limits(max_vectors=10)
    with pytest.raises(errors.MemoryLimitExceeded):
        index.check_limits(max_bytes=10)
    query = [float(x) for x in asked.first().embedding]
    assert index.search(query, SearchConfig(5)).count() == 5 and index.search(query, SearchConfig(5, timeout=60)).count() == 5
    with pytest.raises(errors.SearchTimeout):
        index.search(query, SearchConfig(5, timeout=0))
    with pytest.raises(errors.InvalidParameter):
        index.with_nprobe(0)


def test_models_of_the_queries_are_fitted_on_all_rows(spark):
    rows = synthetic(spark, 31_000, 1, 16, seed=4)[0]
    for index in (core._ivfpq(rows), core._ivfpq(rows).rebuild()):
        assert np.allclose(index.centres, kmeans.fit(rows, core.CELLS, 1, "first"), atol=1e-12)
    index = training._trained_ivfpq(rows)
    block = np.array([r.embedding for r in rows.orderBy("id").collect()], np.float64)
    rest = block - index.centres[kmeans.cells_of(block, index.centres)[:, 0]]
    assert np.allclose(index.pq.books, ProductQuantizer.train(rest, core.PARTS, 4, 1, "first").books, atol=1e-9)


def test_samples_come_as_arrow(spark, monkeypatch):
    rows = synthetic(spark, 300, 1, 12, seed=4)[0]
    x = {r.id: r.embedding for r in rows.collect()}
    order = [r.id for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").select("id").collect()]
    short = rows.select("id", F.when(F.col("id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 6)).alias("embedding"))
    empty = rows.limit(0)
    monkeypatch.setattr(type(rows), "collect", None)
    assert (kmeans.drawn(rows, 50, "auto", 3) == np.array([x[i] for i in order[:50]], np.float64)).all()
    assert (kmeans.drawn(rows, 50, "first", 3) == np.array([x[i] for i in range(50)], np.float64)).all()
    with pytest.raises(errors.DimensionMismatch):
        kmeans.drawn(short, 50, "first", 3)
    with pytest.raises(errors.EmptyTrainingSet):
        kmeans.drawn(empty, 50, "first", 3)


def test_short_list_of_all_rows(spark, indexed, monkeypatch):
    rows, asked, index = indexed
    index, meta = index.with_reranking(50).with_nprobe(5).delete(spark.range(9)), spark.range(300)
    keep = {"metadata": meta, "condition": F.col("id") % 2 == 0}
    found = lambda **x: [(r.qid, r.rank, r.id, round(r.distance, 9)) for r in index.batch_search(asked, 10, **x).orderBy("qid", "rank").collect()]
    want = found(), found(**keep), found(max_distance=2.0)
    monkeypatch.setattr(ivfpq, "SHORTLIST_ROWS", 100)
    monkeypatch.setattr(IvfPqIndex, "_scored", None)  # no list of all pairs is made
    assert (found(), found(**keep), found(max_distance=2.0)) == want


def test_builder():
    assert IvfPqBuilder().tuned(500, 64) == {"clusters": 256, "subvectors": 16, "nprobe": 1}
    assert IvfPqBuilder(recall_target=0.95).tuned(10_000, 6)["nprobe"] == 26 and IvfPqBuilder(auto_tune=False).tuned(100, 64)["clusters"] == 10


def test_hnsw(spark):
    rows, asked = synthetic(spark, 300, 5, 16, seed=2)
    data = rows.orderBy("id").collect()
    graph = Graph(16, 200).build(np.array([r.id for r in data]), np.array([r.embedding for r in data]))
    assert graph.reachable() == 300
    truth = ground_truth(rows, asked, 10)
    for metric in ("euclidean", "dot", "cosine", "manhattan"):
        x = np.array([r.embedding for r in data] * 4) + np.random.default_rng(0).standard_normal((1200, 16))
        graph = Graph(8, 50, metric).bulk(np.arange(1200), x)
        assert graph.reachable() == 1200
        hits = [len({i for _, i in graph.search(q, 10, 100)} & set(np.argsort(distances(metric, x, q), kind="stable")[:10].tolist())) for q in x[:40] * 0.9]
        assert np.mean(hits) >= 8, metric
    assert Graph().bulk(np.zeros(0, int), np.zeros((0, 3))).search(np.zeros(3), 3, 10) == []
    index = HnswIndex.build(rows, 16, 200, shard_rows=100)
    found = index.batch_search(asked, 10)
    assert np.mean([r.recall for r in recall(found, truth, 10).collect()]) >= 0.9
    with pytest.raises(errors.NotSupported):
        index.remove(asked)
    with pytest.raises(errors.InvalidParameter):
        Graph(1)


def test_checked_graph_search_misses_nothing(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((600, 16)), np.zeros((1, 16))])
    x = np.concatenate([x, x[:40]])  # equal vectors tie
    for metric in METRICS:
        graph = Graph(4, 10, metric).bulk(np.arange(len(x)), x)
        far = [distances(metric, x, q) for q in x[:150]]
        want = [[int(i) for i in np.lexsort((np.arange(len(x)), d))[:10]] for d in far]
        assert [[i for _, i in found] for found in graph.checked_search(x[:150], 10, 10)] == want, metric
        assert [[i for _, i in graph.search(q, 10, 10)] for q in x[:150]] != want, metric
    assert len(Graph(4, 10).bulk(np.arange(3), x[:3]).checked_search(x[:2], 10, 10)[1]) == 3
    rows, asked = synthetic(spark, 400, 30, 24, seed=6)
    index, seen = HnswIndex.build(rows, 4, 4, shard_rows=200).with_check().with_ef_search(1), lambda df: sorted((r.qid, r.rank, r.id) for r in df.collect())
    assert seen(index.batch_search(asked, 10)) == seen(knn(rows, asked, 10))


def test_filters_on_tagged_metadata(spark):
    rows = spark.createDataFrame([(1, '{"name":"Alice","age":30,"score":85.5,"active":true,"tags":["x","y"],"none":null}'), (2, "{}"), (3, "broken"), (4, '{"age":30.0}')], "id long, json string")
    store = MetadataStore(from_json(rows))
    ids = lambda c: sorted(r.id for r in store.filter(c).collect())
    assert ids(f.eq("age", 30)) == [1] and ids(f.eq("age", 30.0)) == [4] and ids(f.between("age", 30.0, 30)) == [1, 4]
    assert ids(f.ne("age", 30)) == [2, 3, 4] and ids(f.eq("none", None)) == [1] and ids(f.exists("none")) == [] and ids(f.is_null("none")) == [1, 2, 3, 4]
    assert ids(f.contains("tags", "y")) == [1] and ids(f.starts_with("name", "Al")) == [1] and ids(f.gt("name", 3)) == []
    assert ids(f.negate(f.gt("age", 5))) == [2, 3] and ids(f.all_of()) == [1, 2, 3, 4] and ids(f.any_of()) == []
    assert ids(f.is_in("score", [85.5])) == [1] and ids(f.not_in("active", [True])) == [2, 3, 4]
    tree = f.all_of(f.eq("age", 30), f.negate(f.contains("tags", "z")))
    assert f.Condition.from_json(tree.to_json()) == tree and tree.fields() == ["age", "tags"]
    indexed = store.build_index("age")
    assert not indexed.is_index_stale("age") and indexed.remove(rows.where("id = 1")).dirty_fields() == ["age"]


def test_vector_files(spark, tmp_path, monkeypatch):
    write_vecs([[1, 2], [3, 4]], str(tmp_path / "a.fvecs"))
    write_vecs([[7, 8, 9]], str(tmp_path / "a.ivecs"), "<i4")
    assert [(r.id, r.embedding) for r in read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert read_ivecs(spark, str(tmp_path / "a.ivecs")).first().embedding == [7, 8, 9]
    rows = np.random.default_rng(0).standard_normal((1000, 5)).astype("<f4")
    write_vecs(list(rows), str(tmp_path / "b.fvecs"))
    monkeypatch.setattr(vecfiles, "WHOLE_BYTES", 100)
    got = read_fvecs(spark, str(tmp_path / "b.fvecs")).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and all(r.embedding == rows[r.id].tolist() for r in got)
    write_vecs([[1, 2, 3], [4, 5], *[[1, 2, 3]] * 20], str(tmp_path / "c.ivecs"), "<i4")
    with pytest.raises(errors.CorruptedData):
        read_ivecs(spark, str(tmp_path / "c.ivecs"))
    with pytest.raises(errors.NotFound):
        read_ivecs(spark, str(tmp_path / "none.ivecs"))
    data = (tmp_path / "a.fvecs").read_bytes()
    assert len(records(data + b"\1", "<f4")) == 2
    with pytest.raises(errors.CorruptedData):
        records(data[:-1], "<f4")


def test_snapshots(spark, indexed, tmp_path):
    rows, asked, index = indexed
    root = str(tmp_path / "s")
    assert snapshot.save(index.delete(spark.range(5)), root, spark) == 1
    back = snapshot.load(root, spark)
    assert back.num_tombstones() == 5 and back.batch_search(asked, 5).count() == 50
    assert snapshot.save(IvfIndex.build(rows, 4, rounds=2), root, spark) == 2 and isinstance(snapshot.load(root, spark), IvfIndex)
    path = tmp_path / "s" / "manifest.json"
    (tmp_path / "s" / ".manifest.json.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace("euclidean", "manhattan"))
    with pytest.raises(errors.ChecksumMismatch):
        snapshot.load(root, spark)
    path.write_text("junk")
    with pytest.raises(errors.CorruptedData):
        snapshot.load(root, spark)
    with pytest.raises(errors.NotFound):
        snapshot.load(str(tmp_path / "none"), spark)


def test_log(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    ops = spark.createDataFrame([(0, "insert", 1, [1.0]), (1, "insert", 2, [2.0]), (2, "delete", 1, None)], "n int, op string, id long, vector array<float>")
    assert log.append(ops) == 2 and OpLog(spark, str(tmp_path / "log")).next_sequence() == 3
    assert [r.id for r in state(log.entries()).collect()] == [2]
    assert log.append(ops.where("n = 0")) == 3 and log.checkpoint(2) == 4 and log.last_checkpoint() == 2 and log.pending() == 1
    assert log.truncate_to_checkpoint() == 3 and sorted(r.seq for r in log.entries().collect()) == [3, 4]


def test_truncation_cut_short_leaves_the_old_log(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    ops = spark.createDataFrame([(i, "insert", i, [1.0]) for i in range(6)], "n int, op string, id long, vector array<float>")
    log.append(ops)
    log.checkpoint(3)
    log.append(ops.where("n < 2"))
    seen = lambda x: sorted(r.seq for r in x.entries().collect())
    write, log.store.write = log.store.write, lambda *_: (_ for _ in ()).throw(OSError("cut"))
    with pytest.raises(OSError):
        log.truncate_to_checkpoint()
    assert seen(OpLog(spark, log.store.root)) == list(range(9))
    log.store.write = write
    delete, log.store.delete = log.store.delete, lambda *_: (_ for _ in ()).throw(OSError("cut"))
    with pytest.raises(OSError):
        log.truncate_to_checkpoint()
    log.store.delete = delete
    assert seen(OpLog(spark, log.store.root)) == list(range(4, 9)) and OpLog(spark, log.store.root).next_sequence() == 9
    assert log.append(ops.where("n = 0")) == 9 and log.checkpoint(9) == 10 and log.truncate_to_checkpoint() == 6 and seen(log) == [10]
    assert log.truncate_to_checkpoint() == 0 and log.last_checkpoint() == 9


def test_graph_arrays(spark):
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((200, 8))
    graph = Graph(8, 50).build(np.arange(150), rows[:150])
    again = Graph.of_row(graph.finalize().row(0), "euclidean")
    assert graph.is_finalized() and len(again) == 150 and again.search(rows[3], 5, 50) == graph.search(rows[3], 5, 50)
    graph.build(np.arange(150, 200), rows[150:])
    assert not graph.is_finalized() and len(graph) == 200 and graph.search(rows[170], 1, 50)[0][1] == 170
    with pytest.raises(errors.DimensionMismatch):
        graph.build(np.array([1]), np.zeros((1, 3)))


def test_many_probes_meet_cells_in_a_shuffle(spark, indexed, monkeypatch):
    from nearfield.operators import ivf, topk

    rows, asked, index = indexed
    one = lambda i: sorted(tuple(r) for r in i.batch_search(asked, 7).collect())
    plain = IvfIndex.build(rows, 8, rounds=2, nprobe=3)
    want = one(index), one(plain)
    monkeypatch.setattr(ivf, "BROADCAST_VALUES", 1)
    monkeypatch.setattr(ivf, "CELL_ROWS", 10)
    assert (one(index), one(plain)) == want
    graph = HnswIndex.build(rows, 8, 50, shard_rows=200)
    want = one(graph)
    from nearfield.operators import hnsw

    monkeypatch.setattr(hnsw, "BROADCAST_VALUES", 100)
    assert one(graph) == want and topk.BROADCAST_VALUES > 100


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    c = catalog.create("docs", CollectionConfig(metric="l2"))
    with pytest.raises(errors.AlreadyExists):
        catalog.create("docs")
    rows = spark.createDataFrame([(i, [float(i), 0.0], '{"k": %d}' % (i % 2)) for i in range(6)], "id long, embedding array<float>, metadata string")
    c.upsert(rows)
    c.upsert(rows.where("id = 1"))
    assert c.count() == 6 and c.delete(spark.createDataFrame([(2,), (99,)], "id long")) == 1
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "qid long, embedding array<float>")
    assert {r.id for r in c.search(asked, 2).collect()} == {1, 3}
    assert {r.id for r in c.search(asked, 5, condition=f.eq("k", 0)).collect()} == {0, 4}
    c.checkpoint()
    assert c.count() == 5
    c.upsert(rows.where("id = 2"))
    assert catalog.get("docs").count() == 6 and c.compact() > 0 and c.count() == 6
    c.build_index()
    assert c.search(asked, 1, with_metadata=True).first().id == 2 and c.info()["health"] == "healthy"
    with pytest.raises(errors.DimensionMismatch):
        c.upsert(spark.createDataFrame([(9, [1.0])], "id long, embedding array<float>"))
    assert catalog.list() == ["docs"] and catalog.drop("docs") and not catalog.drop("docs")
    with pytest.raises(errors.InvalidConfig):
        CollectionConfig.from_toml("[ivf]\nnprobe = 99\nn_clusters = 4")


def test_all_pairs_equal_the_columns(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [-0.1, 0.7]), (None, [0.3, 0.2])], "id long, embedding array<double>")
    asked = rows.where("id is not null").withColumnRenamed("id", "qid")
    pairs = asked.select("qid", F.col("embedding").alias("q")).join(rows, F.lit(True))
    a, b = F.col("embedding"), F.col("q")
    measures = {m: m for m in METRICS} | {"similarity": "similarity"}
    seen = lambda df: sorted((tuple(r) for r in df.collect() if {r[0], r[1]} != {2, 4}), key=str)  # noqa: E731 a zero and another length: null, where the columns say 0
    want = seen(pairs.select("qid", "id", *(distance(m, a, b) for m in METRICS), cosine_similarity(a, b)))
    assert seen(topk.all_pairs(rows, asked, measures)) == want
    monkeypatch.setattr(topk, "BROADCAST_VALUES", 4)  # in rounds
    monkeypatch.setattr(distances_module, "PAIRS", 3)
    assert seen(topk.all_pairs(rows, asked, measures)) == want
    with pytest.raises(Exception, match="DimensionMismatch"):
        topk.all_pairs(rows, asked, {"distance": "cosine"}, strict=True).collect()
    even = rows.where("id in (1, 2, 6)")
    even.createOrReplaceTempView("even_rows")
    distances_module.register(spark)
    distances_module.register_pairs(spark, [(r.id, r.embedding) for r in even.collect()], "even_pairs")
    got = spark.sql("SELECT * FROM even_pairs(TABLE(SELECT id, embedding FROM even_rows))")
    assert seen(got) == seen(spark.sql(f"SELECT q.id, r.id, {', '.join(f'{n}(r.embedding, q.embedding)' for n in distances_module.SQL_FUNCTIONS)} FROM even_rows AS q CROSS JOIN even_rows AS r"))


@pytest.mark.parametrize("name", ["pairwise_distances", "checked_distances", "sql_distances"])
def test_pairs_are_made_in_blocks(spark, name):
    """Column expressions over a join of all pairs took microseconds a pair and metric."""
    df = core.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not {"NestedLoopJoin", "CartesianProduct"} & set(re.findall(r"NestedLoopJoin|CartesianProduct", df._jdf.queryExecution().toString())) and df.count() == 5000


@pytest.mark.parametrize("name", ["catalog_search", "catalog_index", "catalog_validation"])
def test_collections_of_more_rows_than_a_batch(spark, monkeypatch, name):
    monkeypatch.setattr(config, "MAX_BATCH", 40)
    assert core.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def equals_sql(spark, name, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    got = core.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({core.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["catalog_ivfpq", "catalog_per_query_k", "catalog_index_filtered", "catalog_max_distance", "catalog_info", "catalog_metadata"])
def test_collections_of_more_rows_than_a_batch_equal_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(config, "MAX_BATCH", 40)
    assert equals_sql(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["ivfpq_config", "ivfpq_delete", "ivfpq_rebuild", "ivfpq_scan_counts", "ivfpq_stats", "ivfpq_trained", "ivfpq_filtered", "ivfpq_insert", "ivfpq_rerank"])
def test_ivfpq_queries_equal_their_sql_beyond_the_samples(spark, monkeypatch, name):
    build = IvfPqIndex.build.__func__
    monkeypatch.setattr(build, "__defaults__", tuple(64 if x in (30_000, 100_000) else x for x in build.__defaults__))
    assert equals_sql(spark, name, "/root/testdata/sf0.01")


def test_streamed_operations(spark, tmp_path):
    from nearfield.streaming.upkeep import stream_operations

    src = str(tmp_path / "src")
    spark.createDataFrame([(i, "insert", i, [1.0]) for i in range(4)], "n int, op string, id long, vector array<float>").write.parquet(src)
    stream = spark.readStream.schema("n int, op string, id long, vector array<float>").parquet(src)
    log = OpLog(spark, str(tmp_path / "log"))
    stream_operations(stream, log, str(tmp_path / "chk")).awaitTermination()
    assert log.next_sequence() == 4
