import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorlake.functions import text as T
from vectorlake.functions import vectors as V
from vectorlake.operators import cells, evaluate, exact, filters, fusion, graph, grid, ivf, sparse
from vectorlake.plans import planner
from vectorlake.sources import vecs
from vectorlake.types import CollectionConfig, GridConfig, HnswConfig, InvalidConfig, InvalidFilter, IvfConfig, metric


def table(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def asked(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, q array<double>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    a, b, zero = V.vector([0.5, -0.3, 0.8]), V.vector([-0.5, 0.3, -0.8]), V.vector([0, 0, 0])
    assert value(spark, V.l2_squared(a, a)) == 0 and abs(value(spark, V.cosine_distance(a, a))) < 1e-12
    assert value(spark, V.negative_dot(a, b)) > value(spark, V.negative_dot(a, a))
    assert value(spark, V.cosine_distance(a, zero)) == 1.0
    assert abs(value(spark, V.l2_distance(a, b)) ** 2 - value(spark, V.l2_squared(a, b))) < 1e-12
    assert math.isinf(value(spark, V.score(F.lit(-1.0)))) and value(spark, V.score(F.lit(1.0))) == 0.5
    assert value(spark, V.normalize(zero)) == [0, 0, 0]


@pytest.mark.parametrize("name", ["l2", "cosine", "dot"])
def test_batch_matches_scalar(spark, name):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(30, 5)), rng.normal(size=(4, 5))
    x[3] = 0
    points, queries = table(spark, x), asked(spark, *q)
    got = {(r["query_id"], r["vec_id"]): r["distance"] for r in exact.knn_join(points, queries, 30, name).collect()}
    slow = points.join(queries, F.lit(True)).select("query_id", "vec_id", V.distance(name, F.col("embedding"), F.col("q")).alias("d")).collect()
    assert len(got) == 120 and all(abs(got[r["query_id"], r["vec_id"]] - r["d"]) < 1e-6 for r in slow)


def test_metric_names():
    assert metric("euclidean") == "l2" and metric("ip") == metric("dot_product") == "dot"
    with pytest.raises(InvalidConfig):
        metric("hamming")


def test_codes(spark):
    v = V.vector([0.5, -0.3, 0.8])
    back = value(spark, V.decode(V.encode(v, "u8"), "u8"))
    assert max(abs(a - b) for a, b in zip(back, [0.5, -0.3, 0.8])) < 0.02
    assert value(spark, V.encode(V.vector([-5, 5]), "u8")) == [0, 255] and value(spark, V.encode(V.vector([-5, 5]), "u16")) == [0, 65535]
    assert value(spark, V.coded_distance("l2", v, V.encode(v, "u8"), "u8")) < 0.01
    assert value(spark, V.quantized_distance("l2", v, V.encode(V.vector([1]), "u8"), "u8")) > 1e300
    tiers = [value(spark, V.tier_of_layer(F.lit(i), 3)) for i in range(3)]
    assert tiers == ["u8", "u16", "f32"] and [value(spark, V.bytes_per_dimension(F.lit(t))) for t in tiers] == [1, 2, 4]
    assert value(spark, V.percentile(F.array(*map(F.lit, [5, 1, 3])), 0.5)) == 3


def test_exact_search(spark):
    points = table(spark, [(0, 0), (1, 0), (5, 5), (1, 0)])
    assert [r["vec_id"] for r in exact.knn(points, [0.9, 0], 1, "l2").collect()] == [1]  # the tie goes to the smaller id
    assert exact.knn(points, [0.9, 0], 0, "l2").count() == 0 and exact.knn_join(points, asked(spark, (0, 0)), 0).count() == 0
    got = exact.knn_join(points, asked(spark, (0.9, 0)), 3, "l2").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 0]
    assert exact.knn(points, [0.9, 0], 5, "l2", F.col("vec_id") > 1).count() == 2
    with pytest.raises(Exception, match="dimension"):
        exact.checked(points, 3).collect()


def test_large_query_sets_meet_points_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points, queries = table(spark, rng.normal(size=(50, 4))), asked(spark, *rng.normal(size=(9, 4)))
    want = sorted(map(tuple, exact.knn_join(points, queries, 5).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(exact, "QUERY_BYTES", 100)
    assert sorted(map(tuple, exact.knn_join(points, queries, 5).select("query_id", "vec_id", "rank").collect())) == want


ROWS = [(1, '{"tag": "x", "n": 1}'), (2, '{"tag": "y", "n": 10}'), (3, '{"tag": "z", "n": 5}'), (4, '{"n": 1.0, "a.b": [1, 2]}'), (5, None), (6, '{"tag": null, "flag": true}')]


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ({"tag": "x"}, [1]),
        ({"tag": {"$ne": "x"}}, [2, 3, 4, 5, 6]),
        ({"n": {"$gt": 5}}, [2]),
        ({"n": {"$gte": 5}}, [2, 3]),
        ({"n": {"$lt": 5}}, [1, 4]),
        ({"n": {"$lte": 5}}, [1, 3, 4]),
        ({"n": {"$gt": 1, "$lt": 10}}, [3]),
        ({"tag": {"$in": ["x", "z"]}}, [1, 3]),
        ({"n": {"$in": [1, 10]}}, [1, 2]),
        ({"n": 1}, [1]),
        ({"n": 1.0}, [4]),
        ({"n": "1"}, []),
        ({"flag": True}, [6]),
        ({"tag": None}, [6]),
        ({"a.b": [1, 2]}, [4]),
        ({"tag": {"$gt": "x"}}, [2, 3]),
        ({"tag": {"$gt": 1}}, []),
        ({"$and": [{"tag": {"$ne": "x"}}, {"n": {"$gte": 5}}]}, [2, 3]),
        ({"$or": [{"tag": "x"}, {"n": {"$gt": 9}}]}, [1, 2]),
        ({"tag": "y", "n": {"$lte": 10}}, [2]),
        ({"$and": []}, [1, 2, 3, 4, 5, 6]),
        ({"$or": []}, []),
    ],
)
def test_json_filters(spark, spec, ids):
    df = spark.createDataFrame(ROWS, "id long, doc string").withColumn("v", F.parse_json("doc"))
    tree = filters.parse(spec)
    assert filters.parse(filters.to_json(tree)) == tree
    assert [r["id"] for r in df.where(filters.variant_predicate(F.col("v"), json.dumps(spec))).orderBy("id").collect()] == ids


def test_typed_filters(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, "y", 10), (3, None, None)], "id long, tag string, n int")
    ids = lambda spec, **k: [r["id"] for r in df.where(filters.predicate(df, spec, **k)).orderBy("id").collect()]
    assert ids({"tag": {"$ne": "x"}}) == [2, 3] and ids({"tag": {"$ne": "x"}}, ne_requires_field=True) == [2]
    assert ids({"n": {"$gte": 1}}) == [1, 2] and ids({"n": "1"}) == [] and ids({"lost": 1}) == [] and ids({"lost": {"$ne": 1}}) == [1, 2, 3]


@pytest.mark.parametrize("spec", [{}, [], "{", {"$not": 1}, {"a": {}}, {"a": {"$re": 1}}, {"a": {"$in": 1}}, {"$and": {}}, {"$or": 1, "a": 1}])
def test_bad_filters(spec):
    with pytest.raises(InvalidFilter):
        filters.parse(spec)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, tag string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(filters.predicate(df, {"tag": "x"}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag,x)" in plan


def test_tokens(spark):
    assert value(spark, T.tokens(F.lit("Hello, RAG-world! Été 42"))) == ["hello", "rag", "world", "été", "42"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []


CATS = [(0, "the cat sat on the mat"), (1, "dogs and puppies play outside"), (2, "a cat and another cat"), (3, None)]


def test_bm25(spark):
    docs = spark.createDataFrame(CATS, "doc_id long, text string")
    q = spark.createDataFrame([(0, "cat cat"), (1, "nothing here")], "query_id long, text string")
    got = sparse.search(docs, q, 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 0]
    dl, avg, idf = {0: 6, 2: 5}, 16 / 4, math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    for r in got:
        tf = {0: 1, 2: 2}[r["doc_id"]]
        assert abs(r["score"] - idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[r["doc_id"]] / avg))) < 1e-9
    assert [r["doc_id"] for r in sparse.search(docs, q, 5, where=F.col("doc_id") == 0).collect()] == [0]
    base, new = sparse.postings(docs), sparse.postings(spark.createDataFrame([(0, "bird")], "doc_id long, text string"))
    after = sparse.updated(base, new, spark.createDataFrame([(1,)], "doc_id long"))
    assert {r["doc_id"] for r in after.collect()} == {0, 2} and after.where("doc_id = 0").count() == 1


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, vec_id long, score double, rank int")


def test_fusion(spark):
    dense, lexical = ranked(spark, [(0, 1, 10.0, 1), (0, 2, 1.0, 2)]), ranked(spark, [(0, 2, 10.0, 1), (0, 1, 1.0, 2)])
    best = lambda w: fusion.linear(dense, lexical, w).orderBy(F.desc("fused")).first()["vec_id"]
    assert best(1) == 1 and best(0) == 2 and best(7) == 1
    rrf = {r["vec_id"]: r["fused"] for r in fusion.reciprocal_ranks([dense, lexical]).collect()}
    assert abs(rrf[1] - (1 / 61 + 1 / 62)) < 1e-12
    assert fusion.min_max(ranked(spark, [(0, 1, 3.0, 1)])).first()["score"] == 1.0
    assert fusion.method("weighted") == "linear" and fusion.method("?") == "rrf"


def test_ivf(spark):
    points = table(spark, [(i, 0, 0, 0) for i in range(40)])
    config = IvfConfig(nlist=4, nprobe=2)
    c = ivf.train(points, config)
    entries, lists = ivf.assign(points, c), ivf.centroid_table(spark, c)
    got = ivf.search(entries, asked(spark, (5, 0, 0, 0)), lists, 3, 2).orderBy("rank").collect()
    assert got[0]["vec_id"] == 5
    everything = ivf.search(entries, asked(spark, (5, 0, 0, 0)), lists, 40, 4)
    assert everything.count() == 40
    assert ivf.appended(entries, table(spark, [(9, 9, 9, 9)], first=3), c).count() == 40
    assert ivf.removed(entries, points.where("vec_id < 5")).count() == 35
    assert ivf.memory(entries, 4, 4).first()["total_bytes"] == 40 * 24 + 64


def test_pq(spark):
    points = table(spark, [(i, 0, 1, 2) for i in range(48)])
    config = IvfConfig(nlist=8, nprobe=4).with_pq(2)
    c, book = ivf.train(points, config), ivf.train_codebook(points, config)
    coded = ivf.encode(ivf.assign(points, c), book)
    got = ivf.search_codes(coded, asked(spark, (10, 0, 1, 2)), ivf.centroid_table(spark, c), book, 5, 4).collect()
    assert any(abs(r["vec_id"] - 10) <= 3 for r in got)
    x = np.array([[10.0, 0, 1, 2]])
    assert np.abs(book.decode(book.encode(x)) - x).max() < 0.1
    with pytest.raises(InvalidConfig):
        ivf.Codebook.train(x, 3)


def test_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    points, queries = table(spark, x), asked(spark, *x[:6])
    built = graph.build(points, HnswConfig(m=6, m_max0=12), layers=2)
    built = built.persist()
    degrees = built.groupBy("layer", "src").count().groupBy("layer").agg(F.max("count").alias("m")).collect()
    assert all(r["m"] <= (12 if r["layer"] == 0 else 6) for r in degrees)
    got = graph.search(built, points, queries, 5, HnswConfig(m=6), layers=2)
    truth = exact.knn_join(points, queries, 5)
    assert evaluate.recall_at_k(got, truth, 5).first()["recall"] >= 0.8
    only = graph.search(built, points, queries, 5, HnswConfig(m=6), eligible=F.col("vec_id") % 2 == 0, layers=2)
    assert all(r["vec_id"] % 2 == 0 for r in only.collect())
    assert graph.remove(built, points.where("vec_id = 7")).where("src = 7 or dst = 7").count() == 0
    built.unpersist()


def test_graph_search_walks_to_the_end(spark):
    x = np.stack([np.arange(40.0), np.zeros(40)], axis=1)
    points, queries = table(spark, x), asked(spark, *x[::8])
    chain = spark.range(39).select(F.lit(0).alias("layer"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("dist"))
    chain = chain.union(chain.select("layer", "dst", "src", "dist")).persist()
    config = HnswConfig(m=2, ef_search=3)
    hits = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    assert hits(graph.search(chain, points, queries, 3, config, "l2")) == hits(exact.knn_join(points, queries, 3, "l2"))
    rare = F.col("vec_id").isin(1, 17, 38)
    assert hits(graph.search(chain, points, queries, 3, config, "l2", eligible=rare)) == hits(exact.knn_join(points, queries, 3, "l2", rare))
    chain.unpersist()


def test_grid(spark):
    config = GridConfig(outer_grid=(8, 8))
    shape = grid.layers(config)
    assert [(x.width, x.origin) for x in shape] == [(8, 0.0), (4, 0.25), (2, 0.375)]
    at = lambda x, y: value(spark, grid.key(grid.deepest_cell(F.lit(x), F.lit(y), config)))
    assert at(0.5, 0.5).startswith("2:") and at(0.05, 0.05) == "0:0:0"
    box = value(spark, grid.neighbourhood(F.lit(0.5), F.lit(0.5), 1, config))
    assert {c["layer"] for c in box} == {0, 1, 2} and len([c for c in box if c["layer"] == 0]) == 9
    assert grid.all_cells(spark.range(1), shape[0]).distinct().count() == 64
    child = value(spark, grid.child_cell(F.struct(F.lit(0).alias("layer"), F.lit(3).alias("x"), F.lit(3).alias("y")), config))
    assert child["layer"] == 1 and value(spark, grid.child_cell(F.struct(F.lit(0).alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y")), config)) is None


def test_routing(spark):
    d = 8
    queries = asked(spark, *[[math.sin(0.07 * i + j) for j in range(d)] for i in range(64)])
    own = grid.target_shards(queries, d, 16, 0).groupBy("query_id").count().collect()
    assert all(r["count"] == 1 for r in own)
    near = grid.target_shards(queries, d, 16, 1).groupBy("query_id").count().collect()
    assert all(1 <= r["count"] <= 16 for r in near)


def test_grid_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = grid.with_cells(table(spark, x), 8).persist()
    queries = asked(spark, *x[:5])
    config = GridConfig(touch_budget_frac=1.0, coarse_keep_per_column=0)
    got, explain = cells.search(rows, queries, 10, 8, config)
    truth = exact.knn_join(rows, queries, 10)
    assert evaluate.recall_at_k(got, truth, 10).first()["recall"] >= 0.9
    small = cells.search(rows, queries, 3, 8, GridConfig(touch_budget=20))[1]
    assert all(r["candidate_pool"] <= 20 for r in small.collect()) and explain.count() == 5
    balance = cells.height_balance(rows).first()
    after = cells.split_tall(rows, GridConfig(max_column_height_ratio=1.5))
    assert after.count() == 300 and balance["cells"] <= 300
    assert cells.columns(rows).agg(F.sum("height")).first()[0] == 300
    rows.unpersist()


def test_moves(spark):
    rows = spark.createDataFrame([(7, [0.0], 1, 0, 0, "1:0:0"), (8, [0.0], 0, 5, 5, "0:5:5")], "vec_id long, embedding array<float>, layer int, cx int, cy int, cell_key string")
    hot = spark.createDataFrame([("1:0:0", 0.9)], "cell_key string, ema_weight double")
    got = {r["vec_id"]: r["layer"] for r in cells.moved(rows, hot).collect()}
    assert got == {7: 0, 8: 0}


def test_ledger(spark):
    log = spark.createDataFrame([("a", 0, 1), ("a", 1000, 2)], "cell_key string, ts_ms long, event_id long")
    now = cells.ledger(log, 1000, 1000).first()
    later = cells.ledger(log, 2000, 1000).first()
    assert abs(now["ema_weight"] - (0.1 * 0.9 * 0.5 + 0.1)) < 1e-12 and abs(later["ema_weight"] - now["ema_weight"] / 2) < 1e-12
    assert now["hit_count"] == 2 and now["last_access"] == 1000


def test_predictor():
    p = cells.Predictor()
    f = p.features(1, 3, 0.4, 0.2)
    q = p
    for _ in range(50):
        q = q.updated(f, 1, 1)
    assert q.confidence(f) > p.confidence(f) and q.hit_ema[1] > 0.9


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1), (0, 2), (1, 9)], "query_id long, vec_id long")
    truth = spark.createDataFrame([(0, 1), (0, 3), (1, 4), (1, 5)], "query_id long, vec_id long")
    assert evaluate.recall_at_k(hits, truth, 2).first()["recall"] == 0.25 and evaluate.hit_rate(hits, truth).first()["hit_rate"] == 0.5
    g = value(spark, evaluate.gates(F.lit(0.99), F.lit(1.0), F.lit(0.1)))
    assert g["passed"] and not value(spark, evaluate.gates(F.lit(0.99), F.lit(1.0), F.lit(0.9)))["g3"]
    assert evaluate.timed(lambda: None, 10)["qps"] > 0
    assert evaluate.footprint(table(spark, [(1, 2)]), "u8").first()["coded_bytes"] == 10


def test_planner():
    assert planner.choose(10_000, 128, 10).index == "grid" and planner.choose(100, 128, 10).index == "flat"
    assert planner.choose(4000, 128, 10, True).index == "flat" and planner.choose(700, 32, 50).ef == 200
    assert planner.strategy(None, None, 5) == "standard_index_search" and planner.strategy({"a": 1}, 3, 5) == "payload_exact_eligible"
    assert planner.strategy({"a": {"$gt": 1}}, 1000, 5) == "payload_filtered_scan" and planner.strategy({"a": 1}, 1000, 5) == "payload_aware_index_search"


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 3)).astype(np.float32)
    (tmp_path / "a.fvecs").write_bytes(vecs.fvecs_bytes(x))
    (tmp_path / "a.ivecs").write_bytes(vecs.fvecs_bytes(np.arange(6).reshape(2, 3)))
    (tmp_path / "bad.fvecs").write_bytes(b"\x03\0\0\0abc")
    got = vecs.read_fvecs(spark, f"{tmp_path}/a.fvecs").orderBy("vec_id").collect()
    assert np.allclose([r["embedding"] for r in got], x)
    assert [r["neighbours"] for r in vecs.read_ivecs(spark, f"{tmp_path}/a.ivecs").orderBy("vec_id").collect()] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(Exception, match="equally long"):
        vecs.read_fvecs(spark, f"{tmp_path}/bad.fvecs").collect()
    (tmp_path / "q.csv").write_text("1, 2.5\n\n3,4\n")
    assert sorted(r["q"] for r in vecs.read_query_csv(spark, f"{tmp_path}/q.csv").collect()) == [[1.0, 2.5], [3.0, 4.0]]


def test_synthetic(spark):
    base = vecs.synthetic(spark, 50, 4)
    q = vecs.synthetic_queries(base, 5, 50).collect()
    assert all(r["truth"] == [7 * r["query_id"] % 50] and r["q"][0] == r["truth"][0] for r in q)
    n = vecs.unit_sphere(spark, 20, 6).select(V.norm(F.col("embedding")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in n)
    assert vecs.clusters(spark, 64, 6).count() == 64


def test_config():
    c = CollectionConfig.from_dict({"name": "a", "dimension": 3, "grid": {"max_layers": 2}})
    assert c.grid.projection_seed == 42 and c.grid.hybrid_rerank_pool == 3 and c.hnsw.m == 16
    assert CollectionConfig.from_dict(json.loads(json.dumps(c.to_dict()))) == c
    with pytest.raises(InvalidConfig):
        CollectionConfig("a", 3, index="kd")
