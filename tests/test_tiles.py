"""Searches in tiles of matrix products: bounded tasks, no rows of pairs, the same hits as pair by pair."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorlake.functions import vectors as V
from vectorlake.operators import cells, exact, graph, grid, ivf, sparse
from vectorlake.types import GridConfig, HnswConfig, IvfConfig

from test_operators import asked, table


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def hits(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def slow(points, queries, visits, metric, k, part, each=False):
    near = points.join(visits.select("query_id", part), part).join(queries, "query_id")
    near = near.select("query_id", "vec_id", part, V.distance(metric, F.col("embedding"), F.col("q")).alias("distance"))
    return exact.top_k_per_query(near, k, query=["query_id", part] if each else "query_id")


def test_a_task_holds_one_tile_of_many_queries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(16384, 8))
    lists = pa.array(x.tolist(), pa.list_(pa.float64()))
    queries = exact._Queries(pa.table({"query_id": pa.array(range(2000)), "q": lists[:2000]}), "cosine")
    batches = pa.table({"vec_id": pa.array(range(16384)), "embedding": lists}).to_batches(8192)
    tracemalloc.start()
    try:
        got = list(exact._scan(queries, iter(batches), 3))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 6000  # not 3 rows of each batch
    assert peak < 100e6  # all products of a batch would take 131 MB, several times


@pytest.mark.parametrize("name", ["l2", "cosine", "dot"])
def test_copies_tie_wherever_they_stand(spark, name):
    rng = np.random.default_rng(1)
    one = rng.normal(size=37)
    x = np.concatenate([rng.normal(size=(301, 37)), np.tile(one, (57, 1)), rng.normal(size=(211, 37)), np.tile(one, (13, 1))])
    got = exact.knn_join(table(spark, x), asked(spark, *(one + 0.1 * rng.normal(size=(9, 37)))), 60, name).where("rank <= 60")
    copies = {*range(301, 358), *range(569, 582)}
    for q in range(9):
        ids = [r["vec_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect() if r["vec_id"] in copies]
        assert ids == sorted(ids) == sorted(copies)[: len(ids)] and len(ids) > 50


@pytest.mark.parametrize("size", [32 << 20, 200])
@pytest.mark.parametrize("name", ["l2", "cosine", "dot"])
def test_parts(spark, monkeypatch, name, size):
    monkeypatch.setattr(exact, "QUERY_BYTES", size)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5))
    x[7] = 0
    points = table(spark, x).withColumn("p", F.col("vec_id") % 6)
    queries = asked(spark, *rng.normal(size=(9, 5)))
    visits = queries.select("query_id", F.explode(F.array(F.col("query_id") % 6, (F.col("query_id") + 2) % 6, F.lit(99))).alias("p"))
    for each in (False, True):
        got = exact.knn_in_parts(points, queries, visits, 4, name, "p", each)
        want = slow(points, queries, visits, name, 4, "p", each)
        assert hits(got, "query_id", "vec_id", "rank") == hits(want, "query_id", "vec_id", "rank")


def test_lists_and_shards_are_searched_without_rows_of_pairs(spark):
    rng = np.random.default_rng(3)
    points, queries = table(spark, rng.normal(size=(200, 4))), asked(spark, *rng.normal(size=(5, 4)))
    config = IvfConfig(nlist=4, nprobe=2).with_pq(2)
    c, book = ivf.train(points, config), ivf.train_codebook(points, config)
    entries, lists = ivf.assign(points, c), ivf.centroid_table(spark, c)
    found = ivf.search(entries, queries, lists, 5, 2)
    assert "zip_with" not in plan(found)
    want = slow(entries, queries, ivf.probes(queries, lists, 2), "l2", 5, "list_id")
    assert hits(found, "query_id", "vec_id", "rank") == hits(want, "query_id", "vec_id", "rank")
    coded = ivf.encode(entries, book)
    found = ivf.search_codes(coded, queries, lists, book, 5, 2)
    assert "q#" not in plan(found).replace("seq#", "")
    codes = {r["vec_id"]: np.array(r["codes"]) for r in coded.collect()}
    tables = {r["query_id"]: book.tables(np.array(r["q"]), "l2") for r in queries.collect()}
    assert all(abs(r["distance"] - tables[r["query_id"]][np.arange(2), codes[r["vec_id"]]].sum()) < 1e-9 for r in found.collect())
    sharded, targets = grid.sharded(points, 4, 3), grid.target_shards(queries, 4, 3, 0)
    found = grid.search_shards(sharded, queries, targets, 5)
    assert "embedding#" not in plan(found).split("MapInArrow")[0]
    assert hits(found, "query_id", "vec_id", "rank") == hits(slow(sharded, queries, targets, "cosine", 5, "shard_id"), "query_id", "vec_id", "rank")


def test_coarse_search_sends_the_nearest_of_a_column_only(spark):
    rng = np.random.default_rng(4)
    rows = grid.with_cells(table(spark, rng.normal(size=(300, 8))), 8)
    queries = asked(spark, *rng.normal(size=(6, 8)))
    visits = cells.ranked_columns(cells.columns(rows), queries).where("rank <= 5").withColumn("visit", F.col("rank"))
    got, all_ = cells.coarse(rows, visits, queries, 3), cells.coarse(rows, visits, queries, 0)
    assert "zip_with" not in plan(got.select("query_id", "vec_id", "coarse")).split("MapInArrow")[0]
    want = exact.top_k_per_query(all_, 3, "coarse", query=["query_id", "cell_key"])
    assert hits(got, "query_id", "vec_id", "cell_key", "visit") == hits(want, "query_id", "vec_id", "cell_key", "visit")


def test_equal_documents_have_equal_scores(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words, 300))) for i in range(60)]
    text = " ".join(rng.choice(words, 600))
    rows = spark.createDataFrame(docs + [(100 + i, text) for i in range(80)], "doc_id long, text string").repartition(7)
    found = sparse.bm25(rows, spark.createDataFrame([(0, text)], "query_id long, text string")).where("doc_id >= 100")
    assert found.count() == 80 and found.select("score").distinct().count() == 1


def test_blocks_of_a_graph_return_few_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "QUERY_BYTES", 3000)
    rng = np.random.default_rng(8)
    points = table(spark, rng.normal(size=(90, 4)))
    queries = points.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = exact._joined(points.select("vec_id", "embedding"), queries, 3, "cosine", True)
    assert found.count() == 2 * 90 * 3  # k rows a query of each of two shares, not of some for each core


def test_the_bound_of_many_columns_holds():
    d = np.random.default_rng(9).normal(size=(7, 1000)).astype(np.float32)
    for nth in (0, 4, 9):
        assert ((d <= exact._bound(d, nth)[:, None]).sum(axis=1) > nth).all()


def test_every_list_has_a_pool(spark):
    rng = np.random.default_rng(10)
    points, queries = table(spark, rng.normal(size=(400, 16))), asked(spark, *rng.normal(size=(8, 16)))
    config = IvfConfig(nlist=4, nprobe=4).with_pq(1)
    c, book = ivf.train(points, config), ivf.train_codebook(points.where("vec_id < 40"), config)
    pool = ivf.search_codes(ivf.encode(ivf.assign(points, c), book), queries, ivf.centroid_table(spark, c), book, 20, 4, each=True)
    assert all(r["count"] == 80 for r in pool.groupBy("query_id").count().collect())


def test_upper_layers_are_searched_whole(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 8))
    points, queries = table(spark, x), asked(spark, *x[:5])
    built = graph.build(points, HnswConfig(m=4, m_max0=8), layers=3).persist()
    beams, beam = [], graph.beam
    monkeypatch.setattr(graph, "beam", lambda *a, **k: beams.append(1) or beam(*a, **k))
    got = graph.search(built, points, queries, 5, HnswConfig(m=4))
    want = exact.knn_join(points, queries, 5)
    assert len(set(hits(got, "query_id", "vec_id")) & set(hits(want, "query_id", "vec_id"))) >= 23
    assert len(beams) == 1  # not one for each layer
    built.unpersist()


def lexical_rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_lexical_search_in_tiles_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)] + ["Été", "дом", "7"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 90))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts + texts[:40] + [None, "", "--"])], "doc_id long, text string, g int").repartition(5)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:12] + [" ".join(words * 3), None, "", "unknown words"])], "query_id long, text string")
    for where in (None, F.col("g") == 1):
        want = lexical_rows(exact.top_k_per_query(sparse.bm25(docs, queries, where=where), 7, "score", "doc_id", descending=True))
        monkeypatch.setattr(sparse, "LIST_BYTES", 64 << 20)
        sent = sparse.search(docs, queries, 7, where=where)
        assert lexical_rows(sent) == want
        monkeypatch.setattr(sparse, "LIST_BYTES", 3000)
        assert lexical_rows(sparse.search(docs, queries, 7, where=where)) == want
        plan = sent._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan  # no rows of pairs
    assert sparse.search(docs.where("false"), queries, 7).count() == 0 and sparse.search(docs, queries.where("false"), 7).count() == 0
    assert sparse.search(docs, queries, 0).count() == 0


def test_small_tiles_of_a_lexical_search_and_large_sums(monkeypatch):
    rng = np.random.default_rng(12)
    terms = [f"w{i}" for i in range(40)]
    held = [sorted(set(rng.integers(0, 9, 5).tolist())) for _ in terms]
    asked = sparse._Asked(pa.table({"term": terms, "idf": rng.uniform(0.1, 900.0, 40), "queries": pa.array(held, pa.list_(pa.int64()))}))
    tokens = [rng.choice(terms, rng.integers(0, 50)).tolist() for _ in range(80)]
    batches = [pa.record_batch([pa.array(range(a, a + 40)), pa.array(tokens[a : a + 40], pa.list_(pa.string()))], ["doc_id", "t"]) for a in (0, 40)]

    def best():
        got = pa.Table.from_batches(list(sparse._scan(asked, 20.0, iter(batches), 4))).to_pylist()
        return [(q, sorted((-r["score"], r["doc_id"]) for r in got if r["query_id"] == q)[:4]) for q in range(9)]

    want = {q: [] for q in range(9)}
    for i, t in enumerate(tokens):
        for q in range(9):
            whole = [math.floor(asked.idf[c] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / 20.0)) * 2.0**42 + 0.5) for c, w in enumerate(terms) if q in held[c] and w in t]
            if whole:
                want[q].append((-sum(whole) / 2.0**42, i))
    want = sorted((q, sorted(x)[:4]) for q, x in want.items())
    assert max(-x[0][0] for _, x in want) > 2**11  # more than a double holds in units of 2^-42
    assert best() == want
    monkeypatch.setattr(exact, "CELLS", 30)
    monkeypatch.setattr(exact, "HELD", 20)
    assert best() == want


def test_points_leave_out_documents_far_from_all_vectors(spark, tmp_path):
    from vectorlake import queries

    ids = [-(1 << 62), -5, 0, 3, 1 << 40, (1 << 62) + 7]
    spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"t{i}", "en") for i in [*ids[:-2], 1 << 50, 1 << 51, ids[-1]]], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda near: sorted(map(str, queries.points(spark, str(tmp_path), near).select("vec_id", "text", "quality").collect()))
    assert rows(True) == rows(False) and len(rows(True)) == len(ids)
