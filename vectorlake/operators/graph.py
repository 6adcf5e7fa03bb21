"""Layered proximity graph (G1-G6) as an edge table (layer, src, dst, dist).

Edges are each node's nearest neighbours in its layer and their reverses, cut to m.  Search runs in rounds: the frontier
of every query meets the edges, then the vectors; visited nodes are left out and each query keeps its ef best.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import Scratch
from ..types import DimensionMismatch, HnswConfig, metric
from .exact import QUERY_BYTES, knn_join, matrix, top_k_per_query, true_distances

#: Nodes up to which an upper layer is searched whole.
FLAT = 1 << 14


def level(vec_id: Column, config: HnswConfig) -> Column:
    """G1: floor(-ln(u) / ln(m)) with u from a seeded hash of the id."""
    u = (F.pmod(F.xxhash64(vec_id, F.lit(config.seed)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
    return F.floor(-F.log(u) / F.log(F.lit(float(config.m)))).cast("int")


def pruned(edges: DataFrame, m: int) -> DataFrame:
    """Each node's m nearest among its neighbours and those that chose it."""
    both = edges.select("src", "dst", "dist").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).drop("rank")


def knn_graph(points: DataFrame, m: int, metric_name: str = "cosine") -> DataFrame:
    """One layer's edges from exact neighbours: src, dst, dist."""
    queries = points.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = knn_join(points, queries, m, metric_name, not_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("distance").alias("dist"))


def knn_graph_in_lists(entries: DataFrame, m: int, metric_name: str = "cosine") -> DataFrame:
    """As ``knn_graph``, but neighbours are sought within inverted lists (vec_id, list_id, embedding), which bounds each group."""
    import pyarrow as pa

    from .exact import _Queries, _scan

    def build(t: pa.Table) -> pa.Table:
        points = t.select(["vec_id", "embedding"])
        got = list(_scan(_Queries(points.rename_columns(["query_id", "q"]), metric_name), iter(points.to_batches(8192)), m, True))
        return pa.Table.from_batches(got, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())]))

    near = entries.groupBy("list_id").applyInArrow(build, "query_id long, vec_id long, distance double")
    return top_k_per_query(near, m).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("distance").alias("dist"))


def build(points: DataFrame, config: HnswConfig = HnswConfig(), metric_name: str = "cosine", layers: int | None = None) -> DataFrame:
    """Edges of all layers, as many as the points' levels ask for; layer 0 holds every node with up to m_max0 neighbours."""
    if layers is None:
        layers = 1 + (points.agg(F.max(level(F.col("vec_id"), config))).first()[0] or 0)
    tall = points.withColumn("level", F.least(level(F.col("vec_id"), config), F.lit(layers - 1)))
    scratch, out = Scratch(points.sparkSession, "graph-layers"), []
    for layer in range(layers):
        here = tall.where(F.col("level") >= layer).drop("level")
        most = config.m_max0 if layer == 0 else config.m
        near = scratch.save(knn_graph(here, config.m, metric_name), f"layer-{layer}")  # read for either end of an edge
        out.append(pruned(near, most).select(F.lit(layer).alias("layer"), "src", "dst", "dist"))
    return reduce(DataFrame.unionByName, out)


def entries(points: DataFrame, queries: DataFrame, number: int = 4, seed: int = 42) -> DataFrame:
    """Entry nodes, the same for every query: the ``number`` first by a seeded hash.  ``points`` holds eligible rows only."""
    first = points.select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(number)
    return queries.select("query_id").join(F.broadcast(first), F.lit(True))  # first has ``number`` rows


def _scorer(vectors: DataFrame, asked: DataFrame, metric_name: str):
    """A function of pairs (query_id, vec_id) that adds their distance and ``ok``; query sets up to ``QUERY_BYTES`` are sent to the tasks."""
    if asked.agg(F.coalesce(F.sum(F.size("q") * 8 + 8), F.lit(0))).first()[0] > QUERY_BYTES:
        return lambda pairs: pairs.join(vectors, "vec_id").join(asked, "query_id").select("query_id", "vec_id", V.distance(metric_name, F.col("embedding"), F.col("q")).alias("distance"), "ok")
    got, kind = asked.orderBy("query_id").toArrow(), metric(metric_name)

    def run(batches):
        ids, q = got.column("query_id").to_numpy(), matrix(got.column("q"))
        for b in batches:
            if not b.num_rows:
                continue
            x, rows = matrix(b.column(2)), np.searchsorted(ids, b.column(0).to_numpy())
            if x.shape[1] != q.shape[1]:
                raise DimensionMismatch(f"queries have {q.shape[1]} components, points {x.shape[1]}")
            d = true_distances(q[rows], (q * q).sum(axis=1)[rows], x, (x * x).sum(axis=1), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), b.column(3)], names=["query_id", "vec_id", "distance", "ok"])

    def scored(pairs: DataFrame) -> DataFrame:
        long = [F.col(c).cast("long").alias(c) for c in ("query_id", "vec_id")]
        return pairs.join(vectors, "vec_id").select(*long, "embedding", "ok").mapInArrow(run, "query_id long, vec_id long, distance double, ok boolean")

    return scored


def beam(edges: DataFrame, points: DataFrame, queries: DataFrame, start: DataFrame, ef: int, hops: int | None = None, metric_name: str = "cosine", eligible: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Ef-bounded search of one layer until no query has a new node, or for ``hops`` rounds: (query_id, vec_id, distance).

    Nodes that are not eligible are crossed but not returned; each query keeps its ef best of either kind.
    """
    vectors = points.select("vec_id", "embedding", (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("ok"))
    scored = _scorer(vectors, queries.select(F.col("query_id").cast("long").alias("query_id"), "q"), metric_name)
    scratch = scratch or Scratch(points.sparkSession, "beam")
    visited = scratch.save(scored(start.select("query_id", "vec_id").distinct()), "round-0")
    frontier = visited
    for hop in count(1) if hops is None else range(1, hops + 1):
        ahead = frontier.select("query_id", F.col("vec_id").alias("src")).join(edges.select("src", "dst"), "src").select("query_id", F.col("dst").alias("vec_id")).distinct()
        new = scored(ahead.join(visited.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")).withColumn("new", F.lit(True))
        w = Window.partitionBy("query_id", "ok").orderBy("distance", "vec_id")
        kept = visited.withColumn("new", F.lit(False)).unionByName(new).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ef).drop("rank")
        kept = scratch.save(kept, f"round-{hop}")
        visited, frontier = kept.drop("new"), kept.where("new").drop("new")
        if hops is None and frontier.isEmpty():
            break
    return visited.where("ok").drop("ok")


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int, config: HnswConfig = HnswConfig(), metric_name: str = "cosine", ef: int | None = None, hops: int | None = None, eligible: Column | None = None, layers: int | None = None) -> DataFrame:
    """Greedy descent through the upper layers (ef 1), then layer 0 with max(ef, k, ef_search).

    The descent begins in the lowest upper layer of at most ``FLAT`` nodes, which is searched whole in one job.
    Queries for which the walk finds fewer than k eligible rows are answered exactly.
    """
    if layers is None:
        layers = 1 + (graph.agg(F.max("layer")).first()[0] or 0)
    start = entries(points if eligible is None else points.where(eligible), queries, seed=config.seed)
    top = graph.where(F.col("layer") == layers - 1).select(F.col("src").alias("vec_id")).distinct()
    start = start.union(entries(top, queries, seed=config.seed)).distinct()
    upper = graph.where((F.col("layer") > 0) & (F.col("layer") < layers)).groupBy("layer").agg(F.countDistinct("src").alias("n"))
    flat = upper.where(F.col("n") <= FLAT).agg(F.min("layer")).first()[0] or layers
    if flat < layers:
        nodes = graph.where(F.col("layer") == flat).select(F.col("src").alias("vec_id")).distinct()
        near = knn_join(points.join(nodes, "vec_id", "left_semi"), queries, 4, metric_name)
        start = start.union(near.select("query_id", "vec_id")).distinct()
    for layer in range(flat - 1, 0, -1):
        got = beam(graph.where(F.col("layer") == layer), points, queries, start, 1, None, metric_name)
        start = got.select("query_id", "vec_id").union(start).distinct()
    found = beam(graph.where(F.col("layer") == 0), points, queries, start, max(ef or 0, k, config.ef_search), hops, metric_name, eligible)
    if eligible is not None:
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        exact = knn_join(points, queries.join(full, "query_id", "left_anti"), k, metric_name, eligible)
        found = found.join(full, "query_id", "left_semi").unionByName(exact.drop("rank"))
    return top_k_per_query(found, k)


def remove(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """The graph without the nodes and all edges to them."""
    gone = ids.select(F.col("vec_id").alias("gone"))
    return graph.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
