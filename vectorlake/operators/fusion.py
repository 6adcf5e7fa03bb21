"""Fusion of ranked lists (H1-H5).  A list has query_id, vec_id and a rank or a score (higher is better)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exact, sparse

RRF_K, DENSE_WEIGHT, PREFETCH = 60, 0.5, 5


def method(name: str) -> str:
    """H5: "linear" or "weighted" name linear fusion, everything else reciprocal ranks."""
    return "linear" if name.lower() in ("linear", "weighted") else "rrf"


def reciprocal_ranks(lists: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """H1: sum over lists of 1 / (k + rank), ranks from 1."""
    ranked = reduce(DataFrame.unionByName, [x.select("query_id", "vec_id", "rank") for x in lists])
    return ranked.groupBy("query_id", "vec_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"))


def min_max(scores: DataFrame, column: str = "score") -> DataFrame:
    """H3: each query's scores scaled to [0, 1]; all 1 where they hardly differ."""
    w = Window.partitionBy("query_id")
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return scores.withColumn(column, F.when(span <= 1e-9, F.lit(1.0)).otherwise((F.col(column) - low) / span))


def linear(dense: DataFrame, lexical: DataFrame, weight: float = DENSE_WEIGHT) -> DataFrame:
    """H2: weighted sum of the scaled scores, weight in [0, 1]; a missing score is 0."""
    a = min(1.0, max(0.0, weight))
    d = min_max(dense).select("query_id", "vec_id", F.col("score").alias("d"))
    s = min_max(lexical).select("query_id", "vec_id", F.col("score").alias("s"))
    both = d.join(s, ["query_id", "vec_id"], "full_outer")
    return both.select("query_id", "vec_id", (F.coalesce("d", F.lit(0.0)) * a + F.coalesce("s", F.lit(0.0)) * (1 - a)).alias("fused"))


def hybrid(points: DataFrame, queries: DataFrame, k: int, metric_name: str = "cosine", how: str = "rrf", weight: float = DENSE_WEIGHT, rrf_k: int = RRF_K, prefetch: int | None = None, where: Column | None = None) -> DataFrame:
    """H4: the k best fused rows: query_id, vec_id, distance (exact), score (fused), rank.

    ``points`` has vec_id, embedding, text; ``queries`` query_id, q, text.  Each side gives ``prefetch`` rows (5 k), filtered
    first; fused rows get their exact distance from their vectors, fetched for these rows only.
    """
    from ..functions import vectors as V

    ahead = prefetch or PREFETCH * k
    dense = exact.knn_join(points, queries, ahead, metric_name, where)
    lexical = sparse.search(points, queries, ahead, "vec_id", "text", where).withColumnRenamed("doc_id", "vec_id")
    if method(how) == "rrf":
        fused = reciprocal_ranks([dense, lexical], rrf_k)
    else:
        fused = linear(dense.withColumn("score", -F.col("distance")), lexical, weight)
    best = exact.top_k_per_query(fused, k, "fused", "vec_id", descending=True)
    near = points.select("vec_id", "embedding").join(best, "vec_id").join(queries.select("query_id", "q"), "query_id")
    return near.select("query_id", "vec_id", V.distance(metric_name, F.col("embedding"), F.col("q")).alias("distance"), F.col("fused").alias("score"), "rank")
