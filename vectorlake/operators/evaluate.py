"""Evaluation of search results (E1-E11).  Results and truth have query_id and vec_id."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

G1, G2, G3 = 0.98, 1.5, 0.5


def _hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hits) for all queries of the truth."""
    hits = results.select("query_id", "vec_id").distinct().join(truth.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def hit_rate(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of queries with any true neighbour."""
    return _hits(results, truth).agg(F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the k true neighbours found."""
    return _hits(results, truth).agg(F.avg(F.col("hits") / k).alias("recall"))


def gates(recall_ratio: Column, latency_ratio: Column, touched: Column) -> Column:
    """Struct of the three gates and their conjunction."""
    g1, g2, g3 = recall_ratio >= G1, latency_ratio <= G2, touched < G3
    return F.struct(g1.alias("g1"), g2.alias("g2"), g3.alias("g3"), (g1 & g2 & g3).alias("passed"))


def touch_fraction(pool: DataFrame, total: int, rows: str | None = None) -> DataFrame:
    """Mean share of the rows that a query touched: the pool's rows, or the sum of its column ``rows``."""
    return pool.groupBy("query_id").agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n")).agg((F.avg("n") / F.lit(float(max(total, 1)))).alias("touch_fraction"))


def fill(rows: DataFrame) -> DataFrame:
    """Rows for each filled cell."""
    return rows.agg((F.count(F.lit(1)) / F.countDistinct("cell_key")).alias("fill"))


def localization(truth: DataFrame, rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """E5: (columns, share): share of true neighbours within the so many nearest columns; ``ranked`` has query_id, cell_key, rank."""
    found = truth.select("query_id", "vec_id").join(rows.select("vec_id", "cell_key"), "vec_id").join(ranked.select("query_id", "cell_key", "rank"), ["query_id", "cell_key"])
    per = found.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    lower = per.select(F.col("rank").alias("r"), F.col("n").alias("m"))  # at most one row for each cell of the grid
    return per.join(lower, F.col("r") <= F.col("rank")).groupBy("rank").agg(F.sum("m").alias("m")).join(F.broadcast(total), F.lit(True)).select(F.col("rank").alias("columns"), (F.col("m") / F.col("total")).alias("share"))


def columns_per_query(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """E5: p50 and p99 of the number of columns that hold a query's true neighbours."""
    n = truth.select("query_id", "vec_id").join(rows.select("vec_id", "cell_key"), "vec_id").groupBy("query_id").agg(F.countDistinct("cell_key").alias("n"))
    at = lambda p: V.percentile(F.collect_list("n"), p)  # noqa: E731  one number for each query of the stated set
    return n.agg(at(0.5).alias("p50"), at(0.99).alias("p99"))


def oracle_columns(truth: DataFrame, rows: DataFrame, ranked: DataFrame, count: int) -> DataFrame:
    """Each query's ``count`` columns with most true neighbours, filled up with the nearest others: query_id, cell_key, visit."""
    from pyspark.sql import Window

    mass = truth.select("query_id", "vec_id").join(rows.select("vec_id", "cell_key"), "vec_id").groupBy("query_id", "cell_key").agg(F.count(F.lit(1)).alias("mass"))
    w = Window.partitionBy("query_id").orderBy(F.coalesce("mass", F.lit(0)).desc(), "rank", "cell_key")
    return ranked.join(mass, ["query_id", "cell_key"], "left").withColumn("visit", F.row_number().over(w)).where(F.col("visit") <= count).select("query_id", "cell_key", "visit")


def footprint(points: DataFrame, tier: str = "f32") -> DataFrame:
    """Bytes of ids and vectors, coded and at full precision."""
    width = {"u8": 1, "u16": 2, "f32": 4}[tier]
    n = F.sum(F.size("embedding").cast("long"))
    return points.agg((F.count(F.lit(1)) * 8 + n * width).alias("coded_bytes"), (F.count(F.lit(1)) * 8 + n * 4).alias("full_bytes"))


def timed(run, queries: int, rounds: int = 3) -> dict:
    """Median seconds of ``run()`` (which has to finish its work) and queries a second."""
    spans = []
    for _ in range(rounds):
        began = time.perf_counter()
        run()
        spans.append(time.perf_counter() - began)
    p50 = sorted(spans)[len(spans) // 2]
    return {"p50_s": p50, "qps": queries / p50 if p50 else float("inf")}


def compare(reports: dict[str, DataFrame]) -> DataFrame:
    """One table of several indexes' reports."""
    out = None
    for name, df in reports.items():
        named = df.select(F.lit(name).alias("index"), "*")
        out = named if out is None else out.unionByName(named)
    return out
