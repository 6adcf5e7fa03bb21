"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long); component is its smallest reachable node.

    A step only joins the links with the smallest neighbour of each node, both read from written tables, so that a
    hub's links can be split over tasks; no node's neighbours are gathered.  Every round is written to the shared
    folder.  An empty table gives an empty result; self links and repeated links are ignored.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0")
    mark, turn = _mark(now), 0
    while True:
        turn += 1
        both = scratch.save(now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"both-{turn}")
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), f"least-{turn}")
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"large-{turn}")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), f"low-{turn}")
        small = large.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = scratch.save(small.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), f"links-{turn}")
        scratch.drop(f"links-{turn - 1}", f"both-{turn}", f"least-{turn}", f"large-{turn}", f"low-{turn}")
        now, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _mark(links: DataFrame) -> tuple:
    """Equal for equal link sets."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
