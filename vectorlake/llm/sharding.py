"""Sharding by weighted rendezvous hashing, native DataFrame operations only.

Every record scores every shard with a hash of (record key, shard number); the best score takes the record.  A score
depends on no other shard, so adding a shard moves only the records that the new shard wins, about ``w_new / sum(w)``
of them, and all of those move into it.  A weight ``w`` scales the score ``-w / ln(u)``, ``u`` uniform in (0, 1), which
gives a shard its share of the records in proportion to its weight.

Edge cases: a null key hashes like any other value (all null keys share a shard); a null or empty text has size 1
and the checksum of the empty string; repeated rows go to the same shard and get slots of their own; an empty table
gives an empty result; columns of the input other than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key``; ``weights`` has one positive number for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")

    def score(shard: int, weight: float) -> Column:
        top53 = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        return F.lit(float(weight)) / -F.log((top53 + F.lit(0.5)) * F.lit(2.0**-53))

    scored = F.array(*[F.struct(score(s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)])
    return (-F.array_max(scored)["shard"]).cast("int")


def assign(docs: DataFrame, key: str, text: str, weights: Sequence[float], added: float | None = None) -> DataFrame:
    """One row per record: key, size in bytes, checksum, shard and, if ``added`` is the weight of one more shard, the shard with it."""
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), [*weights, added]) if added else F.lit(None).cast("int")).alias("grown_shard"),
    )


def with_slots(rows: DataFrame, pieces: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard can be far larger than a task, so it is numbered in ``pieces`` hashed pieces: rows are ranked inside a
    piece and a piece starts where the ones before it end.  Only the piece counts, one row for each shard and piece, meet
    in one place.
    """
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("key", "text_crc32", F.lit("piece")), F.lit(pieces)).cast("int"))
    counts = dealt.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("key", "size", "text_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(inside))
        .join(starts, ["shard", "piece"])
        .withColumn("slot", F.col("start") + F.col("rank") - 1)
        .drop("piece", "start", "rank")
    )


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, added=1.0)
    pieces = max(16, shuffle_partitions(spark))
    return with_slots(rows, pieces).select(F.col("key").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
