"""Incremental maintenance with Structured Streaming: a change-log stream into a store's collection, and access counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import StoredCollection

CHANGES = "op string, id string, embedding array<float>, metadata string, text string, at long"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """File stream of JSON change records (S7); ``at`` orders the changes of an id within a batch."""
    return spark.readStream.schema(CHANGES).json(path)


def apply_changes(stream: DataFrame, collection: StoredCollection, checkpoint: str, seal: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a log append (last change of an id wins) and, with ``seal``, a checkpoint.

    A batch that is run again appends the same changes again, which changes nothing as the log is replayed by id.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("id").agg(F.max_by(F.struct("op", "embedding", "metadata", "text"), "at").alias("r")).select("id", "r.*").persist()
        try:
            ups, downs = last.where("op = 'upsert'"), last.where("op = 'delete'")
            if ups.take(1):
                collection.upsert(ups.drop("op"))
            if downs.take(1):
                collection.delete(downs, missing_ok=True)
            if seal:
                collection.checkpoint()
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(stream: DataFrame, ts: str = "ts", key: str = "cell_key", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Hits for each key and window of event time; late hits count until the watermark passes.  Feeds the access ledger."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("hits"), F.max(ts).alias("last_access"))
