"""Shared pieces of the training-data operators: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vectorlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Intermediate tables, written once to the shared folder so that lost executors never force a recomputation.

    ``save`` writes a DataFrame as Parquet and reads it back; ``drop`` removes tables that are no longer needed, ``clear`` all
    but the given ones, and both let Spark's cleaner remove the shuffle files of finished jobs.
    Tables that a returned (lazy) result still reads stay until the folder's owner clears it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self._names.add(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_parts(self, df: DataFrame, name: str, part: str, values: tuple) -> list[DataFrame]:
        """One table for each value of the column ``part``, written in one job; ``drop`` knows them as ``name/part=value``."""
        df.write.option("compression", "zstd").partitionBy(part).parquet(f"{self.root}/{name}")
        self._names.add(name)
        schema = df.drop(part).schema
        empty = self.spark.createDataFrame([], schema)
        out = []
        for v in values:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{part}={v}")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            out.append(self.spark.read.schema(schema).parquet(path.toString()) if there else empty)
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self._names.discard(name)
        self.sweep()

    def sweep(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs, those of the operator before, too."""
        self.spark._jvm.System.gc()

    def clear(self, *keep: str) -> None:
        self.drop(*(self._names - set(keep)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none.  Split by JVM code."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")
