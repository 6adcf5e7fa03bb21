"""Vector file formats and synthetic data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of vectors that are handed on at once.
STEP = 8 << 20


def _records(content: bytes, kind: str, path: str) -> np.ndarray:
    """Rows of ``[int32 dimension][dimension x 4 bytes]``, little-endian."""
    if not content:
        return np.empty((0, 0), kind)
    d = int(np.frombuffer(content, "<i4", 1)[0])
    width = 4 * (d + 1)
    if d <= 0 or len(content) % width:
        raise ValueError(f"{path} is not a file of equally long vectors")
    raw = np.frombuffer(content, "<i4").reshape(-1, d + 1)
    if (raw[:, 0] != d).any():
        raise ValueError(f"{path} mixes dimensions")
    return raw[:, 1:].view(kind)


def _read(spark: SparkSession, path: str, kind: str, column: str, element: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = _records(content.as_py(), kind, name)
                n, d = rows.shape
                step = max(1, STEP // (4 * max(d, 1)))
                for at in range(0, n, step):
                    part = np.ascontiguousarray(rows[at : at + step])
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), arrays], names=["file", "vec_id", column])

    return files.mapInArrow(run, f"file string, vec_id long, {column} array<{element}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(file, vec_id, embedding), one task for each file; ids count from 0 in each file."""
    return _read(spark, path, "<f4", "embedding", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(file, vec_id, neighbours), the ground truth of a vector set."""
    return _read(spark, path, "<i4", "neighbours", "int")


def fvecs_bytes(rows: np.ndarray) -> bytes:
    """The file content of rows of floats or ints."""
    rows = np.asarray(rows)
    out = np.empty((len(rows), rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = rows.astype("<f4").view("<i4") if rows.dtype.kind == "f" else rows
    return out.tobytes()


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    """One comma-separated vector a line: (query_id, q).  Empty lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    q = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double"))
    return lines.select(F.monotonically_increasing_id().alias("query_id"), q.alias("q"))


def _uniform(seed: int, *parts) -> F.Column:
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def synthetic(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """vec_id, embedding with the id in the first component and U(0, 1) in the others."""
    rest = F.transform(F.sequence(F.lit(1), F.lit(dimension - 1)), lambda i: _uniform(seed, F.col("id"), i).cast("float"))
    head = F.array(F.col("id").cast("float"))
    return spark.range(n).select(F.col("id").alias("vec_id"), (F.concat(head, rest) if dimension > 1 else head).alias("embedding"))


def synthetic_queries(base: DataFrame, n_queries: int, n_base: int) -> DataFrame:
    """Query i is base row 7 i mod n; truth holds that id."""
    spark = base.sparkSession
    picks = spark.range(n_queries).select(F.col("id").alias("query_id"), (F.col("id") * 7 % n_base).alias("vec_id"))
    return picks.join(base, "vec_id").select("query_id", F.col("embedding").cast("array<double>").alias("q"), F.array("vec_id").alias("truth"))


def _gauss(seed: int, *parts) -> F.Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *parts))) * F.cos(2 * np.pi * _uniform(seed + 1, *parts))


def unit_sphere(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """Uniform on the unit sphere."""
    from ..functions import vectors as V

    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: _gauss(seed, F.col("id"), i))
    return spark.range(n).select(F.col("id").alias("vec_id"), V.normalize(raw).cast("array<float>").alias("embedding"))


def clusters(spark: SparkSession, n: int, dimension: int, count: int = 32, sigma: float = 0.08, seed: int = 42) -> DataFrame:
    """Unit-sphere centres plus uniform noise within +-sigma."""
    from ..functions import vectors as V

    dims = F.sequence(F.lit(0), F.lit(dimension - 1))
    centre = V.normalize(F.transform(dims, lambda i: _gauss(seed, F.lit(-1) - F.col("id") % count, i)))
    noise = F.transform(dims, lambda i: (2 * _uniform(seed + 7, F.col("id"), i) - 1) * sigma)
    return spark.range(n).select(F.col("id").alias("vec_id"), F.zip_with(centre, noise, lambda a, b: (a + b).cast("float")).alias("embedding"))
