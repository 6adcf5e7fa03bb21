"""Inverted file with product quantisation.

Training runs on a bounded sample, as the centroids are few; assigning, encoding and scanning cover every row.  Tables:
centroids (list_id, centroid), entries (vec_id, list_id, embedding or codes), codebook (subspace, code, centroid).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import InvalidConfig, IvfConfig, metric
from .exact import distances, knn_in_parts, knn_join, matrix, top_k_per_query

LLOYD_ROUNDS, PQ_ROUNDS, CODES = 8, 5, 256


def training_sample(points: DataFrame, config: IvfConfig) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most clamp(256 nlist, 256, 10000) rows, the first by a seeded hash of the id."""
    cap = min(max(256 * config.nlist, 256), 10_000)
    got = points.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(config.seed)), "vec_id").limit(cap).toArrow()
    return got.column("vec_id").to_numpy(), matrix(got.column("embedding"))


def _lloyd(x: np.ndarray, seeds: np.ndarray, rounds: int, metric_name: str) -> np.ndarray:
    centroids = seeds.copy()
    for _ in range(rounds):
        nearest = distances(centroids, x, metric_name).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centroids))
        filled = counts > 0  # an empty list keeps its centroid
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def train(points: DataFrame, config: IvfConfig, metric_name: str = "l2") -> np.ndarray:
    """Centroids, one row each; seeds are the first rows of the sample."""
    _, x = training_sample(points, config)
    if not len(x):
        raise InvalidConfig("there is nothing to train on")
    return _lloyd(x, x[: config.nlist], LLOYD_ROUNDS, metric_name)


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list_id int, centroid array<double>")


def assign(points: DataFrame, centroids: np.ndarray, metric_name: str = "l2") -> DataFrame:
    """Adds list_id, the nearest centroid's number (the first of equals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = distances(centroids, matrix(b.column(1)), metric_name).argmin(axis=1) if b.num_rows else np.empty(0, np.int64)
            yield b.append_column("list_id", pa.array(near.astype(np.int32)))

    return points.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, embedding array<float>, list_id int")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric_name: str = "l2") -> DataFrame:
    """(query_id, list_id) of the nprobe nearest lists."""
    lists = centroids.select(F.col("list_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    return knn_join(lists, queries, nprobe, metric_name).select("query_id", F.col("vec_id").cast("int").alias("list_id"))


def search(entries: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric_name: str = "l2") -> DataFrame:
    """I4: exact distances within the probed lists, by matrix products of a list's rows and the queries that probe it."""
    return knn_in_parts(entries, queries, probes(queries, centroids, nprobe, metric_name), k, metric_name, "list_id")


@dataclass(frozen=True)
class Codebook:
    """M x 256 x (dimension / m) centroids."""

    centroids: np.ndarray

    @property
    def m(self) -> int:
        return self.centroids.shape[0]

    @staticmethod
    def train(x: np.ndarray, m: int, seed: int = 42) -> Codebook:
        n, d = x.shape
        if d % m:
            raise InvalidConfig(f"{m} subspaces do not divide {d} dimensions")
        rng = np.random.default_rng(seed)
        books = []
        for part in np.split(x, m, axis=1):
            seeds = part[np.arange(CODES) % n] + rng.uniform(0, 1e-3, (CODES, d // m))
            books.append(_lloyd(part, seeds, PQ_ROUNDS, "l2"))
        return Codebook(np.stack(books))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One code for each subspace."""
        return np.stack([distances(book, part, "l2").argmin(axis=1) for book, part in zip(self.centroids, np.split(x, self.m, axis=1), strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Lossy vectors."""
        return np.concatenate([book[c] for book, c in zip(self.centroids, codes.T, strict=True)], axis=1)

    def tables(self, q: np.ndarray, metric_name: str) -> np.ndarray:
        """I8: for one query, the part of the distance that each code adds."""
        parts = np.split(q, self.m)
        if metric(metric_name) == "dot":
            return np.stack([-(book @ p) for book, p in zip(self.centroids, parts, strict=True)])
        return np.stack([((book - p) ** 2).sum(axis=1) for book, p in zip(self.centroids, parts, strict=True)])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def train_codebook(points: DataFrame, config: IvfConfig, metric_name: str = "l2") -> Codebook:
    _, x = training_sample(points, config)
    return Codebook.train(_unit(x) if metric(metric_name) == "cosine" else x, config.pq_m or 1, config.seed)


def encode(entries: DataFrame, book: Codebook, metric_name: str = "l2") -> DataFrame:
    """Entries with codes in place of vectors (cosine: of unit vectors)."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(2))
            codes = book.encode(_unit(x) if metric(metric_name) == "cosine" else x) if len(x) else np.empty((0, book.m), np.int64)
            flat = pa.array(codes.astype(np.int16).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * book.m), flat)], names=["vec_id", "list_id", "codes"])

    return entries.select("vec_id", "list_id", "embedding").mapInArrow(run, "vec_id long, list_id int, codes array<short>")


def search_codes(coded: DataFrame, queries: DataFrame, centroids: DataFrame, book: Codebook, k: int, nprobe: int, metric_name: str = "l2", each: bool = False) -> DataFrame:
    """I8: distances to the coded vectors within the probed lists; for cosine half the squared distance of unit vectors, 1 - cos.

    With ``each`` the k nearest of every probed list (``part``): codes err more than neighbours in long lists differ, so one pool of k is too few for ``rerank``.
    They are the sums of lookup table entries (``Codebook.tables``), computed for a whole list and its queries as the distance to the decoded vectors.
    """
    cosine = metric(metric_name) == "cosine"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = book.decode(b.column(2).flatten().to_numpy().reshape(-1, book.m))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "list_id", "embedding"])

    decoded = coded.select("vec_id", "list_id", "codes").mapInArrow(decode, "vec_id long, list_id int, embedding array<double>")
    asked = queries.select("query_id", V.normalize(F.col("q")).alias("q")) if cosine else queries
    found = knn_in_parts(decoded, asked, probes(queries, centroids, nprobe, metric_name), k, "l2" if cosine else metric_name, "list_id", each)
    return found.withColumn("distance", F.col("distance") / 2) if cosine else found


def rerank(pool: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric_name: str) -> DataFrame:
    """Exact distances for a pool of (query_id, vec_id), k best."""
    near = points.select("vec_id", "embedding").join(pool.select("query_id", "vec_id"), "vec_id").join(queries.select("query_id", "q"), "query_id")
    return top_k_per_query(near.select("query_id", "vec_id", V.distance(metric_name, F.col("embedding"), F.col("q")).alias("distance")), k)


def appended(entries: DataFrame, points: DataFrame, centroids: np.ndarray, metric_name: str = "l2") -> DataFrame:
    """Entries with new or changed points in place of their old rows."""
    fresh = assign(points, centroids, metric_name)
    return entries.join(fresh.select("vec_id"), "vec_id", "left_anti").unionByName(fresh)


def removed(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("vec_id"), "vec_id", "left_anti")


def memory(entries: DataFrame, dimension: int, nlist: int, pq_m: int | None = None) -> DataFrame:
    """Bytes of centroids, of entries, and in all."""
    width = F.lit(8 + (pq_m if pq_m else 4 * dimension)).cast("long")
    return entries.agg((F.count(F.lit(1)) * width).alias("entry_bytes")).select(F.lit(nlist * dimension * 4).cast("long").alias("centroid_bytes"), "entry_bytes", (F.col("entry_bytes") + nlist * dimension * 4).alias("total_bytes"))
