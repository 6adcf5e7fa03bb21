"""The user's view: a database of collections with upsert, search in all forms, persistence and explanation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import cells, exact, filters, fusion, graph, grid, ivf, sparse
from .plans import planner
from .sources.store import Store, StoredCollection
from .types import CollectionConfig, DimensionMismatch


class Collection:
    def __init__(self, stored: StoredCollection):
        self.stored, self.spark, self.config = stored, stored.spark, stored.config

    # changes

    def upsert(self, ids: Sequence[str], vectors: Sequence[Sequence[float]], metadatas: Sequence[dict] | None = None, texts: Sequence[str] | None = None) -> None:
        import json

        for name, values in (("vectors", vectors), ("metadatas", metadatas), ("texts", texts)):
            if values is not None and len(values) != len(ids):
                raise ValueError(f"{len(ids)} ids, but {len(values)} {name}")
        for v in vectors:
            if len(v) != self.config.dimension:
                raise DimensionMismatch(f"expected {self.config.dimension} components, got {len(v)}")
        last = {x: i for i, x in enumerate(ids)}  # of a repeated id the last row counts
        rows = [(ids[i], [float(x) for x in vectors[i]], json.dumps(metadatas[i] if metadatas else {}), texts[i] if texts else None) for i in last.values()]
        self.upsert_rows(self.spark.createDataFrame(rows, "id string, embedding array<float>, metadata string, text string"))

    def upsert_rows(self, rows: DataFrame) -> None:
        self.stored.upsert(rows)

    def delete(self, ids: Sequence[str]) -> None:
        self.stored.delete(ids)

    def persist(self) -> None:
        self.stored.checkpoint()

    def compact(self) -> None:
        self.stored.compact()

    # state

    def count(self) -> int:
        return self.stored.count()

    def contains(self, id_: str) -> bool:
        return self.stored.contains(id_)

    def wal_pending(self) -> int:
        return self.stored.wal_lag()

    def segment_stats(self) -> dict:
        return self.stored.segment_stats()

    def points(self, filter: Any = None) -> DataFrame:
        p = self.stored.points()
        return p if filter is None else p.where(self.predicate(filter))

    @staticmethod
    def predicate(filter: Any):
        return filters.variant_predicate(F.try_parse_json(F.coalesce("metadata", F.lit("{}"))), filter)

    # search

    def queries(self, vectors: Sequence[Sequence[float]], texts: Sequence[str] | None = None) -> DataFrame:
        for v in vectors:
            if len(v) != self.config.dimension:
                raise DimensionMismatch(f"expected {self.config.dimension} components, got {len(v)}")
        rows = [(i, [float(x) for x in v], texts[i] if texts else None) for i, v in enumerate(vectors)]
        return self.spark.createDataFrame(rows, "query_id long, q array<double>, text string")

    def _named(self, hits: DataFrame, scored: bool = False) -> DataFrame:
        score = F.col("score") if scored else V.score(F.col("distance"))
        named = hits.join(self.stored.points().select("vec_id", "id", "metadata"), "vec_id")
        return named.select("query_id", "id", F.col("vec_id").alias("internal_id"), "distance", score.alias("score"), "metadata", "rank").orderBy("query_id", "rank")

    def query(self, vector: Sequence[float], top_k: int = 10, filter: Any = None, **options) -> DataFrame:
        return self.query_batch([vector], top_k, filter, **options)

    def query_batch(self, vectors: Sequence[Sequence[float]], top_k: int = 10, filter: Any = None, index: str | None = None, ef: int | None = None, nprobe: int | None = None) -> DataFrame:
        """query_id, id, internal_id, distance, score, metadata, rank.  ``index`` overrides the collection's kind: "flat" is exact, "auto" asks the planner."""
        return self.search_frame(self.queries(vectors), top_k, filter, index, ef, nprobe)

    def search_frame(self, asked: DataFrame, top_k: int = 10, filter: Any = None, index: str | None = None, ef: int | None = None, nprobe: int | None = None) -> DataFrame:
        """As ``query_batch`` for a table of queries (query_id, q)."""
        return self._named(self._search(asked, top_k, filter, index or self.config.index, ef, nprobe))

    # stored indexes: built from the sealed rows once for each version of them, searched together with what changed since

    def build_index(self, kind: str | None = None) -> None:
        """Writes the index of the sealed rows, unless it is there.  Searches call it; a writer may do so after a checkpoint."""
        c, kind = self.config, kind or self.config.index
        base = f"{kind}-{self.stored.version()}"
        if kind == "flat" or self.stored.derived(f"{base}/done") is not None:
            return
        rows = self.stored.sealed().where("not deleted").select("vec_id", "embedding")
        if kind == "ivf":
            centroids = ivf.train(rows, c.ivf, c.metric)
            entries = ivf.assign(rows, centroids, c.metric)
            if c.ivf.pq_m:
                book = ivf.train_codebook(rows, c.ivf, c.metric)
                self.stored.write_derived(f"{base}/codebook", self.spark.createDataFrame([(book.centroids.ravel().tolist(), list(book.centroids.shape))], "v array<double>, shape array<int>"))
                entries = ivf.encode(entries, book, c.metric)
            self.stored.write_derived(f"{base}/lists", ivf.centroid_table(self.spark, centroids))
            self.stored.write_derived(f"{base}/entries", entries, "list_id")
        elif kind == "grid":
            self.stored.write_derived(f"{base}/cells", grid.with_cells(rows, c.dimension, c.grid))
        else:
            self.stored.write_derived(f"{base}/edges", graph.build(rows, c.hnsw, c.metric))
        self.stored.write_derived(f"{base}/done", self.spark.range(1))  # last: half an index is none

    def _search(self, asked: DataFrame, k: int, filter: Any, kind: str, ef: int | None, nprobe: int | None) -> DataFrame:
        c, name = self.config, self.config.metric
        points = self.points(filter)
        rows = points.count()
        if kind == "auto":
            kind = planner.choose(rows, c.dimension, k, filter is not None).index
        sealed = self.stored.manifest()["segments"]
        if k < 1 or kind == "flat" or not sealed or rows <= max(8 * k, 64) or kind == "ivf" and rows < c.ivf.nlist:
            return exact.knn_join(points, asked, k, name)
        self.build_index(kind)
        changed = self.stored.log().select("id").distinct()
        delta = exact.knn_join(points.join(changed, "id", "left_semi"), asked, k, name)
        untouched = points.join(changed, "id", "left_anti").select("vec_id", "embedding")
        return grid.merge_top_k([self._indexed(asked, k, kind, untouched, ef, nprobe), delta], k)

    def _indexed(self, asked: DataFrame, k: int, kind: str, eligible: DataFrame, ef: int | None, nprobe: int | None) -> DataFrame:
        """The index's hits among the eligible rows (vec_id, embedding)."""
        c, name = self.config, self.config.metric
        part = lambda x: self.stored.derived(f"{kind}-{self.stored.version()}/{x}")
        ids = eligible.select("vec_id")
        if kind == "ivf":
            entries, lists = part("entries").join(ids, "vec_id", "left_semi"), part("lists")
            if c.ivf.pq_m:
                stored = part("codebook").first()
                book = ivf.Codebook(np.array(stored["v"]).reshape(stored["shape"]))
                pool = ivf.search_codes(entries, asked, lists, book, 5 * k, nprobe or c.ivf.nprobe, name, each=True)
                return ivf.rerank(pool, eligible, asked, k, name)
            return ivf.search(entries, asked, lists, k, nprobe or c.ivf.nprobe, name)
        if kind == "grid":
            return cells.search(part("cells").join(ids, "vec_id", "left_semi"), asked, k, c.dimension, c.grid, name)[0]
        every = self.stored.sealed().where("not deleted").select("vec_id", "embedding").join(ids.select(F.col("vec_id").alias("ok_id")), F.col("vec_id") == F.col("ok_id"), "left")
        return graph.search(part("edges"), every, asked, k, c.hnsw, name, ef, eligible=F.col("ok_id").isNotNull())

    def query_hybrid(self, vector: Sequence[float], text: str, top_k: int = 10, filter: Any = None, method: str = "rrf", dense_weight: float = fusion.DENSE_WEIGHT, rrf_k: int = fusion.RRF_K, prefetch: int | None = None) -> DataFrame:
        where = None if filter is None else self.predicate(filter)
        hits = fusion.hybrid(self.stored.points(), self.queries([vector], [text]), top_k, self.config.metric, method, dense_weight, rrf_k, prefetch, where)
        return self._named(hits, scored=True)

    def query_sparse(self, text: str, top_k: int = 10, filter: Any = None) -> DataFrame:
        where = None if filter is None else self.predicate(filter)
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return self._named(sparse.search(self.stored.points(), asked, top_k, "vec_id", "text", where).withColumnRenamed("doc_id", "vec_id"), scored=True)

    def explain(self, vector: Sequence[float], top_k: int = 10, filter: Any = None) -> dict:
        """The planner's choice, the filter strategy and, for the grid, what a query visits."""
        total = self.count()
        plan = planner.choose(total, self.config.dimension, top_k, filter is not None)
        eligible = None if filter is None else self.points(filter).count()
        out = {"rows": total, "index": plan.index, "ef": plan.ef, "reason": plan.reason, "strategy": planner.strategy(filter, eligible, top_k), "eligible": eligible}
        if self.config.index == "grid":
            rows = grid.with_cells(self.points(filter), self.config.dimension, self.config.grid)
            out["grid"] = cells.search(rows, self.queries([vector]), top_k, self.config.dimension, self.config.grid, self.config.metric)[1].first().asDict()
        return out

    def grid_stats(self) -> dict:
        return cells.stats(grid.with_cells(self.points(), self.config.dimension, self.config.grid)).first().asDict()


class ShardedCollection:
    """A collection whose sealed rows are also kept in folders by shard, so that a query reads its target shards only.

    A row's shard follows from its vector (the hash of its grid cell), so no placement has to be remembered; ``placements``
    derives it.  Rows changed since the last checkpoint are searched exactly, whatever their shard.
    """

    def __init__(self, collection: Collection, shards: int):
        if shards < 1:
            raise ValueError("at least one shard is needed")
        self.rows, self.shards = collection, shards

    def upsert_rows(self, rows: DataFrame) -> None:
        self.rows.upsert_rows(rows)

    def delete(self, ids: Sequence[str]) -> None:
        self.rows.delete(ids)

    def count(self) -> int:
        return self.rows.count()

    def _sharded(self, points: DataFrame) -> DataFrame:
        return grid.sharded(points, self.rows.config.dimension, self.shards, self.rows.config.grid)

    def placements(self) -> DataFrame:
        """id, shard_id of all live rows."""
        return self._sharded(self.rows.points()).select("id", "shard_id")

    def checkpoint(self) -> None:
        self.rows.persist()
        self._folders()

    def _folders(self) -> DataFrame:
        """The sealed rows by shard, written once for each version of them."""
        stored = self.rows.stored
        base = f"shards-{self.shards}-{stored.version()}"
        if stored.derived(f"{base}/done") is None:
            stored.write_derived(f"{base}/rows", self._sharded(stored.sealed().where("not deleted").select("vec_id", "embedding")), "shard_id")
            stored.write_derived(f"{base}/done", self.rows.spark.range(1))
        return stored.derived(f"{base}/rows")

    def query_batch(self, vectors: Sequence[Sequence[float]], top_k: int = 10, radius: int = 1, filter: Any = None) -> DataFrame:
        """As ``Collection.query_batch``, from the shards of the query's cell and of those up to ``radius`` cells around it."""
        c, stored = self.rows.config, self.rows.stored
        asked, points = self.rows.queries(vectors), self.rows.points(filter)
        targets = grid.target_shards(asked, c.dimension, self.shards, radius, c.grid)
        wanted = [r["shard_id"] for r in targets.select("shard_id").distinct().collect()]  # at most ``shards`` numbers
        changed = stored.log().select("id").distinct()
        parts = [exact.knn_join(points.join(changed, "id", "left_semi"), asked, top_k, c.metric)]
        if stored.manifest()["segments"]:
            ids = points.join(changed, "id", "left_anti").select("vec_id")
            here = self._folders().where(F.col("shard_id").isin(wanted)).join(ids, "vec_id", "left_semi")
            parts.append(grid.search_shards(here, asked, targets, top_k, c.metric))
        return self.rows._named(grid.merge_top_k(parts, top_k))


class Database:
    """Named collections under one root folder; namespaces keep tenants apart."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def create(self, name: str, dimension: int, metric: str = "cosine", index: str = "hnsw", namespace: str = "", **options) -> Collection:
        return Collection(self.store.create(CollectionConfig(name, dimension, metric, index, **options), namespace))

    def get(self, name: str, namespace: str = "") -> Collection:
        return Collection(self.store.open(name, namespace))

    def get_or_create(self, name: str, dimension: int, metric: str = "cosine", index: str = "hnsw", namespace: str = "", **options) -> Collection:
        return Collection(self.store.get_or_create(CollectionConfig(name, dimension, metric, index, **options), namespace))

    def create_sharded(self, name: str, dimension: int, shards: int, metric: str = "cosine", namespace: str = "", **options) -> ShardedCollection:
        return ShardedCollection(self.create(name, dimension, metric, "flat", namespace, **options), shards)

    def get_sharded(self, name: str, shards: int, namespace: str = "") -> ShardedCollection:
        return ShardedCollection(self.get(name, namespace), shards)

    def delete(self, name: str, namespace: str = "") -> None:
        self.store.delete(name, namespace)

    def list(self, namespace: str | None = None) -> list[str]:
        return self.store.names(namespace)

    def persist_all(self) -> None:
        for name in self.store.names():
            self.store.open(name).checkpoint()
