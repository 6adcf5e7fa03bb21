"""Collections on a file system: catalog, change log, segments, checkpoints, snapshots.

A collection is a folder with ``manifest.json``, a change log of Parquet files (seq, op, id, vec_id, embedding, metadata,
text) and sealed segments.  Every checkpoint writes a new segment of changed rows and tombstones and then replaces the manifest, so a
reader sees one version or the next; the newest segment's row of an id counts.  Sequence numbers never restart.
Files are reached through Hadoop's file-system API, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import AlreadyExists, CollectionConfig, ConcurrentWrite, InvalidConfig, NotFound

DEFAULT_NAMESPACE = "_default"
#: A checkpoint compacts at so many segments or tombstones.
COMPACT_SEGMENTS, COMPACT_DELETED = 32, 1000
ROW = "id string, vec_id long, embedding array<float>, metadata string, text string, seq long, deleted boolean"
LOG = "seq long, op string, id string, vec_id long, embedding array<float>, metadata string, text string"


class Files:
    """The few file operations that the catalog needs."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def read(self, name: str) -> str:
        p = self._path(name)
        stream = self._fs(p).open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside its place, then renamed over the old file."""
        new, old = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        fs = self._fs(old)
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else fs.getUri(), self._conf)
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(new, old, options)

    def delete(self, name: str) -> None:
        p = self._path(name)
        self._fs(p).delete(p, True)

    def folders(self, name: str = "") -> list[str]:
        p = self._path(name)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def copy(self, source: str, target: str) -> None:
        a, b = self._path(source), self._path(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(a), a, self._fs(b), b, False, True, self._conf)


def qualified(name: str, namespace: str = "") -> str:
    """``foo`` in the default namespace, else ``ns/foo``."""
    return name if namespace in ("", DEFAULT_NAMESPACE) else f"{namespace}/{name}"


class Store:
    """Catalog of collections under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def create(self, config: CollectionConfig, namespace: str = "") -> StoredCollection:
        name = qualified(config.name, namespace)
        if self.exists(name):
            raise AlreadyExists(name)
        self.files.write(f"collections/{name}/manifest.json", json.dumps({"config": config.to_dict(), "next_seq": 1, "sealed_seq": 0, "next_id": 0, "segments": [], "logs": [], "deleted": 0}))
        return StoredCollection(self, name)

    def exists(self, name: str, namespace: str = "") -> bool:
        return self.files.exists(f"collections/{qualified(name, namespace)}/manifest.json")

    def open(self, name: str, namespace: str = "") -> StoredCollection:
        full = qualified(name, namespace)
        if not self.exists(full):
            raise NotFound(full)
        return StoredCollection(self, full)

    def get_or_create(self, config: CollectionConfig, namespace: str = "") -> StoredCollection:
        return self.open(config.name, namespace) if self.exists(config.name, namespace) else self.create(config, namespace)

    def delete(self, name: str, namespace: str = "") -> None:
        self.open(name, namespace)
        self.files.delete(f"collections/{qualified(name, namespace)}")

    def names(self, namespace: str | None = None) -> list[str]:
        """All collections, or those of one namespace without its prefix."""

        def walk(at: str) -> list[str]:
            if at and self.files.exists(f"collections/{at}/manifest.json"):
                return [at]
            return [x for f in self.files.folders(f"collections/{at}".rstrip("/")) for x in walk(f"{at}/{f}".lstrip("/"))]

        found = walk("")
        if namespace is None:
            return found
        prefix = "" if namespace in ("", DEFAULT_NAMESPACE) else f"{namespace}/"
        return [x[len(prefix) :] for x in found if x.startswith(prefix) and "/" not in x[len(prefix) :]]

    def snapshot(self, name: str, collections: Sequence[str] | None = None) -> None:
        """Copies collections; the description is written last and makes the snapshot exist."""
        chosen = list(collections) if collections is not None else self.names()
        if self.files.exists(f"snapshots/{name}/snapshot.json"):
            raise AlreadyExists(name)
        for c in chosen:
            self.open(c).checkpoint()
            self.files.copy(f"collections/{c}", f"snapshots/{name}/collections/{c}")
        self.files.write(f"snapshots/{name}/snapshot.json", json.dumps({"name": name, "collections": chosen, "created_ms": int(time.time() * 1000)}))

    def snapshots(self) -> list[str]:
        return [x for x in self.files.folders("snapshots") if self.files.exists(f"snapshots/{x}/snapshot.json")]

    def snapshot_meta(self, name: str) -> dict:
        if not self.files.exists(f"snapshots/{name}/snapshot.json"):
            raise NotFound(name)
        return json.loads(self.files.read(f"snapshots/{name}/snapshot.json"))

    def delete_snapshot(self, name: str) -> None:
        self.snapshot_meta(name)
        self.files.delete(f"snapshots/{name}")

    def restore(self, name: str, replace_all: bool = False) -> None:
        """Brings back the snapshot's collections; ``replace_all`` also removes all others."""
        meta = self.snapshot_meta(name)
        for c in self.names() if replace_all else [x for x in meta["collections"] if self.exists(x)]:
            self.files.delete(f"collections/{c}")
        for c in meta["collections"]:
            self.files.copy(f"snapshots/{name}/collections/{c}", f"collections/{c}")


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Each key's row with the highest sequence number.  ``max_by`` combines before the shuffle, so no key's history meets in one task."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).select(*rows.columns)


def latest_wide(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """As ``latest`` for wide rows: the winners are found from the key and the number alone, and rows that lost go before the wide columns move."""
    best = rows.groupBy(key).agg(F.max(order).alias("_best")).withColumnRenamed(key, "_key")
    return rows.join(best, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_best")), "left_semi")


def replay(log: DataFrame, after: int = 0) -> DataFrame:
    """Net effect of the log records after a sequence number: ROW columns, one row for each id.

    An upsert without text keeps the text of the last upsert since the last delete that had one; ``text_known`` tells whether the log says.
    """
    new = log.where(F.col("seq") > after)
    last = new.groupBy("id").agg(
        F.max_by(F.struct("seq", "op", "vec_id", "embedding", "metadata"), "seq").alias("r"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("cut"),
        F.max(F.when((F.col("op") == "upsert") & F.col("text").isNotNull(), F.struct("seq", "text"))).alias("t"),
    )
    told = F.col("t.seq") > F.coalesce("cut", F.lit(0))
    return last.select(
        "id", F.col("r.vec_id").alias("vec_id"), F.col("r.embedding").alias("embedding"), F.col("r.metadata").alias("metadata"),
        F.when(told, F.col("t.text")).alias("text"), F.col("r.seq").alias("seq"), (F.col("r.op") == "delete").alias("deleted"),
        (F.coalesce(told, F.lit(False)) | F.col("cut").isNotNull()).alias("text_known"),
    )


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Live and deleted rows after applying ``replay`` output to a base of ROW columns."""
    old = base.select("id", F.col("text").alias("old_text"), F.col("vec_id").alias("old_id"), F.col("deleted").alias("old_deleted"))
    kept_text = F.when(~F.coalesce("old_deleted", F.lit(True)), F.col("old_text"))
    kept_id = F.when(~F.coalesce("old_deleted", F.lit(True)), F.col("old_id"))
    fresh = changes.join(old, "id", "left").select("id", F.coalesce(kept_id, "vec_id").alias("vec_id"), "embedding", "metadata", F.when(F.col("text_known"), F.col("text")).otherwise(kept_text).alias("text"), "seq", "deleted")
    return base.join(changes.select("id"), "id", "left_anti").unionByName(fresh)


class StoredCollection:
    def __init__(self, store: Store, name: str):
        self.store, self.spark, self.name = store, store.spark, name
        self._at = f"collections/{name}"

    @property
    def path(self) -> str:
        return f"{self.store.files.root}/{self._at}"

    def manifest(self) -> dict:
        return json.loads(self.store.files.read(f"{self._at}/manifest.json"))

    def _swap(self, manifest: dict) -> None:
        self.store.files.write(f"{self._at}/manifest.json", json.dumps(manifest))

    @property
    def config(self) -> CollectionConfig:
        return CollectionConfig.from_dict(self.manifest()["config"])

    # change log

    def _append(self, rows: DataFrame, m: dict) -> None:
        """Writes records, numbered after manifest ``m``, to a folder of their own; only the manifest's swap makes them part of the log, so a failed write leaves nothing behind."""
        folder = f"{m['next_seq']:020d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[c.split()[0] for c in LOG.split(", ")]).write.parquet(f"{self.path}/log/{folder}")
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{folder}").agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("ids")).first()
        now = self.manifest()
        if (now["next_seq"], now["segments"]) != (m["next_seq"], m["segments"]):
            raise ConcurrentWrite(f"{self.name} was changed while rows were written")
        now["logs"] = [*now["logs"], folder]
        now["next_seq"] += written["n"]
        now["next_id"] += written["ids"]
        self._swap(now)

    def upsert(self, rows: DataFrame) -> None:
        """Rows of id, embedding and optionally metadata (JSON) and text, as one log file.  A repeated id's last row by text order of its fields counts."""
        m = self.manifest()
        d = m["config"]["dimension"]
        have = rows.columns
        v = F.col("embedding").cast("array<float>")
        good = F.col("id").isNotNull() & (F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        checked = F.when(F.coalesce(good, F.lit(False)), v).otherwise(F.raise_error(F.lit(f"a row lacks an id or a finite vector of dimension {d}")).cast("array<float>"))
        told = rows.select("id", checked.alias("embedding"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("metadata", "text")])
        told = told.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
        numbered = _numbered(told, m["next_seq"])
        self._append(numbered.select("*", F.lit("upsert").alias("op"), (F.col("seq") - m["next_seq"] + m["next_id"]).alias("vec_id")), m)

    def delete(self, ids: Sequence[str] | DataFrame, missing_ok: bool = False) -> None:
        """Fails on ids that are not there unless ``missing_ok``."""
        m = self.manifest()
        gone = ids.select("id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "id string")
        if not missing_ok and (lost := gone.join(self.points(), "id", "left_anti").take(1)):
            raise NotFound(lost[0]["id"])
        blank = gone.select("id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("text"))
        self._append(_numbered(blank, m["next_seq"]).select("*", F.lit("delete").alias("op"), F.lit(None).cast("long").alias("vec_id")), m)

    def log(self, after: int | None = None) -> DataFrame:
        """Log records after a sequence number (default: those not sealed yet)."""
        m = self.manifest()
        after = m["sealed_seq"] if after is None else after
        files = m["logs"]
        if not files:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/{f}" for f in files]).where((F.col("seq") > after) & (F.col("seq") < m["next_seq"]))

    def wal_lag(self) -> int:
        """Records after the last checkpoint."""
        return self.log().count()

    # segments

    def sealed(self) -> DataFrame:
        """S3: newest row of each id in the sealed segments, tombstones included."""
        segments = self.manifest()["segments"]
        if not segments:
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(ROW).parquet(*[f"{self.path}/segments/{s}" for s in segments])
        return rows if len(segments) == 1 else latest_wide(rows)  # a segment holds each id once

    def points(self) -> DataFrame:
        """Live rows: id, vec_id, embedding, metadata, text.  Sealed rows with the open log on top."""
        rows = merged(self.sealed(), replay(self.log())) if self.manifest()["logs"] else self.sealed()
        return rows.where("not deleted").drop("deleted", "seq")

    def count(self) -> int:
        return self.points().count()

    def contains(self, id_: str) -> bool:
        return bool(self.points().where(F.col("id") == id_).take(1))

    def checkpoint(self) -> None:
        """Seals the open log as one segment of changed rows and moves the watermark; compacts if due."""
        m = self.manifest()
        changes = replay(self.log())
        if changes.take(1):
            base = self.sealed()
            touched = merged(base.join(changes.select("id"), "id", "left_semi"), changes)
            name = f"{m['next_seq']:020d}-{uuid.uuid4().hex[:8]}"
            touched.select(*[c.split()[0] for c in ROW.split(", ")]).write.parquet(f"{self.path}/segments/{name}")
            old_logs, m["logs"] = self.store.files.folders(f"{self._at}/log"), []  # leftovers of failed writes among them
            m["segments"].append(name)
            m["sealed_seq"] = m["next_seq"] - 1
            m["deleted"] += self.spark.read.schema(ROW).parquet(f"{self.path}/segments/{name}").where("deleted").count()
            self._swap(m)
            for f in old_logs:
                self.store.files.delete(f"{self._at}/log/{f}")
        if len(m["segments"]) >= COMPACT_SEGMENTS or m["deleted"] >= COMPACT_DELETED:
            self.compact()

    def compact(self) -> None:
        """One segment of live rows, swapped in before the old ones are removed."""
        m = self.manifest()
        if not m["segments"]:
            return
        name = f"{m['sealed_seq']:020d}-{uuid.uuid4().hex[:8]}"
        self.sealed().where("not deleted").write.parquet(f"{self.path}/segments/{name}")
        old, m["segments"], m["deleted"] = m["segments"], [name], 0
        self._swap(m)
        for s in old:
            self.store.files.delete(f"{self._at}/segments/{s}")

    def segment_stats(self) -> dict:
        """P10."""
        m = self.manifest()
        return {"segments": len(m["segments"]), "deleted": m["deleted"], "sealed_seq": m["sealed_seq"], "next_seq": m["next_seq"], "rows": self.sealed().where("not deleted").count()}

    # derived tables (S6, S10, S11): rebuilt from the points, so that losing one loses nothing

    def write_derived(self, name: str, table: DataFrame, partition_by: str | None = None) -> None:
        writer = table.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/derived/{name}")

    def version(self) -> str:
        """Changes with the sealed segments; names the tables that are derived from them."""
        return hashlib.md5("/".join(self.manifest()["segments"]).encode()).hexdigest()[:16]

    def derived(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/derived/{name}") if self.store.files.exists(f"{self._at}/derived/{name}") else None

    def check(self) -> None:
        """External and internal ids are both unique among live rows."""
        p = self.points()
        for c in ("id", "vec_id"):
            if p.groupBy(c).count().where("count > 1").take(1):
                raise InvalidConfig(f"{c} is not unique in {self.name}")


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """Adds seq from ``first`` without gaps: ranks inside hashed pieces plus the pieces' starts."""
    spark = rows.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int"))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row for each piece
    starts = counts.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first - 1).alias("_s"))
    order = Window.partitionBy("_p").orderBy(*[F.col(c) for c in rows.columns])
    return dealt.withColumn("_r", F.row_number().over(order)).join(F.broadcast(starts), "_p").withColumn("seq", (F.col("_s") + F.col("_r")).cast("long")).drop("_p", "_s", "_r")
