"""Nested routing grid over [0, 1)^2 and shard routing.

A cell's key is ``layer:x:y``.  Sign rows of the projection and routing hashes derive from md5, so that any SQL engine can repeat them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import GridConfig
from .exact import knn_in_parts, top_k_per_query


def sign_rows(dimension: int, seed: int = 42) -> list[list[float]]:
    """Two rows of +-1 / sqrt(dimension)."""
    bit = lambda r, i: hashlib.md5(f"{seed}:{r}:{i}".encode()).digest()[0] & 1
    return [[(1 if bit(r, i) else -1) / dimension**0.5 for i in range(dimension)] for r in range(2)]


def project(v: Column, dimension: int, seed: int = 42) -> tuple[Column, Column]:
    """(tanh(sign row . v) + 1) / 2, within [0, 0.9999]."""
    to = lambda row: F.greatest(F.lit(0.0), F.least(F.lit(0.9999), (F.tanh(V.dot(v, V.vector(row))) + 1) / 2))
    x, y = sign_rows(dimension, seed)
    return to(x), to(y)


@dataclass(frozen=True)
class Layer:
    number: int
    width: int
    height: int
    origin: float
    extent: float


def layers(config: GridConfig = GridConfig()) -> list[Layer]:
    """Z3: each layer is centred in the one before, ``pitch_ratio`` as wide and with as much fewer cells."""
    out, origin, extent = [], 0.0, 1.0
    for n in range(config.max_layers):
        w, h = (max(1, int(g * config.pitch_ratio**n)) for g in config.outer_grid)
        out.append(Layer(n, w, h, origin, extent))
        origin += extent * (1 - config.pitch_ratio) / 2
        extent *= config.pitch_ratio
    return out


def contains(layer: Layer, x: Column, y: Column) -> Column:
    low, high = layer.origin, layer.origin + layer.extent
    return (x >= low) & (x < high) & (y >= low) & (y < high)


def cell_at(layer: Layer, x: Column, y: Column) -> Column:
    """Struct (layer, x, y) of a point in the layer, null outside."""
    axis = lambda v, n: F.least(F.lit(n - 1), F.floor((v - layer.origin) / layer.extent * n)).cast("int")
    cell = F.struct(F.lit(layer.number).alias("layer"), axis(x, layer.width).alias("x"), axis(y, layer.height).alias("y"))
    return F.when(contains(layer, x, y), cell)


def deepest_cell(x: Column, y: Column, config: GridConfig = GridConfig()) -> Column:
    """The cell in the innermost layer that contains the point."""
    return F.coalesce(*[cell_at(layer, x, y) for layer in reversed(layers(config))])


def key(cell: Column) -> Column:
    return F.concat_ws(":", cell["layer"], cell["x"], cell["y"])


def centre(cell: Column, config: GridConfig = GridConfig()) -> tuple[Column, Column]:
    def axis(name, attr):
        at = lambda layer: layer.origin + (cell[name] + 0.5) / getattr(layer, attr) * layer.extent
        return F.coalesce(*[F.when(cell["layer"] == layer.number, at(layer)) for layer in layers(config)])

    return axis("x", "width"), axis("y", "height")


def child_cell(cell: Column, config: GridConfig = GridConfig()) -> Column:
    """The cell of the next layer that holds the cell's centre, or null."""
    x, y = centre(cell, config)
    return F.coalesce(*[F.when(cell["layer"] == layer.number - 1, cell_at(layer, x, y)) for layer in layers(config)[1:]], F.lit(None).cast("struct<layer:int,x:int,y:int>"))


def parent_cell(cell: Column, config: GridConfig = GridConfig()) -> Column:
    """The cell of the layer before that holds the cell's centre, or null."""
    x, y = centre(cell, config)
    return F.coalesce(*[F.when(cell["layer"] == layer.number + 1, cell_at(layer, x, y)) for layer in layers(config)[:-1]], F.lit(None).cast("struct<layer:int,x:int,y:int>"))


def neighbourhood(x: Column, y: Column, radius: int, config: GridConfig = GridConfig()) -> Column:
    """Array of the cells within ``radius`` of the point's cell, in every layer that contains the point, with their distance ``ring``."""

    def box(layer: Layer) -> Column:
        c = cell_at(layer, x, y)
        span = lambda at, n: F.sequence(F.greatest(F.lit(0), at - radius), F.least(F.lit(n - 1), at + radius))
        row = lambda i: F.transform(span(c["y"], layer.height), lambda j: F.struct(F.lit(layer.number).alias("layer"), i.alias("x"), j.alias("y"), F.greatest(F.abs(i - c["x"]), F.abs(j - c["y"])).alias("ring")))
        cells = F.flatten(F.transform(span(c["x"], layer.width), row))
        return F.when(contains(layer, x, y), cells).otherwise(F.array().cast("array<struct<layer:int,x:int,y:int,ring:int>>"))

    return F.concat(*[box(layer) for layer in layers(config)])


def all_cells(df: DataFrame, layer: Layer) -> DataFrame:
    """Every cell of a layer."""
    spark = df.sparkSession
    n = layer.width * layer.height
    return spark.range(n).select(F.lit(layer.number).alias("layer"), (F.col("id") % layer.width).cast("int").alias("x"), F.floor(F.col("id") / layer.width).cast("int").alias("y"))


def with_cells(points: DataFrame, dimension: int, config: GridConfig = GridConfig(), vector: str = "embedding") -> DataFrame:
    """Adds px, py and the deepest cell as layer, cx, cy, cell_key."""
    x, y = project(F.col(vector), dimension, config.projection_seed)
    placed = points.withColumn("px", x).withColumn("py", y).withColumn("_c", deepest_cell(F.col("px"), F.col("py"), config))
    return placed.withColumns({"layer": F.col("_c.layer"), "cx": F.col("_c.x"), "cy": F.col("_c.y"), "cell_key": key(F.col("_c"))}).drop("_c")


def shard_of_key(cell_key: Column, shards: int) -> Column:
    """D1."""
    return F.pmod(F.conv(F.substring(F.md5(cell_key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shard_of_vector(v: Column, shards: int) -> Column:
    """D2."""
    return F.pmod(F.xxhash64(v), F.lit(shards)).cast("int")


def target_shards(queries: DataFrame, dimension: int, shards: int, radius: int, config: GridConfig = GridConfig(), placements: DataFrame | None = None) -> DataFrame:
    """D3: (query_id, shard_id): the shard of the query's own cell and, for radius > 0, those of the cells around it.

    ``placements`` (cell_key, shard_id) overrides the hash.
    """
    placed = with_cells(queries, dimension, config, "q")
    own = F.array(F.col("cell_key"))
    keys = own if radius == 0 else F.array_union(own, F.transform(neighbourhood(F.col("px"), F.col("py"), radius, config), key))
    cells = placed.select("query_id", F.explode(keys).alias("cell_key"))
    hashed = shard_of_key(F.col("cell_key"), shards)
    if placements is not None:
        cells = cells.join(placements.select("cell_key", F.col("shard_id").alias("placed")), "cell_key", "left")
        hashed = F.coalesce("placed", hashed)
    return cells.select("query_id", hashed.alias("shard_id")).distinct()


def sharded(points: DataFrame, dimension: int, shards: int, config: GridConfig = GridConfig()) -> DataFrame:
    """Points with their shard_id; write with ``partitionBy("shard_id")`` so that target shards prune folders."""
    placed = with_cells(points, dimension, config)
    return placed.withColumn("shard_id", shard_of_key(F.col("cell_key"), shards)).drop("px", "py", "layer", "cx", "cy")


def search_shards(points: DataFrame, queries: DataFrame, targets: DataFrame, k: int, metric_name: str = "cosine") -> DataFrame:
    """Each query against the points of its shards."""
    return knn_in_parts(points, queries, targets, k, metric_name, "shard_id")


def merge_top_k(parts: Sequence[DataFrame], k: int) -> DataFrame:
    """The k best of partial results (query_id, vec_id, distance)."""
    return top_k_per_query(reduce(DataFrame.unionByName, [p.select("query_id", "vec_id", "distance") for p in parts]), k)
