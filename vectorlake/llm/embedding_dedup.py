"""Embedding near-duplicates: PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated into the principal axes of all vectors of their dimension, the axis with the
largest second moment first.  A pair with cosine >= t is at most ``r = sqrt(2 - 2t)`` apart, hence also on the first axis; cells of
width ``r`` there are compared only with themselves and the next one.  A cell is dealt into tiles of about ``TILE`` vectors, so no task holds a
cell, and each pair of tiles is one group.

Only the ``LEAD`` leading components go to the groups.  Their products are accumulated first; the product of the norms of
what is left, which the leading components of a unit vector give, bounds the rest, and a pair is dropped as soon as even that cannot reach t.
Vectors with a pair left meet again, whole, in the same groups, go on with the other components in the same way, and the cosine of
each pair that remains is taken in double precision.  Rows shuffled still grow with the square of a label's vectors in a cell over ``TILE``; the
README has figures.

Equal vectors of a label are compared once and counted by their number.  Groups return link counts and each linked vector's smallest
partner inside the group, not pairs; these links go into connected components.

Edge cases: vectors that are null, empty, zero or have null or non-finite components, and rows with a null label, link with
nothing and are their own component; vectors of different dimension never link; repeated rows (same id) are separate
vectors of one id; a null id forms component null and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components
from .tiles import BOTH, LEFT, PAIR, RIGHT, in_tiles, roots, together, whole_groups

THRESHOLD = 0.98
TILE = 2048
#: Components that are compared first, in single precision; ``BLUR`` is more than what that takes from a bound.
LEAD, BLUR = 16, 1e-5
#: Axes accumulated before each test against the bound.
STEPS = (4, 8, 16, 32)
#: Cosines this close to the threshold are taken again from the unrotated vectors.
NEAR = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the rotation into principal axes (columns), from the second moments of all vectors.

    Tasks add up their own moments; d x d sums for each dimension reach the driver, however many vectors there are.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims):
                x = _unit(_matrix(b.column(1).filter(pa.array(dims == d))))
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, m in sums.items():
            at = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(at.astype(np.int64)), pa.array(m.ravel())], names=["dim", "at", "v"])

    rows = vectors.select("dim", "vector").mapInArrow(moments, "dim int, at long, v double").groupBy("dim", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in rows.collect():
        found.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["at"]] = r["v"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in found.items()}


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs with cosine >= threshold; with ``same`` (x is y), i < j."""
    ux, uy = _unit(x), _unit(y)
    px, py = ux @ axes, uy @ axes
    d = axes.shape[0]
    cuts = [c for c in STEPS if c < d] + [d]
    rest = lambda p, c: np.sqrt(np.maximum(np.einsum("ij,ij->i", p[:, c:], p[:, c:]), 0))
    low = threshold - NEAR
    products = px[:, : cuts[0]] @ py[:, : cuts[0]].T
    alive = products + np.outer(rest(px, cuts[0]), rest(py, cuts[0])) >= low
    if same:
        alive &= np.tri(len(x), dtype=bool).T & ~np.eye(len(x), dtype=bool)
    at = 0
    while at + 1 < len(cuts) and alive.mean() > 0.05:  # still dense: go on with whole tiles
        products += px[:, cuts[at] : cuts[at + 1]] @ py[:, cuts[at] : cuts[at + 1]].T
        at += 1
        alive &= products + np.outer(rest(px, cuts[at]), rest(py, cuts[at])) >= low
    i, j = np.nonzero(alive)
    have = products[i, j]
    for a, b in zip(cuts[at:], cuts[at + 1 :]):
        have = have + np.einsum("ij,ij->i", px[i, a:b], py[j, a:b])
        fits = have + rest(px, b)[i] * rest(py, b)[j] >= low
        i, j, have = i[fits], j[fits], have[fits]
    close = np.abs(have - threshold) <= NEAR
    if close.any():
        a, b = x[i[close]], y[j[close]]
        dots = np.array([math.fsum(r) for r in a * b])
        norms = np.sqrt([math.fsum(r) for r in a * a]) * np.sqrt([math.fsum(r) for r in b * b])
        have[close] = dots / norms
    fits = have >= threshold
    return i[fits], j[fits]


def may_reach(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows can have cosine >= threshold, given the leading principal components of unit vectors."""
    products, alive = np.zeros((len(x), len(y))), np.ones((len(x), len(y)), bool)
    at = 0
    rest = lambda p, c: np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", p[:, :c], p[:, :c]), 0))
    for cut in [c for c in STEPS if c < x.shape[1]] + [x.shape[1]]:
        products += x[:, at:cut] @ y[:, at:cut].T
        alive &= products + np.outer(rest(x, cut), rest(y, cut)) >= threshold - BLUR
        at = cut
        if not alive.any():
            break
    return alive


def link(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"), vectors[label_col].alias("label"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # One node for each different vector of a label.
    nodes = scratch.save(good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vector")).withColumn("key", F.monotonically_increasing_id()), "nodes")
    axes = principal_axes(nodes)
    radius = math.sqrt(2 - 2 * threshold)

    def place(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell, lead = np.zeros(len(dims), np.int64), np.empty(len(dims), object)
            for d in np.unique(dims):
                has = np.flatnonzero(dims == d)
                turned = _unit(_matrix(b.column("vector").take(pa.array(has)))) @ axes[int(d)]
                cell[has] = np.floor(turned[:, 0] / radius + 1e-9).astype(np.int64)
                for i, row in zip(has, turned[:, :LEAD].astype(np.float32), strict=True):
                    lead[i] = row
            yield b.drop_columns(["vector"]).append_column("lead", pa.array(list(lead), pa.list_(pa.float32()))).append_column("cell", pa.array(cell))

    group = ["label", "dim"]
    keyed = nodes.select("label", "dim", "key", "vector")
    placed = scratch.save(keyed.mapInArrow(place, _schema(keyed.drop("vector")) + ", lead array<float>, cell long"), "placed")
    tiled = together(in_tiles(placed, group, "key", TILE, scratch, "near"), group)
    kept = [*group, *PAIR, "side", "key"]

    def sides(t: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray, bool]:
        side = t.column("side").to_numpy()[a:b]
        return a + np.flatnonzero(side != RIGHT), a + np.flatnonzero(side != LEFT), bool((side == BOTH).any())

    def first(batches):
        for t, cuts in whole_groups(batches, [*group, *PAIR]):
            wanted = np.zeros(t.num_rows, bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                left, right, same = sides(t, a, b)
                if not len(left) or not len(right):
                    continue
                x = _matrix(t.column("lead").slice(a, b - a))
                alive = may_reach(x[left - a], x[right - a], threshold)
                if same:
                    np.fill_diagonal(alive, False)
                wanted[left[alive.any(axis=1)]] = True
                wanted[right[alive.any(axis=0)]] = True
            yield from t.select(kept).filter(pa.array(wanted)).to_batches()

    likely = scratch.save(tiled.select(*kept, "lead").mapInArrow(first, _schema(tiled.select(*kept))), "likely")

    def second(batches):
        for t, cuts in whole_groups(batches, [*group, *PAIR]):
            node, copies, out = t.column("node").to_numpy(), t.column("copies").to_numpy(), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                left, right, same = sides(t, a, b)
                if not len(left) or not len(right):
                    continue
                x = _matrix(t.column("vector").slice(a, b - a))
                i, j = linked_pairs(x[left - a], x[right - a], axes[x.shape[1]], threshold, same)
                i, j = left[i] - a, right[j] - a
                here, many = node[a:b], copies[a:b]
                links = np.bincount(i, weights=many[j], minlength=b - a) + np.bincount(j, weights=many[i], minlength=b - a)
                root, has = roots(here, i, j), links > 0
                out.append((here[has], links[has].astype(np.int64), root[has]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "links", "root"])

    whole = likely.join(nodes.select(F.col("key").alias("k"), "vector", "node", "copies"), F.col("key") == F.col("k")).select(*group, *PAIR, "side", "vector", "node", "copies")
    found = scratch.save(together(whole, group).mapInArrow(second, "node long, links long, root long"), "found")
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = scratch.save(
        nodes.select("label", "vector", "node", "copies").join(counted, "node", "left").join(parts, "node", "left").select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "known",
    )
    scratch.clear("known")
    checked = rows.withColumn("l", F.when(usable(F.col("vector")) & F.col("vec_id").isNotNull(), F.col("label")))
    joined = checked.join(known.withColumnRenamed("l", "kl"), (F.col("l") == F.col("kl")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def op9_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
    AND list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0
), reach AS (
  SELECT vec_id AS s, vec_id AS n FROM v UNION SELECT reach.s, links.b FROM reach JOIN links ON reach.n = links.a
), c AS (SELECT s, min(n) AS component_id FROM reach GROUP BY s)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.vec_id) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.s = v.vec_id
"""
