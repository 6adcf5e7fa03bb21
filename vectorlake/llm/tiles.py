"""Comparing all members of a group in tiles, so that no task holds a group and no pair is a row.

A group's rows are dealt into tiles of about equal size and every pair of tiles is compared by one task in memory.  Where
rows have a cell number and only rows of the same or of neighbouring cells can match, only those tiles meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: What tells one pair of tiles from another, beside the group's own columns.
PAIR = ["cell", "left", "next", "right"]
#: Sides of a row: of the left tile, of the right one, or of a tile that is compared with itself.
LEFT, RIGHT, BOTH = 0, 1, 2


def in_tiles(rows: DataFrame, group: list[str], node: str, size: int, scratch: Scratch, label: str) -> DataFrame:
    """``rows`` (with a column ``cell``) once for each pair of tiles that they belong to, with the columns of ``PAIR`` and ``side``."""
    keys = [*group, "cell"]
    tiles = scratch.save(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("tiles")), f"{label}-tiles")
    after = tiles.select(*group, (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("tiles_after"))
    before = tiles.select(*group, (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("tiles_before"))
    around = scratch.save(tiles.join(after, keys, "left").join(before, keys, "left").fillna(0), f"{label}-around")
    dealt = rows.join(around, keys).withColumn("tile", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))
    upto = lambda n: F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n)
    here, tile = F.col("cell"), F.col("tile")

    def role(side, cell, left, following, right):
        return F.struct(F.lit(side).alias("side"), cell.alias("cell"), left.alias("left"), following.alias("next"), right.alias("right"))

    own = lambda t: F.when(t == tile, role(BOTH, here, tile, here, tile)).when(t > tile, role(LEFT, here, tile, here, t)).otherwise(role(RIGHT, here, t, here, tile))
    roles = F.concat(
        F.transform(upto(F.col("tiles")), own),
        F.transform(upto(F.col("tiles_after")), lambda t: role(LEFT, here, tile, here + 1, t)),
        F.transform(upto(F.col("tiles_before")), lambda t: role(RIGHT, here - 1, t, here, tile)),
    )
    kept = [c for c in rows.columns if c != "cell"]
    return dealt.select(*kept, F.explode(roles).alias("p")).select(*kept, "p.*")


def together(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows of each pair of tiles in one partition, one after the other."""
    keys = [*group, *PAIR]
    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``least`` sorted rows that hold whole groups, with the groups' bounds in them."""
    held: list[pa.RecordBatch] = []
    n = 0

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        return np.r_[0, np.flatnonzero(change) + 1, t.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        cuts = bounds(t)
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
        held = t.slice(cuts[-2]).combine_chunks().to_batches()
        n = sum(x.num_rows for x in held)
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, from products of membership matrices."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    if out.size <= 16:
        for i, x in enumerate(left):
            out[i] = [len(np.intersect1d(x, y, assume_unique=True)) for y in right]
        return out
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    shared = (df > 1)[at]
    at, owner = number[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        part = slice(*np.searchsorted(at, [a, a + columns]))
        member = np.zeros((len(sets), columns), np.float32)
        member[owner[part], at[part] - a] = 1
        out += np.rint(member[: len(left)] @ member[len(left) :].T).astype(np.int64)
    return out


def roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each row by links between rows ``a`` and ``b``; rows with equal nodes are one."""
    root = nodes.copy()
    _, same = np.unique(nodes, return_inverse=True)
    while len(a):
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, root)
        root = least[same]
        if (root == old).all():
            break
    return root
