"""Grid-cell index: columns of vectors, coarse-to-fine search with budgets, compaction.

The row table has vec_id, embedding and the cell (layer, cx, cy, cell_key); the column table one row for each filled cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import Scratch
from ..types import GridConfig
from . import grid
from .exact import knn_in_parts, knn_join, top_k_per_query
from .ivf import rerank

CELL = ["layer", "cx", "cy", "cell_key"]


def columns(rows: DataFrame) -> DataFrame:
    """Height and mean vector of each filled cell, by vector sums that are combined before the shuffle."""
    vector = array_to_vector(V.doubles(F.col("embedding")))
    means = rows.groupBy(*CELL).agg(Summarizer.mean(vector).alias("mean"), F.count(F.lit(1)).alias("height"))
    return means.select(*CELL, vector_to_array("mean").alias("centroid"), "height")


def height_balance(rows: DataFrame) -> DataFrame:
    """Filled cells, mean and largest height and their ratio."""
    heights = rows.groupBy("cell_key").agg(F.count(F.lit(1)).alias("h"))
    return heights.agg(F.count(F.lit(1)).alias("cells"), F.avg("h").alias("mean_height"), F.max("h").alias("max_height")).withColumn("ratio", F.try_divide(F.col("max_height").cast("double"), F.col("mean_height")))


@dataclass(frozen=True)
class Predictor:
    """Entry-layer predictor; state goes in and comes out explicitly."""

    weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)
    bias: float = 0.0
    threshold: float = 0.5
    hit_ema: tuple[float, ...] = ()

    RATE, ALPHA = 0.05, 0.1

    def features(self, layer: int, layers: int, specificity: float, nearest: float) -> tuple[float, float, float, float]:
        depth = layer / max(layers - 1, 1)
        ema = self.hit_ema[layer] if layer < len(self.hit_ema) else 0.0
        return specificity, 1 / (1 + nearest), depth, ema

    def confidence(self, features: Sequence[float]) -> float:
        return 1 / (1 + math.exp(-(sum(w * f for w, f in zip(self.weights, features, strict=True)) + self.bias)))

    def updated(self, features: Sequence[float], layer: int, target: int) -> Predictor:
        """One step of gradient descent towards ``layer == target`` and the layer's moving hit average."""
        error = (1.0 if layer == target else 0.0) - self.confidence(features)
        weights = tuple(w + self.RATE * error * f for w, f in zip(self.weights, features, strict=True))
        ema = list(self.hit_ema) + [0.0] * (max(layer, target) + 1 - len(self.hit_ema))
        ema = [(1 - self.ALPHA) * e + self.ALPHA * (i == target) for i, e in enumerate(ema)]
        return replace(self, weights=weights, bias=self.bias + self.RATE * error, hit_ema=tuple(ema))


def entry_layers(queries: DataFrame, cols: DataFrame, predictor: Predictor, config: GridConfig = GridConfig(), metric_name: str = "cosine") -> DataFrame:
    """(query_id, layer, confidence): the most confident layer at or above the threshold, else layer 0."""
    near = queries.select("query_id", "q").join(cols.select("layer", "centroid"), F.lit(True))
    per = near.groupBy("query_id", "layer").agg(F.min(V.distance(metric_name, F.col("centroid"), F.col("q"))).alias("d"), F.first("q").alias("q"))
    spread = F.aggregate(V.doubles(F.col("q")), F.lit(0.0), lambda a, x: a + F.abs(x))
    specificity = F.try_divide(V.norm(F.col("q")), spread)
    ema = F.coalesce(*[F.when(F.col("layer") == i, F.lit(float(e))) for i, e in enumerate(predictor.hit_ema)], F.lit(0.0))
    w = predictor.weights
    z = w[0] * F.coalesce(specificity, F.lit(0.0)) + w[1] / (1 + F.col("d")) + w[2] * F.col("layer") / max(config.max_layers - 1, 1) + w[3] * ema + predictor.bias
    scored = per.select("query_id", "layer", (1 / (1 + F.exp(-z))).alias("confidence"))
    best = scored.groupBy("query_id").agg(F.max(F.struct("confidence", -F.col("layer"))).alias("b"))
    sure = F.col("b.confidence") >= predictor.threshold
    return best.select("query_id", F.when(sure, -F.col("b.col2")).otherwise(0).cast("int").alias("layer"), F.col("b.confidence").alias("confidence"))


def centroid_graph(cols: DataFrame, degree: int = 8, metric_name: str = "cosine") -> DataFrame:
    """(src, dst, dist): each filled cell's nearest filled cells."""
    w = Window.orderBy("cell_key")  # the column table has at most as many rows as the grid has cells
    numbered = cols.select("cell_key", "centroid", F.row_number().over(w).cast("long").alias("n"))
    near = knn_join(numbered.select(F.col("n").alias("vec_id"), F.col("centroid").alias("embedding")), numbered.select(F.col("n").alias("query_id"), F.col("centroid").alias("q")), degree, metric_name, not_self=True)
    src = numbered.select(F.col("n").alias("query_id"), F.col("cell_key").alias("src"))
    dst = numbered.select(F.col("n").alias("vec_id"), F.col("cell_key").alias("dst"))
    return near.join(src, "query_id").join(dst, "vec_id").select("src", "dst", F.col("distance").alias("dist"))


def ranked_columns(cols: DataFrame, queries: DataFrame, metric_name: str = "cosine") -> DataFrame:
    """(query_id, cell_key, distance, rank) of all filled cells by centroid distance (a stated query set against the grid's few cells)."""
    pairs = queries.select("query_id", "q").join(cols.select("cell_key", "centroid"), F.lit(True))
    d = pairs.select("query_id", "cell_key", V.distance(metric_name, F.col("centroid"), F.col("q")).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "cell_key")))


def seeds(cols: DataFrame, queries: DataFrame, count: int, metric_name: str = "cosine") -> DataFrame:
    """The ``count`` nearest columns of each query."""
    return ranked_columns(cols, queries, metric_name).where(F.col("rank") <= count)


def graph_visit(start: DataFrame, graph: DataFrame, hops: int) -> DataFrame:
    """(query_id, cell_key, hop) of the cells within ``hops`` (1 at least) of the seeds, each with its smallest hop."""
    seen = start.select("query_id", "cell_key", F.lit(0).alias("hop"))
    for hop in range(1, max(hops, 1) + 1):
        ahead = seen.where(F.col("hop") == hop - 1).join(graph.select(F.col("src").alias("cell_key"), "dst"), "cell_key").select("query_id", F.col("dst").alias("cell_key"), F.lit(hop).alias("hop"))
        seen = seen.union(ahead).groupBy("query_id", "cell_key").agg(F.min("hop").alias("hop"))
    return seen


def layer_visit(entry: DataFrame, cols: DataFrame, queries: DataFrame, width: int, config: GridConfig = GridConfig(), metric_name: str = "cosine") -> DataFrame:
    """From each query's entry layer (query_id, layer) inwards: the ``width`` nearest columns of a layer lead to their children;
    where none is filled, the nearest columns of the layer outside are taken instead.  (query_id, cell_key, hop, reverted)."""
    ranked = ranked_columns(cols, queries, metric_name).join(cols.select("cell_key", "layer", "cx", "cy"), "cell_key")
    w = Window.partitionBy("query_id").orderBy("distance", "cell_key")
    beam = ranked.join(entry.select("query_id", F.col("layer").alias("at")), "query_id").where(F.col("layer") == F.col("at")).drop("at")
    beam = beam.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width)
    out = beam.select("query_id", "cell_key", F.lit(0).alias("hop"), F.lit(False).alias("reverted"))
    for hop in range(1, config.max_layers):
        cell = F.struct("layer", F.col("cx").alias("x"), F.col("cy").alias("y"))
        children = beam.select("query_id", grid.key(grid.child_cell(cell, config)).alias("cell_key")).where(F.col("cell_key") != "").distinct()
        inner = ranked.join(children, ["query_id", "cell_key"]).withColumn("reverted", F.lit(False))
        lost = beam.select("query_id").distinct().join(inner.select("query_id").distinct(), "query_id", "left_anti")
        outside = beam.select("query_id", (F.col("layer") - 1).alias("layer")).distinct()
        back = ranked.join(lost, "query_id", "left_semi").join(outside, ["query_id", "layer"]).join(out.select("query_id", "cell_key"), ["query_id", "cell_key"], "left_anti").withColumn("reverted", F.lit(True))
        beam = inner.unionByName(back.select(*inner.columns)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width)
        out = out.union(beam.select("query_id", "cell_key", F.lit(hop), "reverted"))
    return out


def coarse(rows: DataFrame, visits: DataFrame, queries: DataFrame, keep: int, config: GridConfig = GridConfig(), metric_name: str = "cosine") -> DataFrame:
    """Rows of the visited cells by coded distance, the ``keep`` nearest of each cell (0: all): query_id, vec_id, cell_key, visit, coarse.

    ``visits`` has query_id, cell_key and visit, the order in which cells are scanned.
    """
    by_tier = lambda tier: V.decode(V.encode(F.col("embedding"), tier), tier)
    tier = V.tier_of_layer(F.col("layer"), config.max_layers)
    coded = rows.select("vec_id", "cell_key", F.when(tier == "u8", by_tier("u8")).when(tier == "u16", by_tier("u16")).otherwise(by_tier("f32")).alias("embedding"))
    visits = visits.select("query_id", "cell_key", "visit")
    if keep == 0:
        d = V.distance(metric_name, F.col("q"), F.col("embedding"))
        return coded.join(visits, "cell_key").join(queries.select("query_id", "q"), "query_id").select("query_id", "vec_id", "cell_key", "visit", d.alias("coarse"))
    near = knn_in_parts(coded, queries, visits, keep, metric_name, "cell_key", each=True)
    near = near.select("query_id", "vec_id", F.col("part").alias("cell_key"), F.col("distance").alias("coarse"))
    return near.join(visits, ["query_id", "cell_key"]).select("query_id", "vec_id", "cell_key", "visit", "coarse")


def budget(total: int, k: int, config: GridConfig = GridConfig()) -> int:
    """Rows that a query may touch."""
    own = config.touch_budget if config.touch_budget is not None else math.ceil(config.touch_budget_frac * total)
    return max(own, k)


def within_budget(pool: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each query in scan order (visit, coarse distance, id)."""
    w = Window.partitionBy("query_id").orderBy("visit", "coarse", "vec_id")
    return pool.withColumn("touched", F.row_number().over(w)).where(F.col("touched") <= limit)


def needs_fallback(pool: DataFrame, queries: DataFrame, k: int, gap: float = 2.0) -> DataFrame:
    """Queries with fewer than k rows, or whose k-th best is more than ``gap`` times the best (if that is above 0)."""
    best = top_k_per_query(pool.select("query_id", "vec_id", "coarse"), k, "coarse")
    state = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("coarse").alias("low"), F.max("coarse").alias("high"))
    all_ = queries.select("query_id").join(state, "query_id", "left")
    return all_.where((F.coalesce("n", F.lit(0)) < k) | ((F.col("low") > 0) & (F.col("high") > gap * F.col("low")))).select("query_id")


def ring_cells(queries: DataFrame, dimension: int, first: int, last: int, config: GridConfig = GridConfig()) -> DataFrame:
    """(query_id, cell_key, ring): cells of the boxes around the query, each with the first ring that reaches it."""
    placed = grid.with_cells(queries, dimension, config, "q").select("query_id", "px", "py")
    if last < first:
        return placed.select("query_id", F.lit("").alias("cell_key"), F.lit(0).alias("ring")).where(F.lit(False))
    cell = placed.select("query_id", F.explode(grid.neighbourhood(F.col("px"), F.col("py"), last, config)).alias("c"))
    return cell.select("query_id", grid.key(F.col("c")).alias("cell_key"), F.greatest(F.col("c.ring"), F.lit(first)).alias("ring"))


def pool_size(total: int, k: int, config: GridConfig = GridConfig()) -> int:
    """Rows that are ranked again with full precision."""
    base = k * config.hybrid_rerank_pool
    return max(max(base, min(total // 20, 512)), min(config.ef_search, 512))


def search(rows: DataFrame, queries: DataFrame, k: int, dimension: int, config: GridConfig = GridConfig(), metric_name: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """Grid search of a query batch: results (query_id, vec_id, distance, rank) and explanation (Z23), one row per query.

    Seeds are the nearest columns, the centroid graph widens them, coded distances prune inside a column, the budget cuts in scan
    order; queries that end badly go on with rings around their own cell and further columns; the pool is ranked by exact distances (Z21).
    """
    scratch = Scratch(rows.sparkSession, "grid-search")
    cols = scratch.save(columns(rows), "columns")  # at most one row for each cell of the grid
    total = rows.count()
    limit = budget(total, k, config)
    width = max(1, config.beam_radius * 2)
    rank = scratch.save(ranked_columns(cols, queries, metric_name).select("query_id", "cell_key", F.col("rank").alias("near")), "ranked")
    start = rank.where(F.col("near") <= width)
    if config.use_centroid_graph:
        near_cells = scratch.save(centroid_graph(cols, config.graph_degree, metric_name), "graph")
        found = graph_visit(start, near_cells, config.graph_beam_hops)
    else:
        found = start.select("query_id", "cell_key", F.lit(0).alias("hop"))
    order = Window.partitionBy("query_id").orderBy("hop", "near", "cell_key")
    visits = scratch.save(found.join(rank, ["query_id", "cell_key"]).withColumn("visit", F.row_number().over(order)), "visits")
    pool = scratch.save(within_budget(coarse(rows, visits, queries, config.coarse_keep_per_column, config, metric_name), limit), "pool")
    asked = needs_fallback(pool, queries, k, config.fallback_score_gap) if config.conditional_fallback else queries.select("query_id")
    asked = scratch.save(asked, "fallback")
    far = visits.groupBy("query_id").agg(F.max("visit").alias("last"))
    again = queries.join(asked, "query_id", "left_semi")
    rings = ring_cells(again, dimension, config.beam_radius, config.fallback_max_rings, config).select("query_id", "cell_key", F.col("ring").alias("hop"))
    rings = rings.join(cols.select("cell_key"), "cell_key", "left_semi")
    more = rank.join(asked, "query_id", "left_semi").where(F.col("near") <= config.fallback_max_columns).select("query_id", "cell_key", F.lit(1000).alias("hop"))
    extra = rings.unionByName(more).groupBy("query_id", "cell_key").agg(F.min("hop").alias("hop")).join(visits.select("query_id", "cell_key"), ["query_id", "cell_key"], "left_anti")
    extra = extra.join(rank, ["query_id", "cell_key"]).withColumn("v", F.row_number().over(order)).join(far, "query_id", "left").withColumn("visit", (F.coalesce("last", F.lit(0)) + F.col("v")).cast("int"))
    extra_pool = coarse(rows, extra, queries, config.coarse_keep_per_column, config, metric_name)
    whole = scratch.save(within_budget(pool.drop("touched").unionByName(extra_pool.select("query_id", "vec_id", "cell_key", "visit", "coarse")), limit), "whole")
    chosen = top_k_per_query(whole, pool_size(total, k, config), "coarse")
    results = rerank(chosen, rows, queries, k, metric_name)
    fell = asked.withColumn("fallback", F.lit(True))
    layer_of = cols.select("cell_key", "layer")
    explain = whole.join(layer_of, "cell_key").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidate_pool"), F.countDistinct("cell_key").alias("columns"), F.max("layer").alias("deepest_layer"), F.sort_array(F.collect_set("cell_key")).alias("cells")
    )
    explain = explain.join(fell, "query_id", "left").withColumns({"fallback": F.coalesce("fallback", F.lit(False)), "touch_budget": F.lit(limit), "touch_fraction": F.col("candidate_pool") / F.lit(float(max(total, 1))), "strategy": F.lit("centroid_graph" if config.use_centroid_graph else "nearest_columns")})
    return results, explain


def stats(rows: DataFrame) -> DataFrame:
    """Rows, cells and layers in use and the height balance."""
    return height_balance(rows).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("layer").alias("layers"))), F.lit(True))


def ledger(access: DataFrame, now_ms: int, half_life_ms: int = 3_600_000, alpha: float = 0.1) -> DataFrame:
    """Per cell hit_count, last_access and the decayed moving average of hits, from an access log (cell_key, ts_ms).

    Each hit first decays the weight by the time since the last one, then moves it towards 1.  In closed form the weight is
    ``sum over hits of alpha (1 - alpha)^later * 0.5^(age / half life)``.  Later hits are counted within spans of a half life, plus
    those of the later spans, so that a hot cell's hits are not numbered in one task.
    """
    spans = access.withColumn("span", F.floor(F.col("ts_ms") / half_life_ms))
    counts = spans.groupBy("cell_key", "span").agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("cell_key").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("cell_key", "span", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("in_later_spans"))
    w = Window.partitionBy("cell_key", "span").orderBy(F.col("ts_ms").desc(), F.col("event_id").desc() if "event_id" in access.columns else F.lit(0))
    later = spans.withColumn("inside", F.row_number().over(w) - 1).join(before, ["cell_key", "span"]).withColumn("later", F.col("inside") + F.col("in_later_spans"))
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("later")) * F.pow(F.lit(0.5), (F.lit(now_ms) - F.col("ts_ms")) / F.lit(float(half_life_ms)))
    return later.groupBy("cell_key").agg(F.count(F.lit(1)).alias("hit_count"), F.max("ts_ms").alias("last_access"), F.sum(weight).alias("ema_weight"))


def moved(rows: DataFrame, weights: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """Promotes the last id of hot columns outwards and demotes the first id of cold ones inwards; empty cells vanish.

    ``weights`` has cell_key and ema_weight.  Targets are the cells that hold the column's centre in the other layer.
    """
    ends = rows.groupBy("cell_key").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))
    marked = rows.join(ends.join(weights.select("cell_key", "ema_weight"), "cell_key", "left"), "cell_key")
    cell = F.struct("layer", F.col("cx").alias("x"), F.col("cy").alias("y"))
    hot = (F.col("ema_weight") >= config.hot_threshold) & (F.col("vec_id") == F.col("last"))
    cold = (F.col("ema_weight") < config.cold_threshold) & (F.col("vec_id") == F.col("first"))
    target = F.when(hot, grid.parent_cell(cell, config)).when(cold, grid.child_cell(cell, config))
    return _placed(marked.withColumn("t", F.coalesce(target, cell)).drop("ema_weight", "first", "last"), rows.columns)


def split_tall(rows: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """The second half of columns higher than max(8, ceil(mean * ratio)) moves to the child cell, where there is one."""
    heights = rows.groupBy("cell_key").agg(F.count(F.lit(1)).alias("h"))
    mean = heights.agg(F.avg("h").alias("mean"))
    tall = heights.join(F.broadcast(mean), F.lit(True)).where(F.col("h") > F.greatest(F.lit(8), F.ceil(F.col("mean") * config.max_column_height_ratio))).select("cell_key", "h")
    order = Window.partitionBy("cell_key").orderBy("vec_id")
    marked = rows.join(tall, "cell_key").withColumn("r", F.row_number().over(order))  # tall columns only
    cell = F.struct("layer", F.col("cx").alias("x"), F.col("cy").alias("y"))
    target = F.when(F.col("r") > F.floor(F.col("h") / 2), grid.child_cell(cell, config))
    split = _placed(marked.withColumn("t", F.coalesce(target, cell)).drop("h", "r"), rows.columns)
    return rows.join(tall.select("cell_key"), "cell_key", "left_anti").select(*rows.columns).unionByName(split)


def _placed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    out = df.withColumns({"layer": F.col("t.layer"), "cx": F.col("t.x"), "cy": F.col("t.y"), "cell_key": grid.key(F.col("t"))})
    return out.select(*names)


def hits_of(results: DataFrame, rows: DataFrame, ts_ms: Column) -> DataFrame:
    """Access log of a query's results."""
    return results.join(rows.select("vec_id", "cell_key"), "vec_id").select("cell_key", ts_ms.alias("ts_ms"))
