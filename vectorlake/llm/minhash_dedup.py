"""Near-duplicate documents by bottom-k sketches.

One hash function gives every shingle a value; a document's sketch is its ``k`` smallest values (all, if it has fewer).
Documents with equal shingle sets are one node from the start.  Two sets with Jaccard similarity J share each of the k smallest values
of their union with probability J, so linked sketches share at least ``t`` values except with probability ``MISS``, and
sets smaller than the sketch do so for certain.  Hence linked documents meet in one of the ``k - t + 1`` *rarest* retained
values of both: only these are put into inverted lists, which keeps values of common phrases out of them.

No list is expanded into rows of pairs.  First every member is compared with the list's smallest member; links give
components.  Lists with members that are then in different components are dealt into tiles of ``TILE`` members (large ones by set size
first, as linked sets have like sizes), and each pair of tiles is compared in memory: a pair must share enough of its union sketch.
Members that have such a partner meet once more in their tiles with their full shingle sets, for the exact similarity.  Tiles return
each linked member with the smallest member that it reaches, not pairs.  A pair that is never compared is already in one
component, so the components, which are the result, lose nothing.

Edge cases: null and empty texts have no shingles and are components of their own; a text with fewer words than a
shingle is one shingle; equal texts under several ids form a component; rows that repeat an id are one document, linked as any of
them is; a null id has component null and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components
from .shingles import WordHashes, shingle_set
from .tiles import BOTH, LEFT, PAIR, RIGHT, in_tiles, overlaps, roots, together, whole_groups

SKETCH = 64
#: List members in a tile.
TILE = 512
#: Fills short sketches; no value is as large.
PAD = np.iinfo(np.int64).max
_SIGN = np.uint64(1 << 63)
#: Chance that one linked pair of large sets shares too few values.
MISS = 1e-7
#: Steps in which the share of common values is rounded down.
STEPS = 32


def least_shared(k: int, similarity: float, miss: float = MISS) -> int:
    """The most values that two sketches of ``k`` values share, but for probability ``miss``, at this similarity."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return t
    return k


def _needed(n: int, k: int, similarity: float) -> int:
    """Values that the sketch of a set of ``n`` shares with any linked set's sketch."""
    at_least = math.ceil(similarity * n - 1e-9)  # of the whole sets
    if n > k:
        return least_shared(k, similarity, MISS / 2)
    largest = math.floor(n / similarity + 1e-9)
    return max(1, min(at_least - max(0, largest - k), n))


def may_link(similarity: float, an: Column, a_place: Column, bn: Column, b_place: Column) -> Column:
    """Whether two sets can be linked that have a value in common at these places of their sketches, rarest values first.

    A linked pair's first common value passes.  From there on they can share no more values than the shorter rest holds.  Linked
    sets have ``c >= J (an + bn) / (1 + J)`` values in common; each retained value of the larger set is one of them with
    probability ``c / larger``, and those of the sketch that ends first are all retained by the other, too.
    """
    most = F.least(F.least(an, F.lit(SKETCH)) - a_place, F.least(bn, F.lit(SKETCH)) - b_place) + 1
    larger, smaller = F.greatest(an, bn), F.least(an, bn)
    low, high = similarity, 2 * similarity / (1 + similarity)
    share = F.lit(similarity / (1 + similarity)) * (1 + smaller / larger)
    table_ = F.array(*[F.lit(least_shared(SKETCH, low + (high - low) * i / STEPS, MISS / 2)) for i in range(STEPS + 1)])
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor((share - low) / (high - low) * STEPS - 1e-6))).cast("int")
    whole = F.ceil(F.lit(similarity / (1 + similarity)) * (an + bn) - 1e-6)
    needed = F.when(larger <= SKETCH, whole).otherwise(F.get(table_, step))
    return (smaller >= F.lit(similarity - 1e-9) * larger) & (most >= needed)


def _most_needed(similarity: float) -> np.ndarray:
    """Shared values that two sketches need at least, by the steps of ``may_link``."""
    low, high = similarity, 2 * similarity / (1 + similarity)
    return np.array([least_shared(SKETCH, low + (high - low) * i / STEPS, MISS / 2) for i in range(STEPS + 1)])


def needed_shared(an: np.ndarray, bn: np.ndarray, similarity: float, by_step: np.ndarray) -> np.ndarray:
    """What ``may_link`` asks for, for arrays of set sizes."""
    larger, smaller = np.maximum(an, bn), np.minimum(an, bn)
    low, high = similarity, 2 * similarity / (1 + similarity)
    share = similarity / (1 + similarity) * (1 + smaller / larger)
    step = np.clip(np.floor((share - low) / (high - low) * STEPS - 1e-6), 0, STEPS).astype(np.int64)
    return np.where(larger <= SKETCH, np.ceil(similarity / (1 + similarity) * (an + bn) - 1e-6), by_step[step]).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = WordHashes()
    for b in batches:
        yield b, [shingle_set(known.of((t.as_py() or "").encode().lower().split()), words) for t in b.column(1)]


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """The sketches as rows of SKETCH values; ``PAD`` fills what short ones lack."""
    column = column.combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(at)
    out = np.full((len(lengths), SKETCH), PAD, np.int64)
    out[np.arange(SKETCH) < lengths[:, None]] = flat[at[0] : at[-1]]
    return out


def _common(x: np.ndarray) -> np.ndarray:
    """Where a sorted row repeats its last value."""
    return (x[:, 1:] == x[:, :-1]) & (x[:, 1:] < PAD)


class _Members:
    """Rows of some lists: list members with their sketches, rarest values first."""

    def __init__(self, t: pa.Table, similarity: float, by_step: np.ndarray):
        self.n, self.place, self.component = (t.column(c).to_numpy() for c in ("n", "place", "c"))
        self.side, self.sketch = t.column("side").to_numpy(), _padded(t.column("sketch"))
        self.similarity, self.by_step, self.estimate = similarity, by_step, least_shared(SKETCH, similarity)

    def candidates(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of the group of rows a to b, in pieces."""
        side = self.side[a:b]
        left, right = a + np.flatnonzero(side != RIGHT), a + np.flatnonzero(side != LEFT)
        step = max(1, 200_000 // max(len(right), 1))
        for k in range(0, len(left), step):
            part = left[k : k + step]
            i, j = np.repeat(part, len(right)), np.tile(right, len(part))
            yield self.possible(*((x[i < j] for x in (i, j)) if (side == BOTH).any() else (i, j)))

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        an, bn = self.n[i], self.n[j]
        fits = (self.component[i] != self.component[j]) & (np.minimum(an, bn) >= (self.similarity - 1e-9) * np.maximum(an, bn))
        i, j, an, bn = i[fits], j[fits], an[fits], bn[fits]
        most = np.minimum(np.minimum(an, SKETCH) - self.place[i], np.minimum(bn, SKETCH) - self.place[j]) + 1
        fits = most >= needed_shared(an, bn, self.similarity, self.by_step)
        return i[fits], j[fits]

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the union sketch lets two sets be similar enough, for pairs that meet in no list of rarer values."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            width = int(max(self.place[a].max(), self.place[b].max())) - 1
            at = np.arange(width)
            rarer = [np.where(at < self.place[x][:, None] - 1, self.sketch[x, :width], PAD) for x in (a, b)]
            first = ~_common(np.sort(np.hstack(rarer), axis=1)).any(axis=1) if width else np.ones(len(a), bool)
            whole = np.sort(np.hstack([self.sketch[a[first]], self.sketch[b[first]]]), axis=1)
            both = _common(whole)
            number = 2 + np.cumsum(~both, axis=1)  # of the value in the union, with what it repeats counted once
            in_union = (both & (number - 1 <= SKETCH)).sum(axis=1)
            shared, total = both.sum(axis=1), self.n[a[first]] + self.n[b[first]]
            small = np.maximum(self.n[a[first]], self.n[b[first]]) <= SKETCH
            out[k + np.flatnonzero(first)] = np.where(small, shared >= (self.similarity - 1e-9) * (total - shared), in_union >= self.estimate)
        return out


def _likely_members(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of lists' tiles, the members that have a likely partner there."""
    by_step = _most_needed(similarity)
    for t, cuts in whole_groups(batches, ["v", *PAIR]):
        members = _Members(t, similarity, by_step)
        wanted = np.zeros(t.num_rows, bool)
        held: list[tuple] = []
        waiting = 0

        def judge():
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            fits = members.likely(i, j)
            wanted[i[fits]] = wanted[j[fits]] = True
            held.clear()

        for a, b in zip(cuts[:-1], cuts[1:]):
            for pairs in members.candidates(a, b):
                held.append(pairs)
                waiting += len(pairs[0])
                if waiting > 100_000:
                    judge()
                    waiting = 0
        if held:
            judge()
        yield from t.select(["v", *PAIR, "side", "node", "c"]).filter(pa.array(wanted)).to_batches()


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of tiles of whole sets, each linked node and the smallest node that it reaches there."""
    for t, cuts in whole_groups(batches, ["v", *PAIR], 64):
        node, component, side = (t.column(c).to_numpy() for c in ("node", "c", "side"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")]
        n = np.array([len(x) for x in sets])
        a_out, b_out = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            left, right = a + np.flatnonzero(side[a:b] != RIGHT), a + np.flatnonzero(side[a:b] != LEFT)
            same = overlaps([sets[x] for x in left], [sets[x] for x in right])
            fits = (same >= (similarity - 1e-12) * (n[left][:, None] + n[right] - same)) & (component[left][:, None] != component[right])
            i, j = np.nonzero(fits)
            a_out.append(left[i])
            b_out.append(right[j])
        i, j = np.concatenate(a_out), np.concatenate(b_out)
        root = roots(node, i, j)
        has = np.unique(np.r_[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(root[has])], names=["a", "b"])


def link(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Links have Jaccard similarity >= ``similarity``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash-dedup")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def sketch(batches):
        for b, sets in _sets(batches, words):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            smallest = [(s[:SKETCH] ^ _SIGN).view(np.int64) for s in sets]  # signed, in the same order
            at = np.r_[0, np.cumsum([len(s) for s in smallest])].astype(np.int32)
            flat = np.concatenate(smallest) if smallest else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "n", "key", "sketch"])

    told = scratch.save(rows.mapInArrow(sketch, "doc_id long, n long, key binary, sketch array<long>"), "sketches")
    nodes = scratch.save(told.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    scratch.sweep()

    # Inverted lists of the rarest retained values.
    postings = nodes.select("node", F.explode("sketch").alias("v"))
    shared = scratch.save(postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("v", "w"), "shared")
    scratch.sweep()
    ranked = postings.join(shared, F.col("v") == F.col("w")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("values"))  # at most SKETCH values
    ranked = ranked.select(F.col("node").alias("rn"), F.col("values.v").alias("values"))
    # Values of no other document come first.
    profiles = nodes.join(ranked, F.col("node") == F.col("rn")).select("node", "n", F.concat(F.array_except("sketch", "values"), "values").alias("sketch"), (F.size("sketch") - F.size("values")).alias("alone"))
    profiles = scratch.save(profiles, "profiles")
    scratch.sweep()
    by_size = [_needed(n, SKETCH, similarity) for n in range(1, SKETCH + 2)]
    prefix = F.size("sketch") - F.element_at(F.array(*map(F.lit, by_size)), F.least(F.col("n"), F.lit(SKETCH + 1)).cast("int")) + 1
    cut = profiles.select("node", "n", "alone", F.slice("sketch", F.col("alone") + 1, F.greatest(prefix - F.col("alone"), F.lit(0))).alias("values"))
    lists = cut.select("node", "n", "alone", F.posexplode("values").alias("i", "v")).select("node", "n", (F.col("alone") + F.col("i") + 1).alias("place"), "v")
    lists = scratch.save(lists, "lists")
    scratch.drop("shared")

    # Each list's members against its smallest one.
    pivots = scratch.save(lists.groupBy("v").agg(F.min(F.struct("node", "n", "place")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("v").alias("pv"), "p.*").withColumnsRenamed({"node": "a", "n": "an", "place": "ap"}), "pivots")
    stars = lists.join(pivots, F.col("v") == F.col("pv")).where((F.col("a") < F.col("node")) & may_link(similarity, F.col("an"), F.col("ap"), F.col("n"), F.col("place"))).select("a", F.col("node").alias("b")).distinct()
    stars = scratch.save(stars, "stars")
    starred = _star_tiles(scratch.save(_fitting(stars, profiles, similarity), "fitting"))
    scratch.drop("stars")
    first = scratch.save(_exact(starred, rows, words, similarity, scratch, "star"), "first")
    scratch.drop("pivots", "fitting", "star-sets")
    parts = scratch.save(components(first, scratch), "parts")

    # Members that are still apart, in tiles; a large list is also cut by the sizes of the sets.
    placed = scratch.save(lists.join(parts, "node", "left").select("v", "node", "n", "place", F.coalesce("component", "node").alias("c")), "placed")
    mixed_lists = placed.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select(F.col("v").alias("mv"), "m")
    mixed_lists = scratch.save(mixed_lists, "mixed")
    by_ratio = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity)) + 1e-6).cast("long")
    apart = placed.join(mixed_lists, F.col("v") == F.col("mv")).select("v", "node", "place", "c", F.when(F.col("m") > TILE, by_ratio).otherwise(F.lit(0).cast("long")).alias("cell"))
    apart = scratch.save(apart, "apart")
    tiled = in_tiles(apart, ["v"], "node", TILE, scratch, "apart")
    asked = tiled.groupBy("node").agg(F.collect_list(F.struct("v", *PAIR, "side", "place", "c")).alias("roles")).withColumnRenamed("node", "an")
    sketched = asked.join(profiles, F.col("an") == F.col("node")).select("node", "n", "sketch", F.explode("roles").alias("r")).select("node", "n", "sketch", "r.*")
    likely = together(sketched, ["v"]).mapInArrow(lambda it: _likely_members(it, similarity), "v long, cell long, left int, next long, right int, side int, node long, c long")
    likely = scratch.save(likely, "likely")
    scratch.drop("lists", "placed", "mixed", "apart", "profiles")
    second = scratch.save(_exact(likely, rows, words, similarity, scratch, "rest"), "second")
    scratch.drop("likely", "rest-sets")

    # The second links join components of the first.
    label = lambda side: F.coalesce(f"c{side}", side)
    over = second
    for side in ("a", "b"):
        over = over.join(parts.select(F.col("node").alias(f"n{side}"), F.col("component").alias(f"c{side}")), F.col(side) == F.col(f"n{side}"), "left")
    again = Scratch(spark, "minhash-joined")
    joined = scratch.save(components(over.select(label("a").alias("a"), label("b").alias("b")), again), "joined")
    again.clear()
    classes = nodes.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    classes = classes.join(joined.withColumnsRenamed({"node": "jn", "component": "jc"}), F.col("c") == F.col("jn"), "left")
    classes = scratch.save(classes.select(F.col("key").alias("k"), F.coalesce("jc", "c").alias("component")), "classes")
    told = scratch.save(told.drop("sketch"), "told")
    scratch.clear("told", "classes")
    component = F.coalesce("component", "doc_id")
    return told.select("doc_id", "n", "key").join(classes, F.col("key") == F.col("k"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _fitting(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose union sketch lets them be linked."""
    side = lambda x: profiles.select(F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    sketched = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col("sketch_a")), F.col("sketch_b")))
    # Whole sets: exact.  Else the union's SKETCH smallest are a sample of it.
    small = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    whole = F.size(F.array_intersect("sketch_a", "sketch_b"))
    fits = F.when(small, whole >= F.lit(similarity - 1e-9) * (F.col("n_a") + F.col("n_b") - whole)).otherwise(both >= least_shared(SKETCH, similarity))
    return sketched.where(fits).select("a", "b")


def _star_tiles(pairs: DataFrame) -> DataFrame:
    """Tiles that compare each ``a`` with its partners ``b`` only."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    zero = lambda kind: F.lit(0).cast(kind)
    key = [F.col("a").alias("v"), zero("long").alias("cell"), zero("int").alias("left"), zero("long").alias("next")]
    right = pairs.join(counts, "a").select(*key, F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int").alias("right"), F.lit(RIGHT).alias("side"), F.col("b").alias("node"))
    left = counts.select(*key, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("right"), F.lit(LEFT).alias("side"), F.col("a").alias("node"))
    return left.unionByName(right).withColumn("c", F.col("node"))


def _exact(tiles: DataFrame, rows: DataFrame, words: int, similarity: float, scratch: Scratch, label: str) -> DataFrame:
    """Links (node, smallest node reached) inside the tiles, from the full sets of their members."""
    asked = tiles.select(F.col("node").alias("asked")).distinct()

    def full(batches):
        for b, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_node", "shingles"])

    sets = scratch.save(rows.join(asked, F.col("doc_id") == F.col("asked"), "left_semi").mapInArrow(full, "set_node long, shingles binary"), f"{label}-sets")
    with_sets = tiles.join(sets, F.col("node") == F.col("set_node")).drop("set_node")
    return together(with_sets, ["v"]).mapInArrow(lambda it: _linked(it, similarity), "a long, b long")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group of near duplicates: the one with the smallest id."""
    scratch = Scratch(docs.sparkSession, "minhash-dedup")
    kept = link(docs, words, similarity, id_col, text_col, scratch).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    kept = scratch.save(kept, "kept")
    scratch.clear("kept")
    good = docs.join(kept, docs[id_col].cast("long") == F.col("__id"), "left_semi")
    return good.unionByName(docs.where(docs[id_col].cast("long").isNull()))


def op5_bottom_k_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), words=3, similarity=0.85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * m >= 85 * (na.n + nb.n - m)
), reach AS (
  SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT reach.s, links.b FROM reach JOIN links ON reach.t = links.a
), c AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.s = w.doc_id LEFT JOIN n USING (doc_id)
"""
