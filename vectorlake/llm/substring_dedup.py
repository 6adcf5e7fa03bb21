"""Substring deduplication with a compressed FM-index per shard.

A window is ``window`` consecutive words.  Equal windows hold the same smallest ``GRAM``-word hash, their anchor, so each
text falls into runs of windows with one anchor, and runs with the same anchor belong to one shard.  Anchors that occur once in the
corpus are dropped; of the rest, equal runs are counted and sent once.  A shard's distinct runs are indexed, and
those that occur once are streamed against the index from their last word back; their windows that match at least
twice, and all windows of runs that occur more than once, are repeated.  Each word that a repeated window covers is removed.

An anchor with more than ``GROUP`` distinct runs would make a large group: its runs are cut anew by their windows'
``FINER`` smallest hashes, and those still in large groups into single windows.  Both keys, too, are equal for equal windows, so nothing is lost.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; a repeated row repeats all its
windows; overlapping repeats inside one text count; null ids are kept apart by their texts only; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, table
from .fm_index import FmIndex
from .shingles import WordHashes, grams, mixed

GRAM = 8
GROUP = 400
FINER = 4
#: Words of one index, about.
SHARD_WORDS = 300_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    k, out = 1, x
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(out) - (n - k)], out[n - k :]) if n > k else out


def window_keys(hashes: np.ndarray, window: int, level: int) -> np.ndarray:
    """A key of each window, equal for equal windows: 0 its smallest gram, 1 its few smallest grams, 2 all its words."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    if level == 2:
        return grams(hashes, window)
    gram = min(GRAM, window)
    g = grams(hashes, gram)
    span = window - gram + 1
    if level == 0:
        return _slide_min(g, span)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    low = key = view.min(axis=1)
    for _ in range(FINER - 1):
        low = np.where(view > low[:, None], view, _MAX).min(axis=1)
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
    return key


def longest_run(window: int) -> int:
    """The windows that can share one place of a gram; longer runs (periodic texts) are cut.  Any shorter bound would cut ordinary runs into pieces with one key, which then looks repeated."""
    return window - min(GRAM, window) + 1


def runs(keys: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs of equal keys."""
    n = len(keys)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[change, n])
    if length.max() <= longest:
        return change, length
    pieces = -(-length // longest)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(change, pieces) + inside * longest
    return start, np.minimum(longest, np.repeat(change + length, pieces) - start)


def _weights(words: list[bytes], hashes: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """1 for each run, 2 for one that may repeat its own windows: at a distance below the longest run, hence with few different words."""
    out = np.ones(len(start), np.int32)
    if len(start):
        g = grams(hashes, min(GRAM, window))
        if len(np.unique(g)) < len(g):
            for i, (s, c) in enumerate(zip(start.tolist(), count.tolist())):
                if c > 1 and len(set(words[s : s + c + window - 1])) <= longest_run(window):
                    out[i] = 2
    return out


def _fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _digest(run: bytes) -> bytes:
    return hashlib.blake2b(run, digest_size=16).digest()


def _index_shard(texts: list[bytes], counts: list[int], window: int) -> dict[int, np.ndarray]:
    """Repeated windows' starts for each run (by number) of a shard."""
    ids: dict[bytes, int] = {}
    words = [t.split(b" ") for t in texts]
    for w in words:
        for x in w:
            if x not in ids:
                ids[x] = len(ids) + 1
    lengths = np.array([len(w) for w in words])
    text = np.zeros(int(lengths.sum()) + len(words), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    mask = np.ones(len(text), bool)
    mask[ends] = False
    text[mask] = np.fromiter((ids[x] for w in words for x in w), np.int64, int(lengths.sum()))
    index = FmIndex(text, len(ids) + 1)
    once = np.flatnonzero(np.array(counts) == 1)
    who, where = index.repeated(ends[once], lengths[once], text, window)
    order = np.argsort(who, kind="stable")
    who, where = once[who[order]], where[order]
    cuts = np.flatnonzero(np.diff(who, prepend=-1))
    return {int(who[a]): np.sort(part) for a, part in zip(cuts, np.split(where, cuts[1:]))} if len(cuts) else {}


def _ranges(starts: np.ndarray, window: int) -> list[int]:
    """Covered words of windows that start at sorted ``starts``: from, to, from, to, ..."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.column_stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + window]).ravel().tolist()


def _match(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, run, n) sorted by key -> (digest, covered word ranges) of runs with repeated windows."""
    out_d: list[bytes] = []
    out_r: list[list[int]] = []

    def solve(group):
        """One shard: whole groups."""
        starts = _index_shard([g[1] for g in group], [g[2] for g in group], window)
        for i, s in starts.items():
            out_d.append(group[i][0])
            out_r.append(_ranges(s, window))

    def flush():
        b = pa.RecordBatch.from_arrays([pa.array(out_d, pa.binary()), pa.array(out_r, pa.list_(pa.int32()))], names=["digest", "ranges"])
        out_d.clear()
        out_r.clear()
        return b

    shard, held, group, key = [], 0, [], None

    def close():
        nonlocal held
        for d, run, n in group:
            if n > 1:
                out_d.append(d)
                out_r.append([0, run.count(b" ") + 1])
        # A lone run can only repeat its own windows, at a distance below the longest run, and then has few different words.
        if any(n == 1 for _, _, n in group) and (len(group) > 1 or len(set(group[0][1].split(b" "))) <= longest_run(window)):
            shard.extend(group)
            held += sum(run.count(b" ") + 2 for _, run, _ in group)
        group.clear()

    for b in batches:
        for k, d, run, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                close()
                key = k
                if held >= SHARD_WORDS:
                    solve(shard)
                    shard, held = [], 0
                if len(out_d) >= 20_000:
                    yield flush()
            group.append((d, run, n))
    close()
    if shard:
        solve(shard)
    yield flush()


def find(docs: DataFrame, scratch: Scratch, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, fingerprint, n_words, sha256) of all rows, and (doc_id, fingerprint, text, covered) of rows with repeated windows.

    ``covered`` has word ranges, which may overlap.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def scan(batches):
        known = WordHashes()
        for b in batches:
            marks, sizes, shas, keys, starts, counts, owner, weights = [], [], [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                raw = t.as_py().encode()
                words = raw.split()
                marks.append(_fingerprint(raw))
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                hashes = known.of(words)
                k = window_keys(hashes, window, 0)
                s, c = runs(k, longest_run(window))
                weights.append(_weights(words, hashes, s, c, window))
                keys.append(k[s])
                starts.append(s)
                counts.append(c)
                owner.append(np.full(len(s), i))
            n, at = b.num_rows, np.concatenate(owner) if owner else np.empty(0, np.int64)
            m = len(at)
            marks = np.array(marks, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), b.column(0).take(pa.array(at))]),
                    pa.array(np.concatenate([marks, marks[at]])),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(shas, pa.string()), pa.nulls(m, pa.string())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(keys).view(np.int64) if m else np.empty(0, np.int64))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(starts).astype(np.int32) if m else np.empty(0, np.int32))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(counts).astype(np.int32) if m else np.empty(0, np.int32))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(weights).astype(np.int32) if m else np.empty(0, np.int32))]),
                ],
                names=["doc_id", "fingerprint", "n_words", "sha", "key", "start", "windows", "weight"],
            )

    told = scratch.save(rows.mapInArrow(scan, "doc_id long, fingerprint long, n_words long, sha string, key long, start int, windows int, weight int"), "scan")
    everyone = told.where("key is null").select("doc_id", "fingerprint", "n_words", "sha")
    met = told.where("key is not null").select("doc_id", "fingerprint", "key", "start", "windows", "weight")
    repeated = scratch.save(met.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select(F.col("key").alias("k")), "repeated")
    wanted = met.join(repeated, F.col("key") == F.col("k"), "left_semi").groupBy("doc_id", "fingerprint").agg(F.collect_set(F.struct("start", "windows", "key")).alias("runs"))
    wanted = scratch.save(wanted.withColumnsRenamed({"doc_id": "wd", "fingerprint": "wf"}), "wanted")
    scratch.drop("repeated")

    def mark(batches):
        for b in batches:
            yield b.append_column("fingerprint", pa.array([_fingerprint(t.as_py().encode()) for t in b.column(1)], pa.int64()))

    marked = rows.mapInArrow(mark, "doc_id long, text string, fingerprint long")
    texts = marked.join(wanted, F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("fingerprint") == F.col("wf"))).select("doc_id", "fingerprint", "text", "runs")
    texts = scratch.save(texts, "texts")
    scratch.drop("wanted")

    def cut(batches):
        """One row for each occurrence of a run (start set), one with its text for each different run of a batch (n set)."""
        for b in batches:
            occurrences, seen = [], {}
            for doc_id, mark_, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                for r in found:
                    run = b" ".join(words[r["start"] : r["start"] + r["windows"] + window - 1])
                    d = _digest(run)
                    occurrences.append((doc_id, mark_, r["start"], d))
                    if d in seen:
                        seen[d][2] += 1
                    else:
                        seen[d] = [r["key"], run, 1]
            o, s = len(occurrences), len(seen)
            cols = list(zip(*occurrences, strict=True)) if o else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*cols[0], *[None] * s], pa.int64()),
                    pa.array([*cols[1], *[None] * s], pa.int64()),
                    pa.array([*cols[2], *[None] * s], pa.int32()),
                    pa.array([*cols[3], *seen], pa.binary()),
                    pa.array([*[None] * o, *(x[0] for x in seen.values())], pa.int64()),
                    pa.array([*[None] * o, *(x[1] for x in seen.values())], pa.binary()),
                    pa.array([*[None] * o, *(x[2] for x in seen.values())], pa.int64()),
                ],
                names=["doc_id", "fingerprint", "start", "digest", "key", "run", "n"],
            )

    pieces = texts.mapInArrow(cut, "doc_id long, fingerprint long, start int, digest binary, key long, run binary, n long").withColumn("part", F.col("n").isNotNull().cast("int"))
    places, texts_of_runs = scratch.save_parts(pieces, "pieces", "part", (0, 1))
    different = scratch.save(texts_of_runs.groupBy("key", "digest", "run").agg(F.sum("n").alias("n")), "different")
    scratch.drop("pieces/part=1")
    ranges = _shards(different, 0, window, scratch)
    ranges = scratch.save(ranges.withColumnRenamed("digest", "rd"), "ranges")
    scratch.drop("different")
    hits = places.join(ranges, F.col("digest") == F.col("rd"))
    covered = hits.select("doc_id", "fingerprint", F.transform("ranges", lambda x: x + F.col("start")).alias("r")).groupBy("doc_id", "fingerprint").agg(F.flatten(F.collect_list("r")).alias("covered"))
    covered = scratch.save(covered.withColumnsRenamed({"doc_id": "cd", "fingerprint": "cf"}), "covered")
    scratch.drop("pieces")
    with_text = texts.select("doc_id", "fingerprint", "text").join(covered, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("fingerprint") == F.col("cf"))).select("doc_id", "fingerprint", "text", "covered")
    return everyone, with_text


def _shards(different: DataFrame, level: int, window: int, scratch: Scratch) -> DataFrame:
    """(digest, ranges) of the different runs (key, digest, run, n) that hold repeated windows."""
    spark = different.sparkSession
    large = scratch.save(different.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select(F.col("key").alias("lk")), f"large-{level}") if level < 2 else None
    small = different.join(large, F.col("key") == F.col("lk"), "left_anti") if large is not None else different
    if level == 2:  # one window each: a group of equal windows needs its count only
        return small.where("n > 1").select("digest", F.array(F.lit(0), F.lit(window)).cast("array<int>").alias("ranges"))
    dealt = small.select("key", "digest", "run", "n").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "digest")
    solved = dealt.mapInArrow(lambda batches: _match(batches, window), "digest binary, ranges array<int>")
    if not large.take(1):
        return solved
    crowded = scratch.save(different.join(large, F.col("key") == F.col("lk"), "left_semi"), f"crowded-{level}")

    def finer(batches):
        known = WordHashes()
        for b in batches:
            parents, starts, digests, keys, texts, ns = [], [], [], [], [], []
            for d, run, n in zip(b.column("digest").to_pylist(), b.column("run").to_pylist(), b.column("n").to_pylist(), strict=True):
                words = run.split(b" ")
                k = window_keys(known.of(words), window, level + 1)
                first, count = (np.arange(len(k)), np.ones(len(k), np.int64)) if level + 1 == 2 else runs(k, longest_run(window))
                for s, c in zip(first.tolist(), count.tolist()):
                    text = b" ".join(words[s : s + c + window - 1])
                    parents.append(d)
                    starts.append(s)
                    digests.append(_digest(text))
                    keys.append(int(k[s].view(np.int64)))
                    texts.append(text)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(parents, pa.binary()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(texts, pa.binary()), pa.array(ns, pa.int64())], names=["parent", "start", "digest", "key", "run", "n"])

    pieces = scratch.save(crowded.mapInArrow(finer, "parent binary, start int, digest binary, key long, run binary, n long"), f"finer-{level}")
    again = scratch.save(pieces.groupBy("key", "digest", "run").agg(F.sum("n").alias("n")), f"again-{level}")
    below = scratch.save(_shards(again, level + 1, window, scratch).withColumnsRenamed({"digest": "bd", "ranges": "br"}), f"below-{level}")
    back = pieces.select("parent", "start", "digest").join(below, F.col("digest") == F.col("bd")).select("parent", F.transform("br", lambda x: x + F.col("start")).alias("r"))
    return solved.union(back.groupBy("parent").agg(F.flatten(F.collect_list("r")).alias("ranges")).withColumnRenamed("parent", "digest"))


def removed_words(n: int, covered: list[int]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.array(covered[0::2], np.int64), 1)
    np.add.at(change, np.array(covered[1::2], np.int64), -1)
    return np.cumsum(change[:-1]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, covered: list[int]) -> str:
    """The text without the covered words; the white space after each removed word goes with it."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw)]
    gone = removed_words(len(spans), covered)
    out, at = [], 0
    for i, (start, _) in enumerate(spans):
        if gone[i]:
            out.append(raw[at:start])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(raw)
    out.append(raw[at:])
    return b"".join(out).strip().decode() if gone.any() else text


def strip_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns and rows, with repeated passages removed from the text."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    _, hits = find(docs, scratch, window, id_col, text_col)
    scratch.drop("scan")  # the other table is not needed here

    def edit(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([without(t.as_py(), c) for t, c in zip(b.column(2), b.column(3).to_pylist(), strict=True)], pa.string())], names=["doc_id", "fingerprint", "text"])

    # A row's text is its key on the other side, so the join needs no fingerprint of it.
    edited = hits.distinct().select("doc_id", F.lit(0).cast("long").alias("fingerprint"), "text", "covered")
    edited = scratch.save(edited.mapInArrow(lambda it: _with_old(it, edit), "doc_id long, hash binary, text string").withColumnsRenamed({"doc_id": "__id", "hash": "__hash", "text": "__text"}), "edited")
    scratch.clear("edited")
    key = F.unhex(F.md5(docs[text_col].cast("binary")))
    joined = docs.join(edited, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__hash")), "left")
    text = F.coalesce(F.col("__text"), docs[text_col])
    return joined.select(*[text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == chars_col else docs[c] for c in docs.columns])


def _with_old(batches, edit):
    """(doc_id, md5 of the old text, new text)."""
    for b in batches:
        old = pa.array([hashlib.md5(t.as_py().encode()).digest() for t in b.column(2)], pa.binary())
        for e in edit(iter([b])):
            yield pa.RecordBatch.from_arrays([e.column(0), old, e.column(2)], names=["doc_id", "hash", "text"])


def op10_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "substring-dedup")
    everyone, hits = find(table(spark, sf_dir, "documents"), scratch, 35, "doc_id", "text")

    def digest(batches):
        for b in batches:
            removed, shas = [], []
            for t, c in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                words = t.as_py().encode().split()
                gone = removed_words(len(words), c)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["hd", "hf", "n_removed", "kept_sha"])

    found = scratch.save(hits.mapInArrow(digest, "hd long, hf long, n_removed long, kept_sha string").distinct(), "digests")
    scratch.clear("scan", "digests")
    joined = everyone.join(found, F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("fingerprint") == F.col("hf")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM dup
), left_over AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.k) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST((SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
