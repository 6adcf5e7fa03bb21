"""Lexical retrieval packing: a sharded BM25 inverted index fills each training sequence with related documents.

Documents are encoded once into a table of ids.  The documents' frequencies of all vocabulary ids and the mean length
are counted over the whole corpus.  A document's two largest ids, its rarest pieces, place it: documents are range-partitioned by
these, then by a hash that splits a hot id, so that documents with a rare piece in common come to one shard.  A document's query are
the ``QUERY_TERMS`` of its different ids with the largest BM25 weight.  A shard has ``SHARD_IDS`` ids, some 10,000 documents, and an inverted index of its own (id -> documents and BM25 impacts,
with the corpus' frequencies).

A window opens with a seed: the document whose rest the last window cut, or else the shard's next unused one.  The
index ranks all unused documents of the shard against the seed's query; the best fill the window in that order (ties and documents without
a common id: by place), and the last is cut where the window is full.  A shard's unfinished window goes on in the task's next shard.
The one remainder of a task is cut into sequences of power-of-two lengths, so nothing is padded.

The ids are those of the tokenizers library for the file (its special strings included), computed by tiktoken from the same
vocabulary; a property test holds them against the library.  Only vocabulary-sized counts reach the driver.  Rows are sorted inside a partition
and sequence numbers derive from its number, so a recomputed task gives the same rows.

Edge cases: null and empty texts give the single end-of-document id; repeated rows are packed once each; a document longer than a
window spans several; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WINDOW = 1024
#: Ids of a shard, about; its index takes some 200 MB.
SHARD_IDS = 8_000_000
#: Ids of a document that are asked for.
QUERY_TERMS = 24
END = 0
K1, B = 1.2, 0.75


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file, special strings included."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in special:
            ranks.pop(content.encode(), None)
        # fixed value: the pre-tokeniser's pattern
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._core = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self._special = set(special)

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian."""
        special = {x for x in self._special if x in text}
        return bytes(self._core.encode_to_tiktoken_buffer(text, special))


class Statistics:
    """What BM25 takes from the whole corpus."""

    def __init__(self, frequencies: np.ndarray, documents: int, tokens: int):
        self.idf = np.log((documents - frequencies + 0.5) / (frequencies + 0.5) + 1)
        self.mean = max(tokens / max(documents, 1), 1e-6)

    def weight(self, terms: np.ndarray, tf: np.ndarray, lengths) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / self.mean))

    def query(self, ids: np.ndarray) -> np.ndarray:
        """The heaviest different ids of a document, heaviest first; of equal ones the smallest."""
        terms, tf = np.unique(ids, return_counts=True)
        return terms[np.lexsort((terms, -self.weight(terms, tf, len(ids))))[:QUERY_TERMS]]


class Bm25Shard:
    """Inverted index over one shard's documents, given as arrays of token ids."""

    def __init__(self, docs: list[np.ndarray], statistics: Statistics):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
        keys, tf = np.unique((np.concatenate(docs).astype(np.int64) << 32) | owner, return_counts=True)
        terms = keys >> 32
        self.doc = (keys & 0xFFFFFFFF).astype(np.int32)
        self.bounds = np.searchsorted(terms, np.arange(len(statistics.idf) + 1))
        self.impact = statistics.weight(terms, tf, lengths[self.doc])
        self.size = len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for different ids."""
        parts = [slice(self.bounds[t], self.bounds[t + 1]) for t in query.tolist()]
        where = np.concatenate([self.doc[p] for p in parts])
        return np.bincount(where, weights=np.concatenate([self.impact[p] for p in parts]), minlength=self.size)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.uint32())), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class _Packer:
    """Windows of one task.  ``pieces`` collects (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.used = 0
        self.open: list[tuple] = []  # pieces of the unfinished window
        self.seed = np.empty(0, np.uint32)  # its seed's ids
        self.pieces: list[tuple] = []

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Add a whole document, closing each window that it fills."""
        start = 0
        while start < len(ids):
            take = min(self.window - self.used, len(ids) - start)
            self.open.append((doc_id, start, ids[start : start + take], len(ids), self.sequence, self.used))
            self.used += take
            start += take
            if self.used == self.window:
                self.pieces += self.open
                self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def shard(self, docs: list[tuple[int | None, np.ndarray]], statistics: Statistics) -> None:
        """Add the documents (id, ids) of a shard."""
        index = Bm25Shard([ids for _, ids in docs], statistics)
        unused = np.ones(len(docs), dtype=bool)
        following, left = 0, len(docs)

        def use(d: int) -> None:
            nonlocal left
            unused[d] = False
            left -= 1
            self.seed = docs[d][1]  # of the last window that the document reaches
            self.put(*docs[d])

        while left:
            if not self.open:  # a fresh window: the next unused document is its seed
                while not unused[following]:
                    following += 1
                use(following)
                continue
            window, scores = self.sequence, np.where(unused, index.scores(statistics.query(self.seed)), -1.0)
            while left and self.sequence == window:
                d = int(scores.argmax())  # of equal scores the first
                scores[d] = -1.0
                seed = self.seed
                use(d)
                if self.sequence == window:
                    self.seed = seed

    def finish(self) -> None:
        """Cut the unfinished window at powers of two."""
        rest, room, used = self.open, 0, 0
        left = self.used
        for doc_id, start, ids, total, _, _ in rest:
            at = 0
            while at < len(ids):
                if room == used:
                    if used:
                        self.sequence += 1
                    room, used = 1 << (left.bit_length() - 1), 0
                    left -= room
                take = min(room - used, len(ids) - at)
                self.pieces.append((doc_id, start + at, ids[at : at + take], total, self.sequence, used))
                used += take
                at += take
        self.open, self.used = [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.pieces = self.pieces, []
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _PIECE]
        lengths = [len(x) for x in columns[2]]
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(columns[2]) if rows else np.empty(0, "<u4"), pa.uint32()))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), ids, *(pa.array(c, pa.int64()) for c in columns[3:])], schema=_PIECE)


_ENCODERS: dict[str, ByteBpe] = {}


#: Ids below it take two bytes, which halves the shuffle; a document's largest id tells its width.
NARROW = 1 << 16


def stored(ids: np.ndarray) -> bytes:
    """A document's ids as they are sent: unsigned 16-bit numbers, or 32-bit ones if one of them asks for it."""
    return ids.astype("<u2" if int(ids.max(initial=0)) < NARROW else "<u4").tobytes()


def restored(raw: bytes, largest: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype("<u4") if largest < NARROW else np.frombuffer(raw, "<u4")


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, narrow: bool = False) -> DataFrame:
    """(doc_id, ids, first, second, term, n): one row for each document and, with ``term`` set, the tasks' counts for ``statistics``.

    ids are unsigned 32-bit numbers (``narrow``: 16-bit ones where they do), little-endian, with the end id; first and second are the document's two largest different
    ids, which stand for its rarest pieces, as ids follow the order in which pieces were made.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("first", pa.int32()), ("second", pa.int32()), ("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteBpe(path)
        encoder, end = _ENCODERS[path], np.uint32(END).tobytes()
        df, documents, tokens = np.zeros(0, np.int64), 0, 0
        for b in batches:
            ids, first, second = [], [], []
            for t in b.column(1):
                raw = encoder.encode(t.as_py() or "") + end
                numbers = np.frombuffer(raw, "<u4")
                terms = np.unique(numbers)
                if terms[-1] >= len(df):
                    df = np.r_[df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64)]
                df[terms] += 1
                tokens += len(raw) // 4
                ids.append(stored(numbers) if narrow else raw)
                first.append(terms[-1])
                second.append(terms[-2] if len(terms) > 1 else terms[-1])
            n = b.num_rows
            documents += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        at = np.flatnonzero(df)
        terms, counts = np.r_[-2, -1, at], np.r_[documents, tokens, df[at]]
        empty = [pa.nulls(len(terms), f.type) for f in schema][:4]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, first int, second int, term long, n long")


def statistics(encoded: DataFrame) -> tuple[Statistics, int]:
    """Document frequencies of the vocabulary's ids from all documents, and the number of all ids.  One row for each id reaches the driver."""
    got = encoded.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(got["term"].tolist(), got["n"].tolist(), strict=True))
    documents, tokens = n.pop(-2, 0), n.pop(-1, 0)
    df = np.zeros(max(n, default=0) + 1)
    df[list(n)] = list(n.values())
    return Statistics(df, documents, tokens), tokens


def placed(encoded: DataFrame, shard_ids: int, tokens: int) -> DataFrame:
    """(doc_id, ids, first): related documents in one partition, in a fixed order."""
    order = ["place", "first", "second", "part", "doc_id"]
    # Long documents hold large ids: without the hash they would all stand in the last partitions.
    rows = encoded.where("term is null").withColumns({"place": F.xxhash64("first"), "part": F.xxhash64("doc_id", "ids")})
    return rows.repartitionByRange(max(1, -(-tokens // shard_ids)), *order).sortWithinPartitions(*order).select("doc_id", "ids", "first")


def pack_batches(batches: Iterator[pa.RecordBatch], stats: Statistics, window: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    """One task's (doc_id, ids and, if they may be narrow, first) batches -> batches of pieces."""
    context = TaskContext.get()
    packer = _Packer(window, (context.partitionId() if context else 0) << 32)
    docs, held = [], 0
    for batch in batches:
        firsts = batch.column(2).to_pylist() if batch.num_columns > 2 else [NARROW] * batch.num_rows
        for doc_id, raw, largest in zip(batch.column(0).to_pylist(), batch.column(1), firsts, strict=True):
            ids = restored(raw.as_py(), largest)
            docs.append((doc_id, ids))
            held += len(ids)
            if held >= 2 * shard_ids:  # a partition has about half as many
                packer.shard(docs, stats)
                docs, held = [], 0
                yield packer.batch()
    if docs:
        packer.shard(docs, stats)
    packer.finish()
    if packer.pieces:
        yield packer.batch()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pack(docs: DataFrame, id_col: str, text_col: str, path: str | None, window: int, shard_ids: int, form, schema: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = scratch.save(encode(docs, id_col, text_col, path or tokenizer_path(), narrow=True), "ids")
    stats, tokens = statistics(encoded)
    scratch.sweep()
    return placed(encoded, shard_ids, tokens).mapInArrow(lambda it: form(pack_batches(it, stats, window, shard_ids)), schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, ids, doc_tokens, sequence_id, offset."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(2, "ids", b.column(2).cast(pa.list_(pa.int32())))

    return _pack(docs, id_col, text_col, path, window, shard_ids, signed, "doc_id long, start long, ids array<int>, doc_tokens long, sequence_id long, offset long")


def pack_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces with the length and checksum of their ids in place of the ids, taken in the same task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            lengths = np.diff(at).astype(np.int64)
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lengths), pa.array(sums, pa.int64()), b.column(3), b.column(4), b.column(5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return _pack(docs, "doc_id", "text", path, WINDOW, SHARD_IDS, digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))
