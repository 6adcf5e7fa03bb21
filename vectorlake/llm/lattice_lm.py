"""LM scoring with a subword lattice over an existing vocabulary.

A word is the marker byte (a space) and its bytes; its lattice probability sums the products of piece probabilities over
all segmentations into vocabulary pieces, by forward recursion in log space.  Single bytes are pieces too, so every word
has a segmentation.  The vocabulary is that of an existing tokenizer file, whose scores rank the pieces.  A text's marginal over all its
segmentations is the product of its words', as no piece crosses a word's start.  Two marginals are returned.

``vocabulary_score`` weights the pieces by the existing vocabulary's scores alone, ``1 / (1 + rank)``, normalised once.

``score`` is the marginal in the lattice of a corpus, as the vocabulary's scores alone predict texts far worse than counting words does
(figures in the README).  Its piece
probabilities are learned from the training texts: starting from ``1 / (1 + rank)`` as the scores give it, expectation
maximisation over the training words (each counted once, as the lattice must foretell new words) fits one set of probabilities
for each language of the training rows.  The forward recursion tells what share of the probability at a position came over which
piece; one way back over these shares gives the expected uses.

A word that training texts hold has one more edge in its lattice, from its start to its end, weighted by its count less a discount:

    p_all(w) = max(c - D, 0) / N   + D V / N     * lattice_k(w)
    p_k(w)   = max(c_k - D, 0) / N_k + D V_k / N_k * p_all(w)

with c, N, V the word's count, the tokens and the distinct tokens of all training texts, with k those of language k.  What
the discounts free pays for the lattice, so each p_k is a distribution over all words and the end of text.  A text's
probability is the mixture over k of the product of its tokens' p_k, weighted by the shares of the training texts.

Counting, fitting and scoring cover all rows.  Words are counted once for the whole corpus and scored once each.  The words that make
up more than 1 / ``COMMON`` of all tokens, hence fewer than ``COMMON`` words whatever the corpus, are sent to all tasks;
the others meet their scores in a join, in which no key is common.  Only vocabulary-sized sums reach the driver.

Edge cases: null and empty texts consist of the end token alone; a null id counts as the text "" in the held-out rule; a null
language is one of its own; languages beyond the ``LANGUAGES`` - 1 most frequent share one set; repeated rows are scored (and counted) each;
without training rows the pieces keep their first probabilities; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Words that are sent to all tasks, at most: some 50 MB with their scores.
COMMON = 300_000
LANGUAGES = 8
ROUNDS = 3
#: Weight, in piece counts, of the probabilities over all languages when one language's are fitted.
PRIOR = 50.0
#: What is taken off each count.
DISCOUNT = 0.75
#: The lattice's own probability of the end of text.
END = 1e-3
#: Words that are put through the recursion together; they are grouped by length.
BLOCK = 40_000
MARK = b" "


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (space for the word marker) and their first log probabilities."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        rank = abs(model.get_score(i))
        piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        if piece.count(MARK) > 1 or MARK in piece[1:]:
            continue  # a word holds the marker once, in front
        weight[piece] = weight.get(piece, 0.0) + 1 / (1 + rank)
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces]) + 1e-6
    return pieces, np.log(p / p.sum())


class Lattice:
    """Finds vocabulary pieces in many words at once and sums over segmentations.

    The pieces form a trie; its steps (state, byte) are kept in a hash table, so that a start is followed only as far as some piece goes on.
    """

    def __init__(self, pieces: list[bytes]):
        steps: dict[int, int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            state = 0
            for b in piece:
                state = steps.setdefault(state << 9 | b, len(steps) + 1)
            ends[state] = i
        if any(steps.get(b) not in ends for b in range(256)):
            raise ValueError("every single byte has to be a piece")
        self._piece = np.full(len(steps) + 1, -1, np.int32)
        self._piece[list(ends)] = list(ends.values())
        bits = max(8, (2 * len(steps)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._states = np.full(1 << bits, -1, np.int32)
        keys, states = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self._keys[slot[free]], self._states[slot[free]] = keys[free], states[free]
            keys, states, slot = (np.delete(x, free) for x in (keys, states, slot))
            slot = (slot + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The states after these steps, -1 where there are none."""
        slot = self._slot(keys)
        held = self._keys[slot]
        found = np.where(held == keys, self._states[slot], -1)
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            slot[on] = s = (slot[on] + 1) & self._mask
            held = self._keys[s]
            hit = held == keys[on]
            found[on[hit]] = self._states[s[hit]]
            on = on[~hit & (held >= 0)]
        return found

    def edges(self, words: np.ndarray) -> Edges:
        """The pieces in equally long words (rows of bytes)."""
        count, size = words.shape
        chars = np.full((size + 1, count), 256, np.int64)  # no step goes over a word's end
        chars[:size] = words.T
        chars = chars.ravel()
        at, state = np.arange(size * count), np.zeros(size * count, np.int64)
        starts, ids, n = [], [], 0
        while len(at):
            state = self._step(state << 9 | chars[at + n * count])
            on = np.flatnonzero(state >= 0)
            at, state = at[on], state[on].astype(np.int64)
            piece = self._piece[state]
            hit = np.flatnonzero(piece >= 0)
            starts.append(at[hit])
            ids.append(piece[hit])
            n += 1
        # In order of their ends: by counting, as those of one length end in different places.
        before = np.zeros((size + 1) * count + 1, np.int64)
        for n, s in enumerate(starts, 1):
            before[s + (n * count + 1)] += 1
        np.cumsum(before, out=before)
        free, total = before[:-1].copy(), before[-1]
        start, piece, end = (np.empty(total, t) for t in (np.int64, np.int32, np.int64))
        for n, (s, i) in enumerate(zip(starts, ids, strict=True), 1):
            e = s + n * count
            to = free[e]
            free[e] += 1
            start[to], piece[to], end[to] = s, i, e
        return Edges(count, size, start, end, piece, before)


class Edges:
    """The lattices of equally long words.  A position of a word is the number position * words + word; edges are in order of their ends."""

    def __init__(self, count: int, size: int, start: np.ndarray, end: np.ndarray, piece: np.ndarray, before: np.ndarray):
        self.count, self.size, self.start, self.piece = count, size, start, piece
        self.word = end % count
        self._cuts = before[::count]
        self._firsts = [before[e * count : (e + 1) * count] - before[e * count] for e in range(1, size + 1)]

    def _ending(self, end: int) -> slice:
        return slice(self._cuts[end], self._cuts[end + 1])

    def forward(self, logp: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
        """The words' log probabilities, from those of the edges; ``shares`` gets each edge's share of the probability that arrives at its end."""
        alpha = np.zeros((self.size + 1) * self.count)
        for end, firsts in enumerate(self._firsts, 1):
            here = self._ending(end)
            word = self.word[here]
            x = alpha[self.start[here]] + logp[here]
            top = np.maximum.reduceat(x, firsts)
            x = np.exp(x - top[word])
            total = np.add.reduceat(x, firsts)
            alpha[end * self.count : (end + 1) * self.count] = top + np.log(total)
            if shares is not None:
                shares[here] = x / total[word]
        return alpha[self.size * self.count :]

    def uses(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The expected number of uses of each edge: what arrives at a position came over its edges in these shares, so that the way back needs sums only."""
        used = np.empty(len(logp))
        self.forward(logp, used)
        passed = np.zeros((self.size + 1) * self.count)
        passed[self.size * self.count :] = weight
        for end in range(self.size, 0, -1):
            here = self._ending(end)
            used[here] *= passed[end * self.count : (end + 1) * self.count][self.word[here]]
            passed[self.start[here]] += used[here]  # a word's edges with one end have different starts
        return used


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, byte matrix with markers) for each length, in blocks."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        size = lengths[order[a]] + 1
        step = max(1, 4_000_000 // (size * 16))  # bounds the memory of very long words
        for c in range(a, b, step):
            rows = order[c : min(c + step, b)]
            yield rows, np.frombuffer(b"".join([MARK + words[r] for r in rows]), np.uint8).reshape(len(rows), size)


def word_scores(lattice: Lattice, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Natural log probability of each word under each set; ``logp`` has a row for each piece and a column for each set."""
    out = np.empty((len(words), logp.shape[1]))
    columns = np.ascontiguousarray(logp.T)
    for rows, chars in _by_length(words):
        edges = lattice.edges(chars)
        for k, column in enumerate(columns):
            out[rows, k] = edges.forward(column[edges.piece])
    return out


def expected_counts(lattice: Lattice, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each set; ``counts`` has the words' counts for each set.

    ``logp`` may have a single column, of probabilities that all sets still share.  A word is put through the recursions of
    those sets only that count it; most words stand in one.
    """
    size, n_sets = len(logp), counts.shape[1]
    sums = np.zeros(size * n_sets)
    logp = np.broadcast_to(logp, (size, n_sets)).ravel()
    row, k = np.nonzero(counts)
    weight = counts[row, k]
    for rows, chars in _by_length([words[i] for i in row.tolist()]):
        edges = lattice.edges(chars)
        to = edges.piece * n_sets + k[rows][edges.word]
        sums += np.bincount(to, weights=edges.uses(logp[to], weight[rows]), minlength=len(sums))
    return sums.reshape(size, n_sets)


def _padded(logp: np.ndarray) -> np.ndarray:
    """Piece rows by sets, with a last row of -inf for what is no piece."""
    return np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _words(text: pa.BinaryScalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice-lm")
    group = F.coalesce(docs[group_col].cast("string"), F.lit("")) if group_col else F.lit("")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), group.alias("lang"), is_held_out(docs[id_col]).alias("held_out"))
    sizes = rows.where("not held_out").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES - 1).collect()
    sets = {r["lang"]: k for k, r in enumerate(sizes)}
    others = rows.where("not held_out").select("lang").distinct().count() > len(sets)
    n_sets = max(len(sets) + others, 1)
    rest = n_sets - 1  # the set of all other languages, if there are any

    # 1. Words and their training counts by set.
    def count(batches):
        held: dict[int, Counter] = {}

        def emit():
            for k, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), k, np.int32)), pa.array(list(c.values()), pa.int64())], names=["word", "s", "n"])
            held.clear()

        for b in batches:
            for text, lang, out in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = -1 if out else sets.get(lang, rest)
                held.setdefault(s, Counter()).update(_words(text))
                if sum(map(len, held.values())) > 400_000:
                    yield from emit()
        yield from emit()

    partial = rows.select("text", "lang", "held_out").mapInArrow(count, "word binary, s int, n long")
    per_set = [F.sum(F.when(F.col("s") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n_sets)]
    counted = partial.groupBy("word").agg(*per_set, F.sum("n").alias("everywhere"))
    counted = scratch.save(counted.select("word", F.array(*[f"n{k}" for k in range(n_sets)]).alias("by_set"), sum((F.col(f"n{k}") for k in range(1, n_sets)), F.col("n0")).alias("c"), "everywhere"), "words")
    by = lambda k: F.col("by_set")[k]
    totals = counted.agg(
        F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.sum("everywhere").alias("all"), *[F.sum(by(k)).alias(f"n{k}") for k in range(n_sets)], *[F.count(F.when(by(k) > 0, 1)).alias(f"v{k}") for k in range(n_sets)]
    ).first()
    texts = {r["lang"]: r["count"] for r in sizes}
    trained = rows.where("not held_out").count()
    ends = np.array([*texts.values(), trained - sum(texts.values())][:n_sets], dtype=np.float64)
    tokens = np.array([totals[f"n{k}"] or 0 for k in range(n_sets)]) + ends
    kinds = np.array([totals[f"v{k}"] for k in range(n_sets)]) + (ends > 0)
    train_tokens = int(tokens.sum())
    distinct = totals["v"] + (trained > 0)

    def token_scores(c_k: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log p_k of tokens from their counts in each set and their lattice probabilities."""
        c, n = c_k.sum(axis=1, keepdims=True), max(train_tokens, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(train_tokens > 0, np.maximum(c - DISCOUNT, 0) / n + DISCOUNT * distinct / n * lattice, lattice)
            p = np.where(tokens > 0, np.maximum(c_k - DISCOUNT, 0) / tokens + DISCOUNT * kinds / tokens * p, p)
        return p

    # 2. Piece probabilities.
    pieces, first = vocabulary(vocabulary_path)
    lattice, size = Lattice(pieces), len(pieces)

    def normalized(sums: np.ndarray) -> np.ndarray:
        """Log probabilities of the pieces for each set."""
        everywhere = sums.sum(axis=1) + 1e3 * np.exp(first)
        counts = sums + PRIOR * (everywhere / everywhere.sum())[:, None]
        return np.log(counts / counts.sum(axis=0))

    logp = first[:, None]
    for _ in range(ROUNDS if trained else 0):
        now = _padded(logp)

        def expect(batches, now=now):
            sums = None
            for t in _blocks(batches):
                words = t.column("word").to_pylist()
                counts = t.column("by_set").combine_chunks().flatten().to_numpy().reshape(len(words), n_sets)
                counts = (counts > 0).astype(np.float64)
                got = expected_counts(lattice, words, counts, now)[:size]
                sums = got if sums is None else sums + got
            if sums is not None:
                at, k = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[at, k])], names=["piece", "s", "n"])

        expected = counted.where("c > 0").select("word", "by_set").mapInArrow(expect, "piece int, s int, n double").groupBy("piece", "s").agg(F.sum("n").alias("n"))
        sums = np.zeros((size, n_sets))
        got = expected.toPandas()  # at most one row for each piece of the vocabulary and set
        sums[got["piece"], got["s"]] = got["n"]
        logp = normalized(sums)
    logp = np.broadcast_to(logp, (size, n_sets))
    shares = np.log((ends + 0.5) / (ends + 0.5).sum())
    end_scores = np.log(token_scores(ends[None, :], np.full((1, n_sets), END)))[0]

    # 3. Every word's scores, once.
    now = _padded(np.column_stack([logp, first]))
    divisor = math.log10(train_tokens + distinct + 1)
    new_word = np.log(token_scores(np.zeros((1, n_sets)), np.ones((1, n_sets))))

    def per_word(batches):
        for t in _blocks(batches):
            words = t.column("word").to_pylist()
            c = t.column("c").to_numpy()
            marginals = word_scores(lattice, words, now) + math.log(1 - END)
            lattice_log = marginals[:, :n_sets]
            c_k = t.column("by_set").combine_chunks().flatten().to_numpy().reshape(len(words), n_sets)
            p = token_scores(c_k, np.exp(lattice_log))
            # Where doubles underflow, the word is new and what is left is the lattice times the discounts' shares.
            with np.errstate(divide="ignore"):
                lps = np.where(p > 1e-280, np.log(p), lattice_log + new_word)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(lps.ravel()), n_sets).cast(pa.list_(pa.float64()))
            yield from pa.table({"word": t.column("word"), "known": pa.array((c > 0).astype(np.int64)), "base": pa.array(np.log10(c + 1) - divisor), "vp": pa.array(marginals[:, -1]), "lps": flat, "everywhere": t.column("everywhere")}).to_batches()

    scored = scratch.save(counted.mapInArrow(per_word, "word binary, known long, base double, vp double, lps array<double>, everywhere long"), "scored")
    common = scored.where(F.col("everywhere") > (totals["all"] or 0) / COMMON).select("word", "known", "base", "vp", "lps").toArrow()
    common_words = {w: i for i, w in enumerate(common.column("word").to_pylist())}
    common_values = np.column_stack([*(common.column(x).to_numpy() for x in ("known", "base", "vp")), common.column("lps").combine_chunks().flatten().to_numpy().reshape(-1, n_sets)]) if common_words else np.zeros((0, 3 + n_sets))
    sent = spark.sparkContext.broadcast((common_words, np.vstack([common_values, np.zeros(3 + n_sets)])))
    base_end = math.log10(trained + 1) - divisor
    names = [f"v{k}" for k in range(n_sets)]

    # 4. Texts: sums over common words at once, one row for each other word of a text.
    def per_text(batches):
        at, values = sent.value
        get, none = at.get, len(values) - 1
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            sums, tokens, far_words, far_ns, far_each = [], [], [], [], []
            for text in b.column(2).cast(pa.binary()):
                words = Counter(_words(text))
                ids = np.fromiter(map(get, words, repeat(none)), np.int64, len(words))
                ns = np.fromiter(words.values(), np.float64, len(words))
                sums.append(ns @ values[ids] if len(ids) else np.zeros(values.shape[1]))
                tokens.append(int(ns.sum()) + 1)
                far = list(filterfalse(at.__contains__, words))
                far_words += far
                far_ns += map(words.__getitem__, far)
                far_each.append(len(far))
            total, other = b.num_rows, len(far_words)
            keys = np.arange(number, number + total)
            number += total
            s = np.array(sums).reshape(total, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys, np.repeat(keys, np.array(far_each, np.int64))])),
                    pa.concat_arrays([b.column(0).cast(pa.int64()), pa.nulls(other, pa.int64())]),
                    pa.concat_arrays([b.column(1).cast(pa.bool_()), pa.nulls(other, pa.bool_())]),
                    pa.array([None] * total + far_words, pa.binary()),
                    pa.array(tokens + far_ns, pa.int64()),
                    *(pa.concat_arrays([pa.array(s[:, k]), pa.nulls(other, pa.float64())]) for k in range(3 + n_sets)),
                ],
                names=["row", "doc_id", "held_out", "word", "n", "known", "base", "vp", *names],
            )

    schema = "row long, doc_id long, held_out boolean, word binary, n long, known double, base double, vp double, " + ", ".join(f"{x} double" for x in names)
    told = scratch.save(rows.select("doc_id", "held_out", "text").mapInArrow(per_text, schema), "texts")
    others = told.where("word is not null").select("row", "word", "n")
    n = F.col("n")
    joined = others.join(scored.withColumnRenamed("word", "w").drop("everywhere"), F.col("word") == F.col("w")).groupBy("row").agg(
        F.sum(n * F.col("known")).cast("double").alias("known"), F.sum(n * F.col("base")).alias("base"), F.sum(n * F.col("vp")).alias("vp"), *[F.sum(n * F.col("lps")[k]).alias(x) for k, x in enumerate(names)]
    )
    texts_only = told.where("word is null").drop("word")
    far = joined.select(F.col("row").alias("far_row"), *[F.col(x).alias(f"far_{x}") for x in ("known", "base", "vp", *names)])
    both = texts_only.join(far, F.col("row") == F.col("far_row"), "left")
    value = lambda x: F.col(x) + F.coalesce(F.col(f"far_{x}"), F.lit(0.0))
    parts = [value(x) + F.lit(float(end_scores[k] + shares[k])) for k, x in enumerate(names)]
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    marginal = top + F.log(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top)))
    return both.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (value("known") + (1 if trained else 0)).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (value("base") + F.lit(base_end)).alias("base_score"),
        (marginal / F.lit(math.log(10))).alias("score"),
        ((value("vp") + F.lit(math.log(END))) / F.lit(math.log(10))).alias("vocabulary_score"),
    )


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
