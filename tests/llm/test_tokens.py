import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vectorlake.llm import lattice_lm, packing, word_bpe

from .fixtures import corpus, frame, lower, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
byte_bpe, word = packing.ByteBpe(BYTE), word_bpe.WordBpe(WORD)
mixed = st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<|startoftext|>", "</w>", "'s", "don't", "the", " thereon", "é", "Σ", "\x1c", "\x85", "　", "\0"])), max_size=10).map("".join)


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_byte_bpe_is_the_librarys(text):
    assert np.frombuffer(byte_bpe.encode(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_word_bpe_is_the_librarys(text):
    ids = [int(i) for p, _ in word.parts(text) for i in p.split(" ")]
    assert ids == word_library.encode(text, add_special_tokens=False).ids
    assert " ".join(d for _, d in word.parts(text)) == word_library.decode(ids, skip_special_tokens=False)


def test_encode_frame(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in word_bpe.encode(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        e = word_library.encode(t or "", add_special_tokens=False)
        assert got[i]["ids"] == e.ids and got[i]["decoded"] == word_library.decode(e.ids, skip_special_tokens=False)
    assert word_bpe.encode(frame(spark, rows).where("false")).count() == 0


def test_word_bpe_reads_common_prefixes_once():
    """Pre-tokens of one text: each distinct one is encoded once, and no prefix is read again for the next one."""
    bpe, keys = word_bpe.WordBpe(WORD), []
    follow = bpe._automaton.follow
    bpe._automaton.follow = lambda key: keys.append(key) or follow(key)
    text = " ".join(f"international{''.join(x)}{end}" for x in itertools.product("abc", repeat=4) for end in ("", ",", "."))
    got = bpe.parts(text)
    assert [int(i) for p, _ in got for i in p.split(" ")] == word_library.encode(text, add_special_tokens=False).ids
    assert len(keys) <= 13 + 3 + 9 + 27 + 81 + 2  # prefixes, last characters, punctuation


def test_word_bpe_in_chunks_with_small_stores(monkeypatch):
    texts = [t or "" for _, t, *_ in corpus()] + ["", "a<|endoftext|>b \x1c \x85 \u00c9", "\u0300 the the, THE"]
    want = [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk, stored in ((1, 5), (300, 40), (10**6, 10**6)):
        monkeypatch.setattr(word_bpe, "CHUNK", chunk)
        monkeypatch.setattr(word_bpe, "PARTS", stored)
        monkeypatch.setattr(word_bpe, "PAIRS", stored)
        got = list(word_bpe.WordBpe(WORD).read(texts))
        assert got == [(" ".join(map(str, i)), word_library.decode(i, skip_special_tokens=False)) for i in want]


def test_packing_covers_every_id_once(spark):
    rows = corpus()
    got = packing.pack(frame(spark, rows), shard_ids=3000).collect()
    sequences, documents = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        documents.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"])
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for i, t, *_ in rows:
        whole = [*byte_library.encode(t or "", add_special_tokens=False).ids, 0]
        copies = 1 + (i == rows[-1][0])
        parts = sorted(documents[i], key=lambda r: r["start"])
        assert sum(len(r["ids"]) for r in parts) == copies * len(whole)
        for r in parts:
            assert r["ids"] == whole[r["start"] : r["start"] + len(r["ids"])] and r["doc_tokens"] == len(whole)
    digest = {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in packing.pack_digest(frame(spark, rows)).collect()}
    for (i, start, n), crc in digest.items():
        whole = np.array([*byte_library.encode(next(t for j, t, *_ in rows if j == i) or "", add_special_tokens=False).ids, 0], "<u4")
        assert crc == zlib.crc32(whole[start : start + n].tobytes())
    assert packing.pack(frame(spark, rows).where("false")).count() == 0


def plain_bm25(query, doc, docs):
    total, mean = 0.0, sum(map(len, docs)) / len(docs)
    for t in query:
        tf, df = int((doc == t).sum()), sum(t in x for x in docs)
        total += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
    return total


def counted(docs, size=40):
    df = np.zeros(size)
    for d in docs:
        df[np.unique(d)] += 1
    return packing.Statistics(df, len(docs), sum(map(len, docs)))


def test_bm25_of_a_shard_is_the_formula():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 4], [5], [1, 1, 1, 4, 5])]
    stats = counted(docs)
    got = packing.Bm25Shard(docs, stats).scores(np.array([1, 2, 9]))
    assert np.allclose(got, [plain_bm25((1, 2, 9), d, docs) for d in docs])
    for d in docs:
        weight = {int(t): plain_bm25((t,), d, docs) for t in set(d.tolist())}
        assert stats.query(d).tolist() == sorted(weight, key=lambda t: (-round(weight[t], 12), t))


def test_windows_take_the_best_unused_neighbours():
    """The packer against a plain greedy filling that ranks all unused documents by the formula."""
    rng = np.random.default_rng(3)
    docs = [np.r_[rng.integers(1, 12, rng.integers(1, 9)) + 14 * rng.integers(0, 2), 0].astype(np.uint32) for _ in range(60)]
    stats, window = counted(docs), 20
    queries = [stats.query(d) for d in docs]
    packer = packing._Packer(window, 0)
    packer.shard(list(enumerate(docs)), stats)
    packer.finish()
    order, unused, used, seed = [], list(range(60)), 0, None
    while unused:
        best = unused[0] if seed is None else max(unused, key=lambda d: (round(plain_bm25(queries[seed], docs[d], docs), 9), -d))
        unused.remove(best)
        order.append(best)
        if seed is None:
            seed = best
        used += len(docs[best])
        if used >= window:  # what is left of a cut document opens the next window
            used, seed = used % window, best
        if not used:
            seed = None
    assert list(dict.fromkeys(p[0] for p in packer.pieces)) == order


def test_corpus_statistics(spark):
    rows = corpus()
    encoded = packing.encode(frame(spark, rows), "doc_id", "text", BYTE)
    ids = [np.frombuffer(r["ids"], "<u4") for r in encoded.where("term is null").collect()]
    (got, tokens), want = packing.statistics(encoded), counted(ids, 50_257)
    assert tokens == sum(map(len, ids)) and np.allclose(got.idf, want.idf[: len(got.idf)]) and got.mean == want.mean


def test_lattice_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b" ab", b"bc", b"abc"})
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    value = {x: p[i] for i, x in enumerate(pieces)}
    lattice = lattice_lm.Lattice(pieces)
    names = [b"abc", b"a", b"cab", b"abcabc", b"\xc3\xa9"]
    got = lattice_lm.word_scores(lattice, names, lattice_lm._padded(np.log(p)))
    counts = np.array([[1.0, 2], [0, 1], [3, 0], [1, 1], [0.5, 0]])
    expected = lattice_lm.expected_counts(lattice, names, counts, lattice_lm._padded(np.log(p)))
    brute = np.zeros_like(p)
    for w, g, c in zip(names, got, counts, strict=True):
        s, total, uses = b" " + w, 0, []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, x in enumerate(cuts) if x], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            if all(x in value for x in parts):
                weight = np.prod([value[x] for x in parts], axis=0)
                total = total + weight
                uses.append((parts, weight))
        assert np.allclose(np.log(total), g)
        for parts, weight in uses:
            for x in parts:
                brute[pieces.index(x)] += c * weight / total
    assert np.allclose(brute, expected[: len(pieces)])


def test_lattice_work_is_that_of_its_edges(monkeypatch):
    """Sums over pieces that are there, in the sets that count a word; not over every cut in every set."""
    pieces, first = lattice_lm.vocabulary()
    ids = {x: i for i, x in enumerate(pieces)}
    rng = np.random.default_rng(4)
    alphabet = [b"e", b"n", b"t", b"s", b"i", b"\xc3\xa9", b"\x00", b"\xff", b"q"]
    names = sorted({b"".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(1, 13))) for _ in range(300)} | {b"entertainment" * 3, b"x"})
    counts = np.zeros((len(names), 4))
    counts[np.arange(len(names)), rng.integers(0, 4, len(names))] = rng.integers(1, 5, len(names))
    counts[::10, 2] = 1
    logp = first[:, None] + rng.normal(0, 1, (len(first), 4))
    scores, uses, edges, counted_edges = np.zeros((len(names), 4)), np.zeros_like(logp), 0, 0
    for w, name in enumerate(names):
        s = b" " + name
        found = [(a, b, ids[s[a:b]]) for b in range(1, len(s) + 1) for a in range(b) if s[a:b] in ids]
        edges += len(found)
        counted_edges += len(found) * np.count_nonzero(counts[w])
        for k in range(4):
            alpha, beta = np.zeros(len(s) + 1), np.zeros(len(s) + 1)
            alpha[0] = beta[-1] = 1
            for a, b, i in found:
                alpha[b] += alpha[a] * math.exp(logp[i, k])
            for a, b, i in sorted(found, reverse=True):
                beta[a] += beta[b] * math.exp(logp[i, k])
            scores[w, k] = math.log(alpha[-1])
            for a, b, i in found:
                uses[i, k] += counts[w, k] * alpha[a] * math.exp(logp[i, k]) * beta[b] / alpha[-1]
    exp, taken = np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: (taken.append(np.size(x)), exp(x, *a, **b))[1])
    lattice = lattice_lm.Lattice(pieces)
    got = lattice_lm.word_scores(lattice, names, lattice_lm._padded(logp))
    assert np.allclose(got, scores) and sum(taken) <= 4 * edges
    taken.clear()
    expected = lattice_lm.expected_counts(lattice, names, counts, lattice_lm._padded(logp))
    assert np.allclose(expected[: len(pieces)], uses) and sum(taken) <= counted_edges


def test_lm_scores(spark):
    rows = [*corpus(3, 80), (None, "a b", "en", "a", 3)]
    got = lattice_lm.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*words(lower(t)), None] for _, t, *_ in rows]
    counts: dict = {}
    for (i, *_), ts in zip(rows, tokens, strict=True):
        if not out(i):
            for w in ts:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want: dict = {}
    for (i, *_), ts in zip(rows, tokens, strict=True):
        want.setdefault(i, []).append((out(i), len(ts), sum(counts.get(w, 0) > 0 for w in ts), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ts)))
    for r in got:
        w = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) < 1e-6 and r["score"] < 0 and math.isfinite(r["score"])
    assert lattice_lm.score(frame(spark, rows).where("false")).count() == 0


def test_lm_is_a_distribution(spark):
    """The probabilities of all texts of one word (of a small alphabet) and of the empty one sum to less than 1; seen words have most of it."""
    texts = ["", *("".join(x) for n in (1, 2, 3) for x in itertools.product("abc", repeat=n))]
    rows = [(i, "ab ca", "en", "a", 5) for i in range(20)]
    held = [i for i in range(100, 3000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(texts)]
    got = {r["doc_id"]: r for r in lattice_lm.score(frame(spark, [*rows, *((i, t, "en", "a", 2) for i, t in zip(held, texts, strict=True))])).where("doc_id >= 100").collect()}
    p = {t: 10 ** got[i]["score"] for i, t in zip(held, texts, strict=True)}
    end = p[""]
    assert all(got[i]["held_out"] for i in held) and 0.25 < end < 0.4
    words_ = {t: x / end for t, x in p.items() if t}
    assert 0.5 < end + sum(words_.values()) <= 1 and set(sorted(words_, key=words_.get)[-2:]) == {"ab", "ca"}


def test_vocabulary_score_is_the_marginal_of_the_vocabulary(spark):
    """A short text's score from the vocabulary's scores alone, by writing out all of its segmentations."""
    pieces, first = lattice_lm.vocabulary()
    value = dict(zip(pieces, np.exp(first), strict=True))
    text = "The é ofx"
    (got,) = lattice_lm.score(frame(spark, [(2, text, "en", "a", 9)])).collect()
    total = 1e-3
    for w in text.lower().encode().split():
        s = b" " + w
        sums = 0.0
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, x in enumerate(cuts) if x], len(s)]
            sums += math.prod(value.get(s[a:b], 0.0) for a, b in zip(at, at[1:]))
        total *= sums * (1 - 1e-3)
    assert abs(got["vocabulary_score"] - math.log10(total)) < 1e-9


def test_suffix_automaton_finds_every_token():
    rng = np.random.default_rng(6)
    strings = sorted({"".join(rng.choice(list("ab\u0142"), rng.integers(1, 6))) for _ in range(60)})
    automaton = word_bpe.SuffixAutomaton({s: i for i, s in enumerate(strings)})
    for _ in range(50):
        text = "".join(rng.choice(list("ab\u0142x"), 25))
        state = size = 0
        for end in range(1, 26):
            state, size = automaton.step(state, size, ord(text[end - 1]))
            want = [i for i in sorted(range(len(strings)), key=lambda i: -len(strings[i])) if text[:end].endswith(strings[i])]
            assert [i for i, n in automaton.endings[state] if n <= size] == want


def test_arrow_batches_of_one_task():
    b = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["a", "b"])
    assert list(packing.pack_batches(iter([b]), counted([np.array([1])]), 1024, 100)) == []


def test_small_ids_take_two_bytes():
    for ids, width in (([5, 65_535, 0], 2), ([5, 65_536, 0], 4)):
        raw = packing.stored(np.array(ids, "<u4"))
        got = packing.restored(raw, max(ids))
        assert len(raw) == width * 3 and got.dtype == np.uint32 and got.tolist() == ids
