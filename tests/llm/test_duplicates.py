import hashlib
import math
import random

import numpy as np
import pytest

from vectorlake.llm import embedding_dedup, fm_index, minhash_dedup, substring_dedup, tiles
from vectorlake.llm.common import Scratch
from vectorlake.llm.graph import components

from .fixtures import corpus, frame, groups, lower, words


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            w = list(text)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), "en", "a", 0))
    return rows


@pytest.mark.parametrize("rows", [corpus(), near_copies()], ids=["corpus", "copies"])
def test_minhash_components(spark, rows):
    got = {}
    for r in minhash_dedup.link(frame(spark, rows), 3, 0.85).collect():
        got.setdefault(r["doc_id"], []).append(r)
    ids = sorted({r[0] for r in rows})
    sets = {i: shingles(t, 3) for i, t, *_ in rows}
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(len(ids), pairs)
    assert sum(map(len, got.values())) == len(rows)
    for i in ids:
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def rivals(seed=9):
    """Many texts that share a long passage but are no near copies, so one list holds many components; some of them linked."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = say(150), []
    for i in range(70):
        own = say(rng.choice([10, 25, 60]))
        rows.append((len(rows), " ".join(passage + own), "en", "a", 0))
        if i % 5 == 0:
            own[-1] = "changed"
            rows.append((len(rows), " ".join(passage + own), "en", "a", 0))
    return rows


def test_tiles_find_all_links(spark, monkeypatch):
    """Lists with many members that stay apart, dealt into tiles of a few members."""
    monkeypatch.setattr(minhash_dedup, "TILE", 8)
    rows = rivals()
    sets = [shingles(t, 3) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(len(rows), pairs)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.link(frame(spark, rows), 3, 0.85).collect()} == dict(enumerate(want))


def test_overlaps_and_roots():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 30))).astype(np.uint64) for _ in range(20)]
    got = tiles.overlaps(sets[:9], sets[9:], columns=7)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[9:]] for a in sets[:9]]
    nodes = np.array([5, 3, 9, 3, 7])
    assert tiles.roots(nodes, np.array([0, 2]), np.array([1, 3])).tolist() == [3, 3, 3, 3, 7]


def test_minhash_edges(spark):
    df = frame(spark, [(None, "a b c d e f g", "en", "a", 1), (4, "a b c d e f g", "en", "a", 1), (4, "other words stand here now", "en", "a", 1)])
    got = sorted((r["doc_id"] is None, r["kept"]) for r in minhash_dedup.link(df, 3, 0.85).collect())
    assert got == [(False, True), (False, True), (True, True)]
    assert minhash_dedup.link(df.where("false"), 3, 0.85).count() == 0
    kept = minhash_dedup.keep_first(df)
    assert kept.columns == df.columns and kept.count() == 3


def test_least_shared():
    t = minhash_dedup.least_shared(64, 0.85)
    tail = sum(math.comb(64, i) * 0.85**i * 0.15 ** (64 - i) for i in range(t))
    assert tail <= minhash_dedup.MISS and 30 <= t <= 45


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    want = groups(400, links)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components(df.where("false"), Scratch(spark, "test")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(15, 12))
    rows = []
    for i in range(120):
        v = base[i % 15] * rng.uniform(0.5, 2) + rng.normal(size=12) * rng.choice([0, 0.02, 0.1, 0.3])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3) if i % 10 else None))
    rows += [(120, None, 1), (121, [0.0] * 12, 1), (122, [float("nan")] * 12, 1), (123, [1.0], 1), (124, [1.0], 1), (125, [], 1), (126, rows[1][1], rows[1][2]), (127, [None] * 12, 1), (128, [3e38] * 12, 2), (129, [1e-40] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS node", "'clash' AS links", "1 AS dim")
    got = {r["vec_id"]: r for r in embedding_dedup.link(df).collect()}

    def cosine(a, b):
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))

    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(np.float32(x) != 0 for x in r[1])]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98]
    want = groups(130, pairs)
    for i in range(130):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in pairs), want[i], want[i] == i), i
    assert embedding_dedup.link(df.where("false")).count() == 0


def test_linked_pairs_at_the_threshold():
    x = np.array([[1.0, 0, 0], [0.98, math.sqrt(1 - 0.98**2), 0], [0.6, 0.8, 0]])
    i, j = embedding_dedup.linked_pairs(x, x, np.eye(3), 0.98, True)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1)]


def test_wavelet_and_index():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletTree(seq, 37)
    s, a, b = rng.integers(0, 37, 200), rng.integers(0, 1001, 200), rng.integers(0, 1001, 200)
    low, high = tree.rank(s, a, b)
    assert low.tolist() == [int((seq[:p] == c).sum()) for c, p in zip(s, a)] and high.tolist() == [int((seq[:p] == c).sum()) for c, p in zip(s, b)]
    text = np.r_[rng.integers(1, 4, 300), 0]
    index = fm_index.FmIndex(text, 4)
    for n in (1, 3, 6):
        at = int(rng.integers(0, 300 - n))
        low, high = np.array([0]), np.array([len(text)])
        for c in text[at : at + n][::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum((text[i : i + n] == text[at : at + n]).all() for i in range(300 - n + 1))


def repeats(rows, window):
    """(id, kept words) by counting windows."""
    counts: dict = {}
    for _, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            counts[k] = counts.get(k, 0) + 1
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for a in range(len(w) - window + 1):
            if counts[tuple(w[a : a + window])] > 1:
                gone |= set(range(a, a + window))
        out.append((i, [x for k, x in enumerate(w) if k not in gone]))
    return out


@pytest.mark.parametrize("group", [400, 1], ids=["anchors", "finer"])
def test_substrings(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = [*corpus(7, 40), (None, "a b " * 60, "en", "a", 1), (90, "p q r s " * 40 + "end", "en", "a", 1)]
    got = substring_dedup.strip_repeats(frame(spark, rows), window=35)
    assert got.columns == frame(spark, rows).columns
    want = sorted((str(i), w) for i, w in repeats(rows, 35))
    assert sorted((str(r["doc_id"]), words(r["text"])) for r in got.collect()) == want


def test_substring_text_is_kept_elsewhere():
    assert substring_dedup.without("a  b\nc d", [1, 2]) == "a  c d"
    assert substring_dedup.without("a b", []) == "a b"
    assert substring_dedup.without(" a b ", [0, 2]) == ""


def test_substring_edges(spark):
    df = frame(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0)])
    assert sorted(r["text"] or "" for r in substring_dedup.strip_repeats(df).collect()) == ["", ""]
    assert substring_dedup.strip_repeats(df.where("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(b" ".join([])).hexdigest()
