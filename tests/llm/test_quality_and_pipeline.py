import hashlib
import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vectorlake.llm import quality
from vectorlake.llm.common import Scratch

from .fixtures import corpus, frame, groups, words


def base(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def boilerplate():
    """Twenty documents of host "a" share a line beside different ones; twelve copies share all theirs."""
    rows = corpus(11, 30)
    word = lambda *x: "".join(map(str, x)).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits count as equal in lines
    line = "Accept our cookies to go on reading, please, or read how we and our partners use them."
    for i in range(100, 120):
        rows.append((i, f"{line}\n" + " ".join(word("w", i, "x", k) for k in range(30)), "en", "a", 0))
    for i in range(120, 140):
        rows.append((i, "\n".join([line, " ".join(word("v", i, "y", k) for k in range(8))]), "en", "a", 0))
    copied = "\n".join(" ".join(word("c", j, "z", k) for k in range(12)) for j in range(4))
    rows += [(i, copied, "en", "a", 0) for i in range(140, 152)]
    return rows


def removed_lines(rows):
    """Lines above the limit, by counting documents: equal lists of lines once, near copies among what these counts deplete once."""
    norm = lambda x: hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ").encode()).digest()
    sizes: dict = {}
    documents = []
    for _, t, _, host, _ in rows:
        host = host or ""
        sizes[host] = sizes.get(host, 0) + 1
        lines = [x for x in (t or "").split("\n") if words(x)]
        documents.append(((host, *map(norm, lines)), host, lines, words(t)))

    def above(name):
        seen: dict = {}
        for key, host, lines, _ in documents:
            for x in lines:
                seen.setdefault((host, norm(x)), set()).add(name.get(key, key))
        return {k for k, v in seen.items() if len(v) > min(max(10, 0.005 * sizes[k[0]]), 1000)}

    first = above({})
    depleted = {key: (host, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for key, host, lines, w in documents if sum(len(words(x)) for x in lines if (host, norm(x)) in first) > 0.5 * len(w)}
    keys = sorted(depleted)
    alike = lambda a, b: a[0] == b[0] and 100 * len(a[1] & b[1]) >= 80 * len(a[1] | b[1]) > 0
    classes = groups(len(keys), [(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and alike(depleted[a], depleted[b])])
    return above({k: keys[c] for k, c in zip(keys, classes, strict=True)}), norm


def test_quality(spark):
    rows = boilerplate()
    gone, norm = removed_lines(rows)
    assert len(gone) == 1
    got: dict = {}
    for r in quality.judge(frame(spark, rows), Scratch(spark, "test")).collect():
        got.setdefault(r["id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    kept = []
    for i, t, _, host, _ in rows:
        n, chars, symbols, dup, rep = base(t)
        failed = n < 20 or 100 * rep > 30 * n
        lost = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and (host or "", norm(x)) in gone)
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["removed_words"]) == (n, chars, symbols, dup, rep, failed, lost), i
        assert r["kept"] == (not failed and lost <= 0.5 * n)
        kept += [i] * r["kept"]
    assert all(i not in kept for i in range(120, 140)) and all(i in kept for i in [*range(100, 120), *range(140, 152)])
    clean = quality.clean(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert sorted(texts) == sorted(set(kept)) and "cookies" not in texts[100] and texts[140] == rows[-1][1]
    assert quality.clean(frame(spark, rows).where("false")).count() == 0


def test_lines_that_stand_together(spark):
    """Each line of a block of boilerplate counts; the lines of a document's copies and near copies do not."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    say = lambda k: " ".join(word() for _ in range(k))
    short, line, footer = "Home News Sport and more of it in here", "Accept our cookies to go on reading, please.", "All rights reserved by the owners of this site"
    rows = [(i, f"{line}\n{say(50)}\n{line}", "en", "a", 0) for i in range(20)]
    rows += [(i, "\n".join([short, line, say(10)]), "en", "a", 0) for i in range(20, 40)]
    rows += [(i, "\n".join([short, line, footer]), "en", "a", 0) for i in range(40, 60)]  # copies, of shared lines only
    rows += [(i, "\n".join([short, line, footer, say(8)]), "en", "a", 0) for i in range(60, 80)]
    article = [[word() for _ in range(20)] for _ in range(30)]
    rows += [(i, "\n".join(map(" ".join, article)), "en", "a", 0) for i in range(100, 120)]
    for i in range(120, 150):  # one word changed, in another line each time
        near = [list(x) for x in article]
        near[i - 120][i % 20] = word()
        rows.append((i, "\n".join(map(" ".join, near)), "en", "a", 0))
    got = {r["id"]: r for r in quality.judge(frame(spark, rows), Scratch(spark, "test")).collect()}
    size = {x: len(words(x)) for x in (short, line, footer)}
    for i, t, *_ in rows:
        lost = sum(size.get(x, 0) for x in t.split("\n"))
        assert got[i]["removed_words"] == lost and got[i]["kept"] == (not got[i]["base_failed"] and lost <= 0.5 * len(words(t))), i
    assert not any(got[i]["kept"] for i in range(20, 80)) and all(got[i]["kept"] for i in [*range(20), *range(100, 150)])


def test_long_lines_and_large_hosts(spark):
    rng = random.Random(6)
    say = lambda k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(k))
    notice = say(45)
    rows = [(i, f"{notice}\n{say(60)}", "en", "a", 0) for i in range(20)] + [(i, f"{notice}\n{say(30)}", "en", "a", 0) for i in range(20, 40)]
    got = {r["id"]: r for r in quality.judge(frame(spark, rows), Scratch(spark, "test")).collect()}
    assert all(r["removed_words"] == 45 and r["kept"] == (i < 20) for i, r in got.items())
    limits = spark.createDataFrame([(10,), (100_000,), (10_000_000,)], "n long").orderBy("n").select(quality.line_limit(F.col("n")).alias("x"))
    assert [r["x"] for r in limits.collect()] == [10, 500, 1000]


def test_pipeline(spark, tmp_path):
    rows = boilerplate()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")  # with columns whose names clash
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first, second, third = texts
    assert set(range(140, 152)) <= set(first) and set(range(140, 152)) & set(second) == {140}
    assert set(third) == set(second)

    def sets(t):
        w = words(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    ids = sorted(second)
    for a in ids:  # nothing near is left, and nothing went without a near one
        for b in ids:
            if a < b and sets(second[a]) and sets(second[b]):
                assert len(sets(second[a]) & sets(second[b])) < 0.8 * len(sets(second[a]) | sets(second[b]))
    for a in set(first) - set(second):
        assert any(len(sets(first[a]) & sets(first[b])) >= 0.8 * len(sets(first[a]) | sets(first[b])) for b in first if b != a)
    windows: dict = {}
    for t in second.values():
        w = words(t)
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])] = windows.get(tuple(w[i : i + 50]), 0) + 1
    for i, t in second.items():
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if windows[tuple(w[k : k + 50])] > 1:
                gone |= set(range(k, k + 50))
        assert words(third[i]) == [x for k, x in enumerate(w) if k not in gone]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(third)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in third.items():
        parts = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in parts for x in r["ids"]] == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_entry_holds_all_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
