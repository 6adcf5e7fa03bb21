"""A small document table with awkward rows, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "an", "in", "é", "on", "Re", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(150)]

    def text(k):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) + ("\n" if rng.random() < 0.06 else "") for _ in range(k)).replace("\n ", "\n")

    passage = text(70)
    rows = []
    for i in range(n):
        t = text(rng.randint(15, 200))
        if i % 7 == 3:
            t = t + " " + passage + " " + text(20)
        if i % 9 == 4 and rows:
            t = rows[-1][1] or t  # exact copy
        if i % 9 == 5 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)  # near copy
        rows.append((i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b"]), len(t)))
    rows += [
        (n, None, "en", "a", 0),
        (n + 1, "", None, None, 0),
        (n + 2, "one", "en", "a", 3),
        (n + 3, " \n\t ", "en", "b", 4),
        (n + 4, "that " * 400, "en", "b", 2000),
        (n + 5, "x<|endoftext|>y </s> \\ <|startoftext|>", "fr", "a", 38),
        (n + 6, "two words", None, None, 9),
        (n + 7, text(6000), "en", "a", 1),
    ]
    rows.append(rows[5])  # a repeated row
    return rows


def frame(spark, rows, extra: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if not extra:
        return df
    return df.withColumns({c: F.lit("clash") for c in ("key", "shard", "words", "row", "component", "n", "hash", "removed", "fingerprint", "word", "node")})


def groups(n: int, links) -> list[int]:
    """Smallest member of each item's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
