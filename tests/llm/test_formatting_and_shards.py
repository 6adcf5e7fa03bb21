import hashlib
import math
import struct
import zlib

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorlake.llm import chat, sharding

from .fixtures import corpus, frame

pieces = st.lists(st.sampled_from(["\\", "<", "[", "</s>", "[INST]", "[/INST]", "<<SYS>>", " ", "a", "/s>", "[ROLE]", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "</s>"]), pieces), max_size=6))
def test_any_turns_read_back(turns):
    parts = chat.segments(turns)
    assert chat.read_back("".join(p for p, _ in parts)) == turns
    assert [chat.unescape(p) for p, loss in parts if loss] == [t for r, t in turns if r == "assistant"]


def test_automaton():
    assert chat.accepted(["system", "user", "assistant"]) and chat.accepted(["user", "assistant"] * 3)
    for bad in ([], ["user"], ["assistant"], ["user", "user", "assistant"], ["user", "system", "assistant"], ["system", "assistant"]):
        assert not chat.accepted(bad)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "user", "tie"), (None, 0, "user", "</s>"), (3, 0, "user", "u"), (3, 0, "user", "u"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS c", "-1 AS n", "'clash' AS r", "'clash' AS t", "'clash' AS formatted", "true AS valid")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", ""), ("assistant", "yes")] and got[1]["valid"]
    assert chat.read_back(got[2]["formatted"]) == [("", "x"), ("user", "tie")] and not got[2]["valid"]
    assert chat.read_back(got[None]["formatted"]) == [("user", "</s>")]
    assert len(chat.read_back(got[3]["formatted"])) == 3
    assert "".join(got[1]["texts"]) == got[1]["formatted"]
    assert chat.format_conversations(df.where("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # digests of empty texts are defined


def test_shards(spark):
    rows = corpus()
    df = frame(spark, [*rows, (None, "no id", "en", "a", 5)])
    placed = sharding.assign(df, "doc_id", "text", [1.0] * 16, added=1.0)
    got = sharding.with_slots(placed, 7).collect()
    assert len(got) == len(rows) + 1
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        if r["key"] is not None:
            raw = (by_id[r["key"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.with_slots(sharding.assign(df.where("false"), "doc_id", "text", [1.0] * 4), 3).count() == 0


def test_weights_set_the_shares(spark):
    n = 20_000
    got = spark.range(n)
    counts = {r["s"]: r["count"] for r in got.select(sharding.rendezvous(got.id, [1.0, 3.0]).alias("s")).groupBy("s").count().collect()}
    assert abs(counts[1] / n - 0.75) < 0.02


def test_the_best_weighted_score_wins(spark):
    """Each key's shard by scoring all shards in Python, with and without one more."""
    weights = [1.0, 2.0, 0.5, 1.0]

    def winner(key, weights):
        def score(shard):
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
            return -weights[shard] / math.log(((h >> 11) + 0.5) * 2.0**-53)

        return max(range(len(weights)), key=score)

    df = frame(spark, [(i, "x", "en", "a", 1) for i in range(300)])
    for r in sharding.assign(df, "doc_id", "text", weights, added=1.5).collect():
        assert (r["shard"], r["grown_shard"]) == (winner(r["key"], weights), winner(r["key"], [*weights, 1.5]))
        assert r["grown_shard"] in (r["shard"], 4)
