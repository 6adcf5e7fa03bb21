"""BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary token can come last in its BPE encoding.  A suffix automaton of all
vocabulary tokens reads the pre-token: its state is the longest suffix read so far that occurs inside any token, and the tokens on
its suffix-link path that are no longer than that end there.  A token that starts at ``s`` is the last one iff it can
follow the last token of the prefix ``[0, s)``, that is, iff BPE of the two tokens' joined text gives just these two back.
That test undoes merges on both sides of the seam and asks at each step whether an earlier merge would have crossed it.
Back-pointers then give the ids, the same as merging gives.  As all this depends on the prefix alone, pre-tokens are read in
sorted order, and each goes on where it parts from the one before.

White-space-separated parts are encoded on their own (no normalisation or pre-token crosses ASCII white space) and
remembered; those not yet known are gathered from some megabytes of texts and encoded together, each distinct pre-token once.
Strings of special tokens inside a text become their ids first, as in the library.

Edge cases: null and empty texts have no ids and decode to the empty string; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.  Texts are streamed, so memory holds one batch, the distinct parts of one chunk of it and
the bounded stores.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Bounds of a worker's stores; each is emptied when full.
PARTS, PAIRS = 700_000, 2_000_000
#: Characters of the texts whose parts are encoded together; a longer text is a chunk of its own.
CHUNK = 8_000_000

_PRINTABLE = re.compile("[!-~]+")
# fixed value: the pre-tokeniser's pattern, as far as it concerns printable ASCII
_ASCII_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class SuffixAutomaton:
    """Suffix automaton of many strings; tells which of them end at each place of a text.

    States are numbered as they come; a transition's key is its state and its character in one number.
    """

    BITS = 21  # of a character

    def __init__(self, strings: dict[str, int]):
        self._go: dict[int, int] = {}
        self._out: list[list[int]] = [[]]  # characters with transitions, needed to copy a state
        self._link, self._length = [-1], [0]
        ends: dict[int, tuple[int, int]] = {}
        for text, value in strings.items():
            last = 0
            for c in map(ord, text):
                last = self._extend(last, c)
            ends[last] = (value, len(text))
        del self._out
        self.follow = self._go.get  # the next state for a state and a character, if the match goes on
        #: (value, length) of the strings that end where a state is reached, longest first; those longer than the match do not.
        self.endings: list[tuple[tuple[int, int], ...]] = [()] * len(self._link)
        for s in sorted(range(1, len(self._link)), key=self._length.__getitem__):
            above = self.endings[self._link[s]]
            self.endings[s] = (ends[s], *above) if s in ends else above

    def _extend(self, last: int, c: int) -> int:
        go, link, length, out, bits = self._go, self._link, self._length, self._out, self.BITS
        there = go.get(last << bits | c)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._copy(last, c, there)
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        out.append([])
        p = last
        while p >= 0 and (p << bits | c) not in go:
            go[p << bits | c] = new
            out[p].append(c)
            p = link[p]
        if p >= 0:
            q = go[p << bits | c]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, c, q)
        return new

    def _copy(self, p: int, c: int, q: int) -> int:
        """Split off the strings of state ``q`` that are no longer than the step from ``p``."""
        go, link, length, out, bits = self._go, self._link, self._length, self._out, self.BITS
        copy = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        out.append(list(out[q]))
        for x in out[q]:
            go[copy << bits | x] = go[q << bits | x]
        link[q] = copy
        while p >= 0 and go.get(p << bits | c) == q:
            go[p << bits | c] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that occurs in a string, after one more character."""
        go, link = self._go, self._link
        following = go.get(state << self.BITS | c)
        while following is None:
            if not state:
                return 0, 0
            state = link[state]
            size = self._length[state]
            following = go.get(state << self.BITS | c)
        return following, size + 1


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)  # its normaliser and pre-tokeniser prepare the parts
        self._normalize = library.normalizer.normalize_str
        self._pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.token_of = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        self._special_hint = next(iter(self._special))[:1]

        # Symbols: one character each; a byte character that ends a word has a symbol of its own.
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        made = {left + right for left, right in merges}
        symbols: dict[int, str] = {}
        for token, i in vocab.items():
            if token not in made:
                symbols[i] = self._last(token[: -len(suffix)]) if token.endswith(suffix) and len(token) > len(suffix) else token
        self._rank: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._age: dict[int, int] = {i: -1 for i in symbols}  # -1: a symbol, else the merge that makes it
        for rank, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self._rank.setdefault((a, b), rank)
            if c not in self._halves:
                self._halves[c], self._age[c], symbols[c] = (a, b), rank, symbols[a] + symbols[b]
        self._id_of = {s: i for i, s in symbols.items()}
        self._automaton = SuffixAutomaton(self._id_of)
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._falls: dict[int, tuple[int, int]] = {}  # state and size after a character that ends a state's match
        self._symbols = symbols
        self._told = {i: str(i) for i in self.token_of}
        self._parts: dict[bytes, tuple[str, str]] = {}

    @staticmethod
    def _last(chars: str) -> str:
        return chars[:-1] + chr(ord(chars[-1]) + 0x10000)

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined text is these two tokens."""
        age, halves, rank = self._age, self._halves, self._rank
        bound = 1 << 60  # merges from this one on come too late to cross the seam
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and crossing < bound:
                return False
            a, b = age[left], age[right]
            if a < 0 and b < 0:
                return True
            # Undo the younger of the two.  Of equal ages the left one was merged first, so the right one is undone
            # and the seam's merge must come before it or be its equal.
            if a > b:
                bound, left = a, halves[left][1]
            else:
                bound, right = b + 1, halves[right][0]

    def _stands(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self._own[token] = token not in self._halves or self._merged(self._symbols[token]) == [token]
        return known

    def _merged(self, text: str) -> list[int]:
        """BPE by merging; used only to see which tokens can stand alone."""
        ids = [self._id_of[c] for c in text]
        while True:
            best = min(((self._rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return ids
            k = best[1]
            ids[k : k + 2] = [self._id_of[self._symbols[ids[k]] + self._symbols[ids[k + 1]]]]

    def encode_pre_tokens(self, tokens: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The pre-tokens, given in byte characters, in sorted order, each with its ids."""
        step, endings, pairs, stands = self._automaton.step, self._automaton.endings, self._pairs, self._own
        follow, falls, bits = self._automaton.follow, self._falls, self._automaton.BITS
        # by the length of a prefix: the automaton's state and match, the last token and its length
        states, sizes, last, lengths = [0], [0], [-1], [0]
        previous = ""
        for chars in sorted(tokens):
            text = self._last(chars)
            shared = 0
            for a, b in zip(text, previous):
                if a != b:
                    break
                shared += 1
            previous = text
            if len(text) >= len(last):
                for of_prefix in (states, sizes, last, lengths):
                    of_prefix += [0] * len(text)
            state, size = states[shared], sizes[shared]
            for end, c in enumerate(map(ord, text[shared:]), shared + 1):
                following = follow(state << bits | c)
                if following is None:  # what comes then does not depend on the size
                    key = state << bits | c
                    fall = falls.get(key)
                    if fall is None:
                        if len(falls) >= PAIRS:
                            falls.clear()
                        fall = falls[key] = step(state, size, c)
                    state, size = fall
                else:
                    state, size = following, size + 1
                states[end], sizes[end], last[end] = state, size, -1
                for token, n in endings[state]:
                    if n > size:
                        continue
                    if n == end:
                        alone = stands.get(token)
                        if not (self._stands(token) if alone is None else alone):
                            continue
                    else:
                        before = last[end - n]
                        if before < 0:
                            continue
                        pair = before << 20 | token
                        fits = pairs.get(pair)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[pair] = self._fits(before, token)
                        if not fits:
                            continue
                    last[end], lengths[end] = token, n
                    break
            ids, end = [], len(text)
            while end:
                ids.append(last[end])
                end -= lengths[end]
            ids.reverse()
            yield chars, ids

    def _pieces(self, part: str) -> list[str]:
        """The special tokens and pre-tokens of a text of any kind."""
        out: list[str] = []
        for piece in self._special_re.split(part) if self._special_hint in part else (part,):
            if piece in self._special:
                out.append(piece)
            elif _PRINTABLE.fullmatch(piece):  # byte characters of these are themselves
                out += _ASCII_TOKEN.findall(piece.lower())
            elif piece:
                out += [chars for chars, _ in self._pre_tokenize(self._normalize(piece))]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token_of[i] for i in ids])

    def _learn(self, parts: set[bytes]) -> None:
        """See to it that the results of these parts are known."""
        known = self._parts
        fresh = parts.difference(known)
        if len(known) + len(fresh) > PARTS:
            known.clear()
            fresh = parts
        whole, cut = {}, {}  # a part of ASCII letters is one pre-token
        for raw in fresh:
            if raw.isalpha():
                whole[raw] = raw.lower().decode()
            else:
                cut[raw] = self._pieces(raw.decode())
        tokens = set(whole.values()).union(*cut.values()).difference(self._special)
        results = {t: (self._told[i], t) for t, i in self._special.items()}
        for chars, ids in self.encode_pre_tokens(tokens):
            results[chars] = " ".join([self._told[i] for i in ids]), self.decode(ids)
        for raw, chars in whole.items():
            known[raw] = results[chars]
        for raw, pieces in cut.items():
            got = [results[chars] for chars in pieces]
            known[raw] = got[0] if len(got) == 1 else (" ".join([p for p, _ in got]), " ".join([d for _, d in got]))

    def parts(self, text: str) -> list[tuple[str, str]]:
        """For each white-space-separated part that has ids: the ids in decimal and their decoded text."""
        raws = text.encode().split()
        self._learn(set(raws))
        return self._known(raws)

    def _known(self, raws: list[bytes]) -> list[tuple[str, str]]:
        return [got for got in map(self._parts.__getitem__, raws) if got[0]]

    def read(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """For each text: the ids in decimal and their decoded text."""
        chunk: list[str] = []
        parts: set[bytes] = set()
        size = 0
        for text in texts:
            chunk.append(text)
            parts.update(text.encode().split())
            size += len(text)
            if size >= CHUNK:
                yield from self._read(chunk, parts)
                chunk, parts, size = [], set(), 0
        yield from self._read(chunk, parts)

    def _read(self, chunk: list[str], parts: set[bytes]) -> Iterator[tuple[str, str]]:
        self._learn(parts)
        for text in chunk:
            got = self._known(text.encode().split())
            yield " ".join([p for p, _ in got]), " ".join([d for _, d in got])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids and their decoded text for each document."""
    path = path or _default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids, decoded = [], []
            for told, read in bpe.read(text.as_py() or "" for text in b.column(1)):
                ids.append(list(map(int, told.split())))
                decoded.append(read)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, told, read = [], [], []
            for ids, decoded in bpe.read(text.as_py() or "" for text in b.column(1)):
                n.append(ids.count(" ") + 1 if ids else 0)
                told.append(hashlib.sha256(ids.encode()).hexdigest())
                read.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(read, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
