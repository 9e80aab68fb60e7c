"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into words by the vocabulary's pattern. The distinct words of a batch go into a trie of bytes in sorted order,
which is the trie's depth-first order. A node holds the last token of its prefix's encoding: the one token that ends there and may follow the
last token of what stands before it. So each prefix that words share is encoded once, and the encoding of a word is read
backwards from its node. An automaton of all tokens gives those that end at a node. Two tokens may stand side by side if merging their bytes
gives just these two again. Decoding joins the bytes of tokens and replaces what isn't UTF-8.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column as _column

#: Fixed value: the pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII and Latin-1 letters alone, for which the standard library's engine is faster.
_LETTERS = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF"
PLAIN_TEXT = rf"[\t\n\r\x20-\x7E{_LETTERS}]*"
PLAIN_PATTERN = rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t\n\r\x20{_LETTERS}0-9]+|[\t\n\r\x20]+(?![^\t\n\r\x20])|[\t\n\r\x20]+"
#: Words, their bytes, and pairs of tokens that a worker remembers; beyond, it starts anew. Results don't depend on it.
REMEMBERED_WORDS, REMEMBERED_BYTES = 400_000, 1 << 25
REMEMBERED_PAIRS = 1_000_000
#: Bytes of words in one trie; a longer word has one of its own.
TRIE_BYTES = 1 << 20


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@contextmanager
def _without_cycle_search():
    """Python's search for cycles of garbage pauses: what is made here has none, and the remembered words are costly to walk."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_names()
        raw = lambda name: bytes(byte[c] for c in name)
        self.ids = {raw(name): i for name, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.rank_of = {(self.ids[a], self.ids[b]): r for (a, b), r in self.ranks.items()}
        self.halves = {self.ids[a + b]: (self.ids[a], self.ids[b], r) for (a, b), r in sorted(self.ranks.items(), key=lambda x: -x[1])}
        self.spines: tuple[dict, dict] = {}, {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self._automaton()
        self.any_split, self.plain_split, self.plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall, re.compile(PLAIN_TEXT).fullmatch
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.words: dict[str, tuple[str, bytes]] = {}
        self.held = 0
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """The encoding by definition: merge the pair of least rank, the first of equals, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge (0: left, 1: right) of a token while it is built, each with the rank of the merge that takes it up."""
        found = self.spines[side].get(token)
        if found is None:
            found, taken, part = [], len(self.ranks), token
            while True:
                found.append((part, taken))
                halves = self.halves.get(part)
                if halves is None:
                    break
                part, taken = halves[side], halves[2]
            self.spines[side][token] = found = found[::-1]
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """May token b follow token a? -1 as a stands for the start of a word.

        While both are built, only the tokens at their common edge could merge across it: they do so if that merge comes before
        those that take them up. Of equal merges the left one comes first.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        if a < 0:
            known = self.merged(self.bytes_of[b]) == [b]
        else:
            left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
            known = True
            while True:
                (x, up_x), (y, up_y) = left[i], right[j]
                across = self.rank_of.get((x, y))
                if across is not None and across < up_x and across <= up_y:
                    known = False
                    break
                if up_x <= up_y:
                    i += 1
                else:
                    j += 1
                if i == len(left) or j == len(right):
                    break
        self.pairs[a, b] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words by way of one trie.

        The tokens that end a prefix are listed with the state that an automaton of all tokens (Aho-Corasick) is in at its end; the
        longest that may follow is the one.
        """
        if len(self.moves) > len(self.edges) + REMEMBERED_PAIRS:
            self.moves = dict(self.edges)
        child: dict[int, int] = {}
        last, before, states = [-1], [0], [0]
        moves, ending, adjacent, pairs = self.moves.get, self.ending, self.adjacent, self.pairs.get
        out = {}
        for word in sorted(words):
            node, path = 0, [0]
            for end, byte in enumerate(word, 1):
                key = node << 8 | byte
                found = child.get(key)
                if found is None:
                    state = moves(states[node] << 8 | byte)
                    if state is None:
                        state = self.move(states[node], byte)
                    for size, token in ending[state]:
                        begin = path[end - size]
                        a = last[begin]
                        ok = pairs((a, token))
                        if ok or ok is None and adjacent(a, token):
                            break
                    else:
                        raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
                    found = child[key] = len(last)
                    last.append(token)
                    before.append(begin)
                    states.append(state)
                node = found
                path.append(node)
            tokens = []
            while node:
                tokens.append(last[node])
                node = before[node]
            out[word] = tokens[::-1]
        return out

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest end of what was read that begins a token. Remembered."""
        at = state
        while (found := self.edges.get(at << 8 | byte)) is None and at:
            at = self.fails[at]
        self.moves[state << 8 | byte] = found = found or 0
        return found

    def _automaton(self) -> None:
        """States are the beginnings of tokens, the root is 0: edges by state and byte, the state of the longest other end of each,
        and the tokens that end there (size, token), longest first."""
        self.edges: dict[int, int] = {}
        self.fails, whole, level = [0], [None], []
        for raw, token in sorted(self.ids.items()):
            state = 0
            for depth, byte in enumerate(raw):
                key = state << 8 | byte
                found = self.edges.get(key)
                if found is None:
                    found = self.edges[key] = len(whole)
                    whole.append(None)
                    self.fails.append(0)
                    level.append((depth, state, byte, found))
                state = found
            if raw:
                whole[state] = (len(raw), token)
        self.ending: list[tuple] = [()] * len(whole)
        for depth, parent, byte, state in sorted(level):
            at = parent
            while depth and at:
                at = self.fails[at]
                if (found := self.edges.get(at << 8 | byte)) is not None:
                    self.fails[state] = found
                    break
            rest = self.ending[self.fails[state]]
            self.ending[state] = (whole[state], *rest) if whole[state] else rest
        self.moves = dict(self.edges)

    def split(self, text: str) -> list[str]:
        return self.plain_split(text) if self.plain(text) else self.any_split(text)

    def cut(self, text: str | None) -> list[str]:
        """The words of a text; the strings of special tokens stand alone."""
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self.split(text)
        return [w for part in self.apart(text) for w in ([part] if part in self.special else self.split(part))]

    def remember(self, word: str, tokens: list[int]) -> None:
        raw = b"".join([self.bytes_of[t] for t in tokens])
        self.words[word] = ",".join([self.names[t] for t in tokens]), raw
        self.held += len(raw)

    @_without_cycle_search()
    def look_up(self, cut: list[list[str]]) -> list[list[tuple[str, bytes]]]:
        """For each word of each text its ids joined by commas and the bytes that these decode to."""
        if len(self.words) > REMEMBERED_WORDS or self.held > REMEMBERED_BYTES:
            self.words.clear()
            self.held = 0
        known = self.words.get
        found = [[known(w) for w in words] for words in cut]
        partly = [i for i, parts in enumerate(found) if None in parts]
        fresh = {w for i in partly for w, p in zip(cut[i], found[i], strict=True) if p is None}
        for run in _tries(sorted(w.encode() for w in fresh if w not in self.special)):
            for w, tokens in self.encode_words(run).items():
                self.remember(w.decode(), tokens)
        for w in fresh & self.special.keys():
            self.remember(w, [self.special[w]])
        for i in partly:
            found[i] = [known(w) for w in cut[i]]
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for ids, _ in parts for i in ids.split(",")] for parts in self.look_up([self.cut(t) for t in texts])]

    def decode(self, tokens: Iterable[int]) -> str:
        return b"".join([self.bytes_of[t] for t in tokens]).decode("utf-8", "replace")

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens and the SHA-256 of the ids joined by commas and of the decoded text."""
        out = []
        for parts in self.look_up([self.cut(t) for t in texts]):
            ids = ",".join([p[0] for p in parts])
            text = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
            out.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


@lru_cache(2)
def codec(path: str) -> ByteBpe:
    """One for each worker process, which tasks there share. The vocabulary must be at this path on every executor."""
    return ByteBpe(path)


def _tries(words: list[bytes]):
    """Runs of sorted words, each the words of one trie; words that share a prefix stay side by side."""
    run, size = [], 0
    for w in words:
        if run and size + len(w) > TRIE_BYTES:
            yield run
            run, size = [], 0
        run.append(w)
        size += len(w)
    if run:
        yield run


#: Characters of texts cut at once.
AT_ONCE = 1 << 21


def _runs(texts: list[str | None]):
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > AT_ONCE:
            yield run
            run, size = [], 0
    yield run


def encode(text: Column, path: str) -> Column:
    """The token ids of a text, array<int>; null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def encoded(column: pd.Series) -> pd.Series:
        return pd.Series([ids for run in _runs(list(column)) for ids in codec(path).encode(run)], dtype=object)

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; null and empty arrays give an empty text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return pd.Series([codec(path).decode(() if x is None else map(int, x)) for x in column], dtype=object)

    return decoded(ids)


def digest(df: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """df with a struct column `out`: n_tokens, ids_sha256, decoded_sha256 of encoding every whole text and decoding it again.

    Null is as the empty text: no tokens, and the digests of nothing. Long texts are encoded whole, in memory that grows with the text and its longest
    word; repeated rows get equal results, an empty table gives an empty one; other columns stay as they are (one called like `out` is replaced).
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(column: pd.Series) -> pd.DataFrame:
        rows = [row for run in _runs(list(column)) for row in codec(path).digests(run)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn(out, digested(_column(text)))
