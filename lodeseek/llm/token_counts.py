"""Token counts by byte-pair merging with a heap and a linked list.

A word begins as a list of byte symbols, each linked to its neighbours. A heap holds the adjacent pairs that may merge, by rank and then place; the least is popped
again and again, entries whose pair is gone are passed over, and each merge puts the pairs with its neighbours on the heap. A word has as many tokens as it
had symbols, less its merges; no token identifier is put out. Counts of words are remembered, within bounds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, PLAIN_PATTERN, PLAIN_TEXT
from .common import column

#: Words of which a worker remembers the count, and the longest such word; beyond, it starts anew. Counts don't depend on it.
REMEMBERED, LONGEST = 500_000, 64
#: Bytes that a vocabulary's file may have to be sent to every executor.
LARGEST_VOCABULARY = 1 << 26


class Counts(dict):
    """Counts of words; one that is missing is counted and, if not long, remembered."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count_word(word)
        if len(word) <= LONGEST:
            self[word] = n
        return n


class Counter:
    """Counts the tokens of texts for a byte-level vocabulary, given as the text of its file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocabulary = spec["model"]["vocab"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(plain)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.start = [vocabulary[names[b]] for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocabulary[left] << 32 | vocabulary[right], (rank, vocabulary[left + right]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = frozenset(special)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.any_split, self.plain_split, self.plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall, re.compile(PLAIN_TEXT).fullmatch
        self.known = Counts(self)

    def count_word(self, word: str) -> int:
        symbols = [self.start[b] for b in word.encode()]
        n = len(symbols)
        if n < 2:
            return n
        pairs, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for at in range(n - 1):
            if found := pairs(symbols[at] << 32 | symbols[at + 1]):
                heap.append((found[0], at, found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, at, joined = pop(heap)
            other = after[at]
            if symbols[at] < 0 or other < 0:
                continue
            found = pairs(symbols[at] << 32 | symbols[other])
            if found is None or found[0] != rank:
                continue
            merges += 1
            symbols[at], symbols[other] = joined, -1
            after[at] = beyond = after[other]
            if beyond >= 0:
                before[beyond] = at
                if found := pairs(joined << 32 | symbols[beyond]):
                    push(heap, (found[0], at, found[1]))
            if (left := before[at]) >= 0 and (found := pairs(symbols[left] << 32 | joined)):
                push(heap, (found[0], left, found[1]))
        return n - merges

    def count(self, text: str | None) -> int:
        """The tokens of a whole text; null has none. Each string of a special token is one."""
        if not text:
            return 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if self.special and any(s in text for s in self.special):
            return sum(1 if part in self.special else self._plain(part) for part in self.apart(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        words = self.plain_split(text) if self.plain(text) else self.any_split(text)
        return sum(map(self.known.__getitem__, words))


@lru_cache(2)
def _counter(digest: str, raw: bytes) -> Counter:
    return Counter(raw)


def vocabulary(path: str | Path) -> bytes:
    """The file of a vocabulary, read where the driver runs; executors get it from there."""
    raw = Path(path).read_bytes()
    if len(raw) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} has more than {LARGEST_VOCABULARY} bytes")
    return raw


def count_tokens(df: DataFrame, raw: bytes, text: str = "text", out: str = "tokens") -> DataFrame:
    """df with a column `out` of longs: the tokens of each whole text by the vocabulary `raw`, without added special tokens, truncation or padding.

    Null and empty texts have none. Texts are counted whole; one word without a break takes memory in proportion to its length. Repeated rows get
    equal counts, an empty table gives an empty one; other columns stay as they are (one called like `out` is replaced).
    """
    spark: SparkSession = df.sparkSession
    shared, digest = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = _counter(digest, shared.value)
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return df.withColumn(out, counted(column(text)))
