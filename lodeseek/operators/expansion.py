"""Words of queries looked up in copies of the synonyms: what is found is made within each query's row and never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens after which a batch of results ends, but for those of its last query, and queries whose words are looked up together.
BATCH_TOKENS, TOGETHER = 1 << 19, 256
LISTS = pa.schema([("alias", pa.string()), ("list", pa.int32()), ("canonicals", pa.list_(pa.string()))])


def _firsts(values: np.ndarray, scratch: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """The distinct values in the order of their first places, without some. scratch has a place for each possible value."""
    at = np.arange(len(values))
    scratch[values[::-1]] = at[::-1]  # of equal values the last assignment stays, which is the first place
    if without is not None:
        scratch[without] = -1
    return values[scratch[values] == at]


class Synonyms:
    """Canonicals of aliases, as numbers: those of one alias stand together, in order."""

    def __init__(self, parts: list[pa.StructArray]):
        """parts: rows of alias, list (its number) and canonicals."""
        lists = pa.Table.from_batches([pa.RecordBatch.from_arrays(p.flatten(), schema=LISTS) for p in parts], LISTS).sort_by([("alias", "ascending"), ("list", "ascending")])
        held = lists["canonicals"].combine_chunks()
        names = pc.list_flatten(held).dictionary_encode()
        self.names, self.codes = names.dictionary, names.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False), dtype=np.int64)
        aliases = lists["alias"].combine_chunks().dictionary_encode()  # lists of an alias are neighbours
        self.ends = ends[np.searchsorted(aliases.indices.to_numpy(zero_copy_only=False), np.arange(len(aliases.dictionary)), "right") - 1]
        self.begins = np.concatenate([[0], self.ends])[: len(self.ends)]
        self.words: dict[str, int] = {}
        number, said = lambda word: self.words.setdefault(word, len(self.words)), aliases.dictionary.to_pylist()
        each = [tuple(map(number, alias.split(" "))) for alias in said]
        canonicals = [number(name) for name in self.names.to_pylist()]
        self.alias_of, self.name_of = np.full((2, len(self.words) + 1), -1)  # the last for words that no synonym has
        self.name_of[canonicals] = np.arange(len(canonicals))
        pairs = []
        for n, words in enumerate(each):
            if len(words) == 1:
                self.alias_of[words[0]] = n
            elif len(words) == 2:  # longer ones are no alias of words or pairs
                pairs.append((words[0] * len(self.words) + words[1], n))
        self.pairs, self.alias_of_pair = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self._alias_scratch, self._name_scratch = np.zeros(len(said), np.int64), np.zeros(len(canonicals), np.int64)

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        distinct, number, unknown = words.dictionary_encode(), self.words.get, len(self.words)
        known = np.array([number(w, unknown) for w in distinct.dictionary.to_pylist()], np.int64)
        return known[distinct.indices.to_numpy(zero_copy_only=False)]

    def of_pairs(self, words: np.ndarray) -> np.ndarray:
        """For each word but the last the alias that it is with the next, or -1."""
        out = np.full(max(len(words) - 1, 0), -1)
        if len(self.pairs):
            at = np.flatnonzero((words[:-1] < len(self.words)) & (words[1:] < len(self.words)))
            key = words[at] * len(self.words) + words[at + 1]
            met = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[at] = np.where(self.pairs[met] == key, self.alias_of_pair[met], -1)
        return out

    def added(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The canonicals of words and adjacent pairs that aren't words already, in the order of their first alias, each once."""
        aliases = np.concatenate([self.alias_of[words], pairs])
        aliases = _firsts(aliases[aliases >= 0], self._alias_scratch)
        if not len(aliases):
            return self.codes[:0]
        said = self.name_of[words]
        codes = np.concatenate([self.codes[b:e] for b, e in zip(self.begins[aliases].tolist(), self.ends[aliases].tolist())])
        return _firsts(codes, self._name_scratch, said[said >= 0])


def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, lists, query) of a partition: first chunks of the synonyms' lists, each counted once, then queries, which get their tokens."""
    parts: dict[int, pa.StructArray] = {}
    synonyms = None
    for batch in batches:
        is_query = batch.column("chunk").is_null()
        held = batch.filter(pc.invert(is_query))
        for chunk, lists in zip(held.column("chunk").to_pylist(), held.column("lists"), strict=True):
            if synonyms is not None:
                raise ValueError("synonyms after queries")
            parts.setdefault(chunk, lists.values)
        queries = batch.filter(is_query).column("query")
        if len(queries):
            synonyms = synonyms or Synonyms(list(parts.values()))
            parts.clear()
            for begin in range(0, len(queries), TOGETHER):
                yield from _with_tokens(queries.slice(begin, TOGETHER), synonyms)


def _with_tokens(queries: pa.StructArray, synonyms: Synonyms) -> Iterator[pa.RecordBatch]:
    columns, names = queries.flatten(), [*(f.name for f in queries.type), "tokens"]
    split = pc.split_pattern(columns[names.index("normalized")], " ")
    words, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    kept = pc.not_equal(words, "")
    words, row = words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
    numbers = synonyms.numbers(words)
    pairs, ends = synonyms.of_pairs(numbers), np.searchsorted(row, np.arange(len(queries)), "right").tolist()
    begin, parts, sizes, of_words = 0, [], [0], 0
    for i, end in enumerate(ends):
        new = synonyms.added(numbers[of_words:end], pairs[of_words : max(of_words, end - 1)])
        parts += [np.arange(of_words, end), new.astype(np.int64) + len(words)]
        sizes.append(sizes[-1] + end - of_words + len(new))
        of_words = end
        if sizes[-1] >= BATCH_TOKENS or i + 1 == len(ends):
            values = pa.concat_arrays([words, synonyms.names]).take(pa.array(np.concatenate(parts)))
            tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=split.slice(begin, i + 1 - begin).is_null())
            yield pa.RecordBatch.from_arrays([*(c.slice(begin, i + 1 - begin) for c in columns), tokens], names)
            begin, parts, sizes = i + 1, [], [0]
