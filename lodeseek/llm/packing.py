"""Best-fit packing into sequences of several permitted lengths.

Texts are measured in words (or by a column) and cut at the largest length. Rows are dealt into shards of a bounded number of rows and characters, each packed
on its own: longest pieces first, each into the open bin that it leaves least room in; where none has room, a bin is
opened whose capacity costs least for each word that it may be expected to hold; at the end each bin shrinks to the smallest permitted
length that holds its contents. How full a new bin is expected to get, and up to which length bins are opened, decides how the permitted lengths work together:
each shard is packed under several such policies, and the one of least total cost counts. The number of shards follows the table, so tasks keep their size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, words_of

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, and the share of a new bin's remaining room that is expected to be used.
OVERHEAD = 32
EXPECTED_FILL = 0.9
#: Shares that are tried besides, each with all lengths and with the largest alone.
FILLS = (0.5, 0.75, 0.9, 0.97, 1.0)
ROWS_PER_SHARD = 1024
CHARS_PER_SHARD = 16 << 20

SCHEMA = "doc_id long, piece int, begin long, length long, bin string, capacity int, offset int"


def opening(length: int, capacities: tuple[int, ...], overhead: float, fill: float) -> int:
    """The capacity to open for a piece: least cost for each word expected in it; of equals the smallest."""
    return min((c for c in capacities if c >= length), key=lambda c: ((c + overhead) / (length + fill * (c - length)), c))


def pack_pieces(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, fill: float = EXPECTED_FILL) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and its offset there, and for each bin its final capacity. Lengths are 0 to the largest capacity."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            left, b = opening(lengths[i], capacities, overhead, fill), len(used)
            used.append(0)
        else:
            left, b = room.pop(at)
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        insort(room, (left - lengths[i], b))
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used]


def total_cost(capacities: list[int], overhead: float) -> float:
    return sum(capacities) + overhead * len(capacities)


def pack_jointly(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, fills: tuple[float, ...] = FILLS) -> tuple[list[int], list[int], list[int]]:
    """As pack_pieces, by the policy of least total cost; of equals the first. Every policy may shrink bins to any permitted length."""
    tried = [pack_pieces(lengths, capacities, overhead, f) for f in fills]
    bins, offsets, full = pack_pieces(lengths, capacities[-1:], overhead, 1.0)
    used = [0] * len(full)
    for b, n in zip(bins, lengths, strict=True):
        used[b] += n
    tried.append((bins, offsets, [min(c for c in capacities if c >= u) for u in used]))
    return min(tried, key=lambda t: total_cost(t[2], overhead))


def cut_lengths(length: int, most: int) -> list[int]:
    """A text's pieces: full ones, then the rest; an empty text is one empty piece."""
    return [most] * (length // most) + ([length % most] if length % most or not length else [])


def _slices(text: str, sizes: list[int]) -> list[str]:
    """The text cut before the first word of each piece after the first; joined they are the text."""
    if len(sizes) == 1:
        return [text]
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    at = [0, *(starts[i] for i in accumulate(sizes[:-1])), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def _packer(capacities, overhead, fills, with_text: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n", "text"] if with_text else ["doc_id", "n"], kind="stable", na_position="first")
        most, out, sizes = max(capacities), [], []
        for row in rows.itertuples(index=False):
            begin, sized = 0, cut_lengths(int(row.n), most)
            parts = _slices(row.text or "", sized) if with_text else None
            for k, size in enumerate(sized):
                out.append((None if pd.isna(row.doc_id) else int(row.doc_id), k, begin, size) + ((parts[k],) if with_text else ()))
                sizes.append(size)
                begin += size
        bins, offsets, capacity = pack_jointly(sizes, capacities, overhead, fills)
        table = pd.DataFrame(out, columns=["doc_id", "piece", "begin", "length"] + ["text"] * with_text)
        table["doc_id"] = table["doc_id"].astype("Int64")
        return table.assign(bin=[f"{key[0]}-{b}" for b in bins], capacity=[capacity[b] for b in bins], offset=offsets)

    return pack


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: str | None = None, with_text: bool = False, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, fills: tuple[float, ...] = FILLS, rows_per_shard: int = ROWS_PER_SHARD, chars_per_shard: int = CHARS_PER_SHARD) -> DataFrame:
    """One row for each piece of each row of df: doc_id, piece, begin, length, bin, capacity, offset, and its text with with_text.

    Lengths are numbers of words, or the column `length` (null and below 0: 0; not together with with_text). Null and empty texts are one
    piece of length 0, which takes a place in a bin like others. Repeated rows are packed as often as they stand; a null doc_id stays null.
    Bins of equal room are taken in order of opening, pieces of equal length in order of doc_id. Rows are dealt to shards by their place in the table, so that
    no id, null or repeated, fills one; a table read in other partitions may be packed otherwise. A very long text makes its shard long, and no other. An empty
    table gives no bins. Only the id and the length are shuffled, with with_text the texts too, cut at words; a text's pieces joined are the text. Other
    columns aren't used, whatever their names.
    """
    size = F.sum(F.length(column(text))) if with_text else F.lit(0)
    rows, chars = df.agg(F.count(F.lit(1)), size).first()
    shards = max(1, -(-rows // rows_per_shard), -(-(chars or 0) // chars_per_shard))
    words = words_of(column(text))
    n = F.greatest(F.coalesce(column(length), F.lit(0)).cast("long"), F.lit(0)) if length else F.size(words).cast("long")
    rows = df.select(column(doc_id).cast("long").alias("doc_id"), n.alias("n"), *([column(text).alias("text")] if with_text else []), F.monotonically_increasing_id().alias("place"))
    schema = SCHEMA.replace("length long,", "length long, text string,") if with_text else SCHEMA
    return rows.groupBy(F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard")).applyInPandas(_packer(tuple(sorted(capacities)), overhead, fills, with_text), schema)
