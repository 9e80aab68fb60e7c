"""Near-duplicate detection by bottom-k sketches of one hash function.

A text's set is that of its word shingles, hashed to 64 bits; its sketch is the k least hashes. Texts with equal sets collapse to one
representative first, by a digest of the set. Then:

1. Inverted lists: a pair whose estimate passes shares `need` of a sketch's values, so it shares one of the size - need + 1 rarest of either
   (values are ordered by the number of sketches that retain them, the same order everywhere). Only these enter the lists: a passage that
   many unlike texts share fills no list, unless it is most of a text.
2. Each list has a leader, the member whose values are most common, and all members meet it. Each pair is estimated from the sketch of
   its union (of the k least values of both, the share that both have), and what may be similar is verified with the exact Jaccard
   similarity of the full sets. Links give components.
3. In lists with several components, members apart from the largest one meet all members of other components: in short lists as pairs, in
   long ones in blocks of bounded size that carry the full sets. A block estimates, verifies, and lets out only the links that
   join components there, fewer than it has rows.
4. Links of both rounds give the final components.

No group is expanded into all pairs, and no list is cut. The joins have an exchange on either side, so that adaptive execution splits hot values.
The estimate may fall short of the similarity by four and a half standard deviations; with k=None sketches are whole sets and the result is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, discard, materialize

SHINGLE_WORDS = 5
#: Similarity as a share of 100.
PERCENT = 80
SKETCH = 32
#: Standard deviations by which the estimate may fall short.
DEVIATIONS = 4.5
#: Lists of more members meet in blocks, of about so many rows and shingles.
SHORT = 16
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Columns of the matrices that blocks count common shingles with, and pairs that they estimate at once.
WIDTH, AT_ONCE = 8192, 32_768
PADDING = np.iinfo(np.int64).max

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of `size` words; fewer words are one shingle, no words none.

    A-Z are lower-cased, words are runs of characters other than white space.
    """
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            out.append(np.zeros(0, np.int64))
            continue
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(size, len(h))
        m = len(h) - n + 1
        mixed = np.full(m, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ h[i : i + m]) * _M1
            mixed ^= mixed >> np.uint64(32)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _M2
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _M3
        out.append(np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64)))
        if len(known) > 500_000:
            known.clear()
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    hi, lo = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(hi), int(lo)


def _place(doc_id: str, text: str) -> Column:
    """What finds a row's text again: a hash of its id and text."""
    return F.xxhash64(column(doc_id).cast("long"), column(text))


def _sketched(df: DataFrame, doc_id: str, text: str, size: int, k: int | None) -> DataFrame:
    @F.pandas_udf("n long, hi long, lo long, sketch array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), *_digest(s), s[:k]) for s in shingle_sets(list(texts), size)]
        return pd.DataFrame(rows, columns=["n", "hi", "lo", "sketch"])

    return df.select(column(doc_id).cast("long").alias("doc_id"), _place(doc_id, text).alias("place"), sketched(column(text)).alias("s")).select("doc_id", "place", "s.*")


def _sets(df: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(id, set) of the wanted (id, place, hi, lo). A row that stands more than once gives its set once."""

    @F.pandas_udf("hi long, lo long, set array<long>")
    def full(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*_digest(s), s) for s in shingle_sets(list(texts), size)], columns=["hi", "lo", "set"])

    # Not deterministic to the optimizer: else it makes the digests a condition of the join, and works out the sets of all texts for it.
    full = full.asNondeterministic()
    texts = df.select(_place(doc_id, text).alias("place"), column(text).alias("text")).join(wanted, "place")
    once = texts.groupBy("place", "id", "hi", "lo", F.hash("text").alias("other")).agg(F.first("text").alias("text"))
    return once.select("id", "hi", "lo", full(F.col("text")).alias("s")).where("s.hi = hi and s.lo = lo").select("id", "s.set")


def _least_estimate(percent: int, k: int | None) -> float:
    """The least estimate that may stand for the wanted similarity."""
    p = percent / 100
    return p if k is None else max(1 / k, p - DEVIATIONS * (p * (1 - p) / k) ** 0.5)


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, k: int | None) -> DataFrame:
    """The pairs (a, b) whose exact similarity is enough: estimated first, then verified on full sets."""
    one, two = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.sort_array(F.array_union("sa", "sb"))
    near = near.withColumn("union", union if k is None else F.slice(union, 1, k))
    estimate = F.size(F.array_intersect(F.array_intersect("union", "sa"), F.col("sb"))) / F.size("union")
    near = materialize(near.where(estimate >= _least_estimate(percent, k) - 1e-9).select("a", "b", "na", "nb"), "near")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    links = materialize(both.select("a", "b", "na", "nb", common.alias("c")).where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b"), "links")
    discard(near)
    return links


class _Side:
    """One side of a meeting: ids, components, sets (as one array of values with the row of each), and values of earlier lists."""

    def __init__(self, rows: pa.StructArray, k: int):
        ids, comps, sets, earlier = rows.flatten()
        self.ids, self.comps = ids.to_numpy(), comps.to_numpy()
        self.sizes = pc.list_value_length(sets).to_numpy().astype(np.int64)
        self.values, self.rows = sets.flatten().to_numpy(), np.repeat(np.arange(len(ids)), self.sizes)
        self.earlier = earlier.flatten().to_numpy(), np.repeat(np.arange(len(ids)), pc.list_value_length(earlier).to_numpy())
        self.table = np.full((len(ids), k), PADDING)
        starts = np.cumsum(self.sizes) - self.sizes
        for j in range(min(k, int(self.sizes.max()))):
            has = self.sizes > j
            self.table[has, j] = self.values[starts[has] + j]


def _common(one: tuple, many: tuple, n_one: int, n_many: int) -> np.ndarray:
    """How many values each row of one has in common with each row of many; both are (values, rows)."""
    counts = np.zeros((n_one, n_many))
    known = np.intersect1d(one[0], many[0])
    places = []
    for values, rows in (one, many):
        at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        there = known[at] == values if len(known) else np.zeros(len(values), bool)
        places.append((at[there], rows[there]))
    for a in range(0, len(known), WIDTH):
        width = min(WIDTH, len(known) - a)
        flags = []
        for (at, rows), n in zip(places, (n_one, n_many), strict=True):
            inside = (at >= a) & (at < a + width)
            flag = np.zeros((n, width), np.float32)
            flag[rows[inside], at[inside] - a] = 1
            flags.append(flag)
        counts += flags[0] @ flags[1].T
    return counts


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each pair of padded sketches the share of the union's sketch that both have."""
    k = one.shape[1]
    both = np.sort(np.concatenate([one, many], 1), 1)
    real = both != PADDING
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, 1)
    return (again & (rank <= k)).sum(1) / np.minimum(rank[:, -1], k)


def _meeting(one: _Side, many: _Side, percent: int, least: float) -> list[tuple[int, int]]:
    """Links of rows of one with rows of many in other components, enough to join whatever all such links join."""
    sizes = one.sizes[:, None], many.sizes[None]
    open_ = (one.comps[:, None] != many.comps[None]) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
    open_ &= _common(one.earlier, many.earlier, len(one.ids), len(many.ids)) == 0
    a, b = np.nonzero(open_)
    fits = [_estimates(one.table[a[i : i + AT_ONCE]], many.table[b[i : i + AT_ONCE]]) >= least - 1e-9 for i in range(0, len(a), AT_ONCE)]
    if not fits:
        return []
    fits = np.concatenate(fits)
    a, b = a[fits], b[fits]
    if not len(a):
        return []
    common = _common((one.values, one.rows), (many.values, many.rows), len(one.ids), len(many.ids))[a, b]
    true = 100 * common >= percent * (one.sizes[a] + many.sizes[b] - common)
    a, b = a[true], b[true]
    _, first = np.unique(np.stack([one.comps[a], many.comps[b]]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in first:
        x, y = find(int(one.comps[a[i]])), find(int(many.comps[b[i]]))
        if x != y:
            root[x] = y
            out.append((int(one.ids[a[i]]), int(many.ids[b[i]])))
    return out


def _blocks(entries: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(v, name): the entries (v, id, n, comp, earlier) of each list with their sets, in blocks of bounded size."""
    sizes = entries.groupBy(F.col("v").alias("u")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = entries.join(sizes, F.col("v") == F.col("u")).join(sets, "id")
    return dealt.groupBy("v", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list(F.struct("id", "comp", "set", "earlier")).alias(name)).select("v", name)


def _joined_in_blocks(strays: DataFrame, members: DataFrame, sets: DataFrame, percent: int, k: int | None) -> DataFrame:
    """Links (a, b) between strays and members of other components in the same long list: each block of strays meets each block of members."""
    least = _least_estimate(percent, k)

    def meet(batches):
        for batch in batches:
            links = []
            for ones, many in zip(batch.column(0), batch.column(1), strict=True):
                ones, many = ones.values, many.values
                width = k or max(1, *(int(pc.max(pc.list_value_length(x.flatten()[2])).as_py()) for x in (ones, many)))
                links += _meeting(_Side(ones, width), _Side(many, width), percent, least)
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return _blocks(strays, sets, "ones").join(_blocks(members, sets, "many"), "v").select("ones", "many").mapInArrow(meet, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    """(id, comp) of the representatives with links."""
    return connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("comp"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = SHINGLE_WORDS, percent: int = PERCENT, k: int | None = SKETCH) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * shared shingles >= percent * shingles of either. component_id is the least id reachable over links, the row's own
    included, and kept whether the row has that id. Rows are told apart by their texts: repeated rows are returned as often as they stand, with equal
    results; rows of one id with different texts aren't linked by their id. A row without an id counts as a link between others; its own component_id is null, and
    it isn't kept. Empty and null texts have no shingles and are linked with nothing, so each is its own component. An empty table
    gives no rows. Texts of any length are compared whole. Other columns aren't used, whatever their names.
    """
    sketched = materialize(_sketched(df, doc_id, text, size, k), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    reps = sketched.where("n > 0").groupBy("hi", "lo", "n").agg(first, F.count(F.lit(1)).alias("rows"), F.first("sketch").alias("sketch"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "n", "first.doc_id", "first.place", "rows", "sketch"), "reps")

    values = reps.select("id", "n", F.explode("sketch").alias("v"))
    counts = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    shared = values.join(counts, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("m", "v"))).alias("shared"))
    retained = F.col("n") if k is None else F.least("n", F.lit(k))
    # Values that nobody shares are the rarest, and take their places among the size - need + 1 too.
    taken = F.size("shared") + 1 - F.ceil(retained * _least_estimate(percent, k) - 1e-9)
    traits = shared.where(taken > 0).select("id", "n", F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["m"]).alias("fame"), F.slice(F.transform("shared", lambda x: x["v"]), F.lit(1), taken.cast("int")).alias("vs"))
    traits = materialize(traits, "traits")
    discard(counts)
    index = traits.select("id", "n", "fame", F.posexplode("vs").alias("at", "v"), "vs")
    lists = materialize(index.groupBy("v").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    entries = materialize(index.join(lists, "v").select("v", "id", "n", "leader", "m", F.slice("vs", F.lit(1), F.col("at")).alias("earlier")), "entries")
    discard(traits)
    discard(lists)
    wanted = entries.select("id").distinct()
    sets = materialize(_sets(df, doc_id, text, size, reps.select("id", "place", "hi", "lo").join(wanted, "id", "left_semi")), "sets")
    stars = entries.where("id <> leader").select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    links = _linked(stars, reps, sets, percent, k)
    comps = _components(links)

    members = entries.join(comps, "id", "left").select("v", "id", "n", "m", "earlier", F.coalesce("comp", "id").alias("comp"))
    shares = members.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("v").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("largest"), F.count(F.lit(1)).alias("comps"))
    members = materialize(members.join(shares.where("comps > 1"), "v").drop("comps"), "members")
    discard(entries)
    discard(comps)
    gathered = members.where(f"m <= {SHORT}").groupBy("v").agg(F.collect_list(F.struct("id", "comp")).alias("all"))
    short = gathered.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    short = short.where("x.comp <> y.comp and x.id > y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    short = _linked(short, reps, sets, percent, k)
    long = members.where(f"m > {SHORT}")
    blocks = materialize(_joined_in_blocks(long.where("comp <> largest"), long, sets, percent, k), "blocks")
    comps = _components(links.union(short).union(blocks))
    for old in (members, sets, links, short, blocks):
        discard(old)

    # Classes of several rows, or linked with others; all other rows are their own components.
    least = comps.join(reps.select("id", "doc_id"), "id").groupBy("comp").agg(F.min("doc_id").alias("least"))
    grouped = reps.select("id", "hi", "lo", "rows", "doc_id").join(comps, "id", "left").join(least, "comp", "left").where("rows > 1 or comp is not null")
    grouped = materialize(grouped.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"), F.lit(True).alias("known")), "grouped")
    rows = materialize(sketched.select("doc_id", "n", "hi", "lo"), "rows")
    for old in (reps, comps, sketched):
        discard(old)
    worded = rows.where("n > 0").join(grouped, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    component = F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id"))
    out = worded.select("doc_id", "n", component.alias("component")).union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False)).alias("kept"))
