"""Line dedup: repeated runs of lines by a suffix array over sequences of line ids.

A text's lines with a word are a sequence; lines without one take no part. Distributed prefix doubling ranks the suffixes of all sequences: the rank of a
position at depth 1 is that of its line, and at depth 2d that of the pair of ranks at depth d of the position and of the one d lines
on (once the depth is that of the shortest run that counts, it is exactly doubled). Distinct pairs are sorted by range over the cluster and numbered in that
order, so equal ranks are the suffix array's intervals of a common prefix of at least that depth. Positions alone in their interval leave the table;
doubling ends when none is left. The deepest interval in which a position is a later one names its source, the interval's first position. Where the source
of a position doesn't follow that of the position before, a run begins; the exact length of the common prefix of both is found by descending the ranks from
the deepest to single lines. Runs within another run of their text are dropped, the rest are the maximal runs. Their lines are deleted, but for those that
belong to the first copy too, where both overlap in one text. A single long line is a run too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, free_prefix, materialize

#: Least number of lines of a run, and least number of characters of a single line that counts as one.
MIN_LINES = 3
MIN_CHARS = 40

def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _same_place(x: str, y: str) -> Column:
    return F.col(f"{x}.doc").eqNullSafe(F.col(f"{y}.doc")) & (F.col(f"{x}.th") == F.col(f"{y}.th")) & (F.col(f"{x}.i") == F.col(f"{y}.i"))


def sequences(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each line with a word: doc, th, i (its place among these), pos (its place among all lines), a and b (128 bits of hash), chars."""
    hashed = lambda x, pos: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(x).alias("chars"), pos.alias("pos"))
    line = F.transform(F.split(column(text), "\n"), lambda x, pos: F.when(_has_word(x), hashed(x, pos)))
    rows = df.where(column(text).isNotNull()).select(column(doc_id).alias("doc"), F.xxhash64(column(text)).alias("th"), F.posexplode(F.filter(line, lambda x: x.isNotNull())).alias("i", "line"))
    return rows.select("doc", "th", "i", "line.pos", "line.a", "line.b", "line.chars").dropDuplicates(["doc", "th", "i"])


def _ranked(positions: DataFrame) -> DataFrame:
    """The positions that share their key (a, b) with another one, with the key's rank, and the first position that has it; `later`: not that one."""
    place = F.struct("doc", "th", "i")
    kinds = positions.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("a", "b", "first")
    ordered = kinds.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    kinds = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    kept = [c for c in positions.columns if c not in ("a", "b")]
    ranked = materialize(positions.join(kinds, ["a", "b"]).select(*kept, "rank", "first", (place > F.col("first")).alias("later")), "ranked")
    discard(kinds)
    return ranked


def _beside(ranked: DataFrame, by: int) -> DataFrame:
    """Pairs of ranks (a, b) of positions and of those `by` lines on in the same text, where both are ranked."""
    on = ranked.select("doc", "th", (F.col("i") - by).alias("i"), F.col("rank").alias("b"))
    return ranked.alias("x").join(on.alias("y"), _same_place("x", "y")).select("x.doc", "x.th", "x.i", F.col("x.rank").alias("a"), "y.b")


def _same_text(x: Column, y: Column) -> Column:
    return x["doc"].eqNullSafe(y["doc"]) & (x["th"] == y["th"])


def _sources(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Of each later position doc, th, i, depth (the greatest one at which it is a later one), source (the first position there), and own: the first line
    that goes with its copy of least depth, which is behind the first copy where that overlaps it."""
    least = levels[0][0]
    own = F.when(_same_text(F.struct("doc", "th"), F.col("first")), F.greatest("i", F.col("first.i") + least)).otherwise(F.col("i"))
    later = [t.where("later").select("doc", "th", "i", F.struct(F.lit(d).alias("depth"), "first").alias("at"), (own if d == least else F.lit(None)).alias("own")) for d, t in levels]
    deepest = reduce(DataFrame.union, later).groupBy("doc", "th", "i").agg(F.max("at").alias("top"), F.max("own").alias("own"))
    return deepest.select("doc", "th", "i", "top.depth", F.col("top.first").alias("source"), "own")


def _lengthened(starts: DataFrame, table: DataFrame, by: int, below: int) -> DataFrame:
    """Starts with `lines` grown by `by` where they and their sources go on with equal ranks for so many lines; only those deeper than `below` can."""
    rank = table.select(F.col("doc").alias("d"), F.col("th").alias("t"), F.col("i").alias("p"), "rank")
    at = lambda doc, th, i: F.col("d").eqNullSafe(doc) & (F.col("t") == th) & (F.col("p") == i + F.col("lines"))
    deep = starts.where(F.col("depth") > below)
    mine = deep.join(rank, at(F.col("doc"), F.col("th"), F.col("i")), "left").select(*starts.columns, F.col("rank").alias("mine"))
    both = mine.join(rank, at(F.col("source.doc"), F.col("source.th"), F.col("source.i")), "left")
    grown = both.withColumn("lines", F.when(F.col("mine") == F.col("rank"), F.col("lines") + by).otherwise(F.col("lines")))
    return grown.select(*starts.columns).union(starts.where(F.col("depth") <= below))


def _maximal(single: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Maximal runs of later copies, written: doc, th, begin and lines (among lines with a word), source (doc, th, i of what they repeat), and the
    lines [gone, begin + lines) that go with each and not with the run before."""
    least = levels[0][0]
    text = Window.partitionBy("doc", "th").orderBy("i")
    before = F.lag("source").over(text)
    goes_on = (F.lag("i").over(text) == F.col("i") - 1) & _same_text(before, F.col("source")) & (before["i"] == F.col("source.i") - 1)
    # Only copies that begin within the least depth can add lines before those that go in any case.
    own = F.min("own").over(text.rangeBetween(0, max(0, least - 2)))
    rows = _sources(levels).withColumns({"new": F.coalesce(~goes_on, F.lit(True)), "own": own}).where("new")
    starts = materialize(rows.select("doc", "th", "i", "depth", "source", "own", F.col("depth").alias("lines")), "starts")
    # At twice its depth a start is no later one, so each level below its own counts at most once; less than the least depth is left in the end.
    for depth, table, below in [*((d, t, d) for d, t in reversed(levels[:-1])), *[(1, single, 0)] * (least - 1)]:
        shorter, starts = starts, materialize(_lengthened(starts, table, depth, below), "starts")
        discard(shorter)
    ends = starts.withColumn("end", F.col("i") + F.col("lines"))
    reached = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    maximal = ends.withColumn("reached", reached).where("reached is null or end > reached")
    ahead = F.lag("own").over(text) <= F.col("own")
    gone = F.when(ahead, F.greatest("own", "reached")).otherwise(F.col("own"))
    runs = materialize(maximal.select("doc", "th", F.col("i").alias("begin"), "lines", "source", gone.alias("gone")), "runs")
    discard(starts)
    return runs


def _levels(df: DataFrame, doc_id: str, text: str, min_lines: int, most: int | None = None) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The ranks at depth 1, and depths from min_lines on with the ranks there: all in which positions share an interval (up to `most`, if given)."""
    positions = materialize(sequences(df, doc_id, text), "lines")
    single = ranked = _ranked(positions)
    discard(positions)
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        before, ranked = ranked, _ranked(_beside(ranked, step))
        if before is not single:
            discard(before)
        depth += step
    levels = [(depth, ranked)]
    while (most is None or 2 * depth <= most) and ranked.take(1):
        ranked = _ranked(_beside(ranked, depth))
        depth *= 2
        levels.append((depth, ranked))
    return single, levels


def _drop(single: DataFrame, levels: list[tuple[int, DataFrame]]) -> None:
    for table in (single, *(t for _, t in levels if t is not single)):
        discard(table)


def repeated_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_lines: int = MIN_LINES) -> DataFrame:
    """The maximal runs that repeat earlier lines: doc, begin, lines, from_doc, from_begin; places count lines with a word, from 0.

    A run's source is the first place that shares the most doublings of min_lines with its beginning; its length is exactly as many lines as both have in common.
    No run lies within another one of its text. No repeated line, an empty table, null and empty texts give no rows; a text that stands more than once with
    the same id counts once, and texts of any length are taken whole.
    """
    single, levels = _levels(df, doc_id, text, min_lines)
    runs = _maximal(single, levels)
    _drop(single, levels)
    return runs.select("doc", "begin", "lines", F.col("source.doc").alias("from_doc"), F.col("source.i").alias("from_begin"))


def later_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each text with lines to delete: doc, th, gone, the sorted places of these among all its lines, from 0, and runs, the maximal runs
    of later copies (begin and lines among lines with a word, and source: doc, th, i of what they repeat; null without one).

    Null and empty texts and an empty table give no rows; rows that share id and text are one text; of equal runs the first in the order of id,
    hash of the text and line is no later copy. Texts of any length are taken whole.
    """
    single, levels = _levels(df, doc_id, text, min_lines)
    long = single.where("later").where(F.col("chars") >= min_chars).select("doc", "th", "pos")
    runs = _maximal(single, levels)
    covered = runs.select("doc", "th", F.explode(F.sequence("gone", F.col("begin") + F.col("lines") - 1)).alias("i")).distinct()
    lines = single.alias("x").join(covered.alias("y"), _same_place("x", "y")).select("x.doc", "x.th", "x.pos")
    gone = long.union(lines).groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    named = runs.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.sort_array(F.collect_list(F.struct("begin", "lines", "source"))).alias("runs"))
    both = gone.join(named, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc", "th", "gone", "runs")
    both = materialize(both, "gone")
    discard(runs)
    _drop(single, levels)
    return both


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "lines", *, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """df with a struct column `out`: n_lines (with a word), n_deleted, text without the lines that are later copies, and runs, the maximal runs
    of later copies (begin and lines among lines with a word, and doc, th, i of what they repeat; null without one).

    Later: after the first occurrence in the order of id, 64-bit hash of the text, and line. Runs of at least min_lines lines are deleted, and
    single lines of at least min_chars characters. The first copy loses no line, overlapped or not. Lines without a word stay and do not interrupt a run. Rows that
    share id and text are one text and get the same result. Null text stays null, with no lines; a null id comes first in the order. Lines are compared by 128
    bits of hash. Texts of any length are taken whole. Other columns stay as they are, whatever their names (one called like `out` is replaced). Nothing
    is deleted from an empty table.
    """
    columns = [c for c in df.columns if c != out]
    own = free_prefix("__line_", df.columns)
    gone = later_copies(df, doc_id, text, min_lines=min_lines, min_chars=min_chars)
    gone = gone.select(*[F.col(c).alias(f"{own}{c}") for c in ("doc", "th", "gone", "runs")])
    rows = df.withColumns({f"{own}key": column(doc_id), f"{own}hash": F.xxhash64(column(text))})
    both = rows.join(gone, F.col(f"{own}key").eqNullSafe(F.col(f"{own}doc")) & (F.col(f"{own}hash") == F.col(f"{own}th")), "left")
    both = both.withColumn(f"{own}lines", F.split(column(text), "\n"))
    marks = F.col(f"{own}gone")
    left = F.array_join(F.filter(f"{own}lines", lambda x, i: ~F.array_contains(marks, i)), "\n")
    fields = F.struct(
        F.coalesce(F.size(F.filter(f"{own}lines", _has_word)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(marks), F.lit(0)).cast("long").alias("n_deleted"),
        F.when(marks.isNull(), column(text)).otherwise(left).alias("text"),
        F.col(f"{own}runs").alias("runs"),
    )
    return both.select(*[column(c) for c in columns], fields.alias(out))
