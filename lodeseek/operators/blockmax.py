"""Full-text top-k over a stored index that skips blocks of entities which can't hold a result.

For each prefix and block of neighbouring ids the index knows how many entities have it, the greatest number of occurrences and the least length: so BM25 can't be
better in the block than a bound. A query first scores the few blocks of best bounds; its k-th best row there is a threshold, and of all other blocks only
those are read whose bound is better, or as good with a smaller id to offer. All of that is done for a batch of queries at once, by joins on (token, block).
Postings stay where they are; the rows that move are those of queries and blocks. A limit as a literal goes to every task before rows of a query meet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize
from .candidates import B, K1, LEAST_IDF, PLACES, at_location, in_category
from .segments import LONGEST_PREFIX, StoredIndex

#: Blocks that a query scores for its threshold.
SEEDS = 4
#: Lies above all errors of the order in which doubles are added.
SLACK = 1e-12


def impact(idf: Column, f: Column, length: Column, mean: float) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean)))


def tokens_of_prefixes(prefixes: DataFrame, index: StoredIndex) -> DataFrame:
    """(prefix, token): the index's tokens that begin with each prefix.

    A prefix is an interval of the sorted dictionary. It meets the parts of the dictionary that the interval touches by their first and last tokens, and then
    each part's tokens by the part's number: none has more than a part's tokens, however short the prefix.
    """
    asked = prefixes.select("prefix").distinct()
    touches = (F.col("last") >= F.col("prefix")) & ((F.col("first") <= F.col("prefix")) | F.col("first").startswith(F.col("prefix")))
    parts = asked.join(index.table("fences").select("part", "first", "last"), touches).select("prefix", "part")
    met = parts.join(index.table("dictionary").select("part", "token"), "part").where(F.col("token").startswith(F.col("prefix"))).select("prefix", "token")
    return met.distinct() if len(index.manifest.segments) > 1 else met


class BlockMaxSearch:
    """The stages of a batch of queries' terms (query_id, term) on an index. What several of them read is written as small tables, which close() deletes.

    queries: (query_id, location_slug, category_slug, limit), whose greatest limit is read when the stages are made. Filters apply before the limit, and to
    mapped columns alone. Ranks are those of bm25 over the live entities.
    """

    def __init__(self, terms: DataFrame, index: StoredIndex, queries: DataFrame, locale, times: int = 3, seeds: int = SEEDS):
        self.index, self.locale, self.times, self.seeds = index, locale, times, seeds
        self._written: list[DataFrame] = []
        self.terms = self._kept(terms.select("query_id", "term"), "terms")
        self.queries = self._kept(queries.select("query_id", F.col("location_slug").alias("q_location"), F.col("category_slug").alias("q_category"), "limit"), "queries")
        self.most = times * (self.queries.agg(F.max("limit").alias("most")).first()["most"] or 0)
        self.mean = index.manifest.length / index.manifest.docs if index.manifest.docs else 1.0

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        self._written.append(materialize(df, f"blockmax-{label}"))
        return self._written[-1]

    @cached_property
    def distinct(self) -> DataFrame:
        """(term, simple): simple terms are single words that have entries of their own among the prefixes."""
        return self.terms.select("term").distinct().withColumn("simple", ~F.contains("term", F.lit(" ")) & (F.length("term") <= LONGEST_PREFIX))

    @cached_property
    def tokens(self) -> DataFrame:
        """(term, token) of simple terms."""
        simple = self.distinct.where("simple").select(F.col("term").alias("prefix"))
        return self._kept(tokens_of_prefixes(simple, self.index).withColumnRenamed("prefix", "term"), "tokens")

    @cached_property
    def other_hits(self) -> DataFrame:
        """(term, block, id, segment, f, doc_len) of terms that aren't simple: phrases whose last word is a prefix, and long prefixes; found whole."""
        words = self.distinct.where("not simple").select("term", F.split("term", " ").alias("words"))
        each = words.select("term", F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
        last = each.where("j = n - 1").withColumnRenamed("word", "prefix")
        begun = last.join(tokens_of_prefixes(last, self.index), "prefix").select("term", "n", "j", "token")
        parts = each.where("j < n - 1").select("term", "n", "j", F.col("word").alias("token")).unionByName(begun)
        # A block holds a phrase only if it holds all its words: prefixes name the blocks, so that postings are met by token and block.
        key = F.substring("token", 1, LONGEST_PREFIX)
        at = parts.select("term", "n", "j", key.alias("prefix")).distinct().join(self.index.table("prefixes").select("prefix", "block"), "prefix")
        blocks = at.groupBy("term", "n", "block").agg(F.count_distinct("j").alias("have")).where("have = n").select("term", "block")
        met = parts.join(blocks, "term").join(self.index.table("postings"), ["token", "block"])
        places = met.select("term", "n", "j", "block", "id", "segment", "doc_len", "field", F.explode("positions").alias("p"))
        stands = places.groupBy("term", "block", "id", "segment", "doc_len", "field", (F.col("p") - F.col("j")).alias("at")).agg(F.count_distinct("j").alias("have"), F.first("n").alias("n"))
        hits = stands.where("have = n").groupBy("term", "block", "id", "segment", "doc_len").agg(F.count(F.lit(1)).alias("f"))
        return self._kept(self._alive(hits), "hits")

    def _alive(self, hits: DataFrame) -> DataFrame:
        return self.index.of_live(hits, how="left_semi") if self.index.manifest.dirty else hits

    def _simple_hits(self, pairs: DataFrame) -> DataFrame:
        """pairs (..., term, block) with id, segment, f, doc_len of the simple terms' hits in those blocks, dead ones included."""
        keys = [c for c in pairs.columns if c != "block"]
        met = pairs.join(self.tokens, "term").join(self.index.table("postings").select("token", "block", "id", "segment", "tf", "doc_len"), ["token", "block"])
        return met.groupBy(*keys, "block", "id", "segment").agg(F.sum("tf").alias("f"), F.first("doc_len").alias("doc_len"))

    @cached_property
    def term_blocks(self) -> DataFrame:
        """(term, block, n, max_f, min_len): blocks with a live hit of a term. Of blocks with dead rows the hits are counted, their bounds stay valid."""
        simple = self.distinct.where("simple").select("term")
        held = simple.join(self.index.table("prefixes"), F.col("term") == F.col("prefix")).select("term", "block", "n", "max_f", "min_len")
        if self.index.manifest.dirty:
            dirty = self.index.dirty_blocks
            inside = held.join(dirty, "block", "left_semi")
            counted = self._alive(self._simple_hits(inside.select("term", "block"))).groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"))
            again = inside.drop("n").join(counted, ["term", "block"]).select("term", "block", "n", "max_f", "min_len")
            held = held.join(dirty, "block", "left_anti").unionByName(again)
        others = self.other_hits.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("max_f"), F.min("doc_len").alias("min_len"))
        return self._kept(held.unionByName(others), "blocks")

    @cached_property
    def idf(self) -> DataFrame:
        docs = F.lit(float(self.index.manifest.docs))
        raw = F.log((docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
        seen = self.term_blocks.groupBy("term").agg(F.sum("n").cast("double").alias("n"))
        return seen.select("term", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(query_id, block, bound, place): the blocks that have a hit of a query, best bound first. No row of the block ranks better."""
        bounded = self.term_blocks.join(self.idf, "term").select("term", "block", impact(F.col("idf"), F.col("max_f"), F.col("min_len"), self.mean).alias("bound"))
        both = self.terms.join(bounded, "term").groupBy("query_id", "block").agg(F.round(-F.sum("bound") - SLACK, PLACES).alias("bound"))
        order = Window.partitionBy("query_id").orderBy("bound", "block")
        seeds = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.seeds).select("query_id", "block", "place")
        return self._kept(both.join(seeds, ["query_id", "block"], "left"), "pairs")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(query_id, block, id, fts_rank) of the live rows of pairs (query_id, block) that pass the query's filters."""
        asked = self.terms.join(pairs, "query_id").join(self.term_blocks.select("term", "block"), ["term", "block"]).select("query_id", "term", "block")
        hits = self._simple_hits(asked).select("query_id", "term", "block", "id", "segment", "f", "doc_len")
        others = asked.join(self.other_hits, ["term", "block"]).select("query_id", "term", "block", "id", "segment", "f", "doc_len")
        weighed = hits.unionByName(others).join(self.idf, "term")
        ranked = weighed.groupBy("query_id", "block", "id", "segment").agg((-F.sum(impact(F.col("idf"), F.col("f"), F.col("doc_len"), self.mean))).alias("fts_rank"))
        unmapped = self.index.manifest.unmapped
        rows = self.index.of_live(ranked.join(self.queries, "query_id"), "location_slug", "categories_n")
        if "location_slug" not in unmapped:
            rows = rows.where(at_location(F.col("location_slug"), F.col("q_location")))
        if "categories_n" not in unmapped:
            rows = rows.where(in_category(F.col("categories_n"), F.col("q_category"), self.locale))
        return rows.select("query_id", "block", "id", "fts_rank", "limit")

    def _best(self, rows: DataFrame) -> DataFrame:
        """The first times x limit rows of each query. Blocks, then tasks, then queries keep no more than the greatest limit's."""
        order = [F.round("fts_rank", PLACES), F.col("id")]
        inside = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("pos") <= self.most)
        placed = inside.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= self.most)
        return placed.where(F.col("pos") <= self.times * F.col("limit"))

    @cached_property
    def seeded(self) -> DataFrame:
        return self._kept(self._best(self.scored(self.pairs.where("place is not null").select("query_id", "block"))), "seeds")

    @cached_property
    def needed(self) -> DataFrame:
        """(query_id, block): the blocks besides the seeds that may hold a row before the k-th best of the seeds. Without k rows there all are needed.

        Blocks are runs of ids: where the bound only equals the k-th row's rank, a block whose least id is greater can't come before it.
        """
        last = self.seeded.where(F.col("pos") == self.times * F.col("limit")).select("query_id", F.round("fts_rank", PLACES).alias("kth"), F.col("id").alias("kth_id"))
        first = self.index.table("entities").groupBy("block").agg(F.min("id").alias("first_id"))
        rest = self.pairs.where("place is null").join(last, "query_id", "left").join(first, "block")
        better = F.col("kth").isNull() | (F.col("bound") < F.col("kth")) | ((F.col("bound") == F.col("kth")) & (F.col("first_id") < F.col("kth_id")))
        return self._kept(rest.where(better).select("query_id", "block"), "needed")

    @cached_property
    def top(self) -> DataFrame:
        """(query_id, id, fts_rank, pos): at most times x limit rows of each query."""
        both = self.seeded.drop("pos").unionByName(self.scored(self.needed))
        return self._best(both).select("query_id", "id", "fts_rank", "pos")

    def close(self) -> None:
        for table in self._written:
            discard(table)
        self._written.clear()
