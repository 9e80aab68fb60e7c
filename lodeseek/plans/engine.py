"""The search engine: a batch of queries against a table of entities, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import walking_minutes
from ..functions.locale import GENERIC, Locale
from ..functions.text import MIN_SEARCH_TOKEN_LENGTH, is_blank
from ..operators import candidates, ranking
from ..operators.blockmax import BlockMaxSearch
from ..operators.index import TextIndex, entity_trigrams, text_index, trigram_counts, trigram_index
from ..operators.segments import StoredIndex
from ..operators.similarity import SimilarityIndex, persisted, similarity_index, similarity_top
from ..sources.shared import discard, materialize
from .budget import within

QUERY_SCHEMA = "query_id long, query string, location_slug string, category_slug string, lat double, lng double, limit int, offset int"
SYNONYM_SCHEMA = "alias string, canonical string, category string, ordinal int"


@dataclass(frozen=True)
class SearchConfig:
    locale: Locale = field(default=GENERIC)
    primary_km: float = 15.0
    nearby_km: float = 30.0
    max_nearby: int = 5
    max_terms: int = 6
    quality: float = 0.75
    few_hits: int = 5
    least_fuzzy: int = MIN_SEARCH_TOKEN_LENGTH
    #: Ranks that grow with relevance, and similarity of whole fields for the fuzzy branch.
    positive_rank: bool = False
    #: Does the category filter the fuzzy branch too?
    strict_category: bool = False
    #: Seconds that the full-text and the fuzzy branch of a batch may take; a branch that takes longer is cancelled and gives no rows. None: no bound.
    fts_seconds: float | None = None
    fuzzy_seconds: float | None = None


@dataclass
class Indexes:
    """The text index, the trigram index, its entries by trigram and the trigrams of each entity; the index of similar fields, which positive ranks alone need.

    stored is the index in files that these are read from, if any: full-text search then skips its blocks.
    """

    text: TextIndex
    trigrams: DataFrame
    counts: DataFrame
    held: DataFrame
    similar: SimilarityIndex
    stored: StoredIndex | None = None

    @property
    def tables(self) -> list[DataFrame]:
        return [self.text.postings, self.text.docs, self.text.vocabulary, self.trigrams, self.counts, self.held, *self.similar.tables]

    def close(self) -> None:
        for table in self.tables:
            table.unpersist()


def build_indexes(entities: DataFrame) -> Indexes:
    grams = trigram_index(entities)
    return Indexes(text_index(entities), grams, trigram_counts(grams), entity_trigrams(grams), similarity_index(entities))


def stored_indexes(index: StoredIndex) -> Indexes:
    """The indexes of a stored one, read as they lie. Entries of dead rows stay among the trigrams: what they find is verified on live rows' own."""
    grams = index.table("trigrams").select("trigram", "id", "field")
    counts = index.table("gram_counts").groupBy("trigram").agg(F.sum("n").alias("n"))
    return Indexes(index.text(), grams, counts, index.live.select("id", "held"), similarity_index(index.entities()), index)


def persist_indexes(indexes: Indexes) -> Indexes:
    """The indexes, computed at first use and kept in memory or on disk. What derives from a table reads the kept one."""
    text, grams = indexes.text, indexes.trigrams.persist()
    postings = text.postings.persist()
    kept = TextIndex(postings, text.docs.persist(), text.vocabulary.persist())
    return Indexes(kept, grams, indexes.counts.persist(), indexes.held.persist(), persisted(indexes.similar))


def routed(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """queries with geo_intent, normalized and route: location, geo, none or text. limit and offset get their defaults, 20 and 0."""
    locale = config.locale
    queries = queries.withColumns({"blank": is_blank(F.coalesce("query", F.lit(""))), "geo": locale.geo(F.col("query"))})
    blank = F.col("blank")
    intent = ~blank & F.col("geo.intent")
    rows = queries.withColumns({"location_slug": F.nullif(F.col("location_slug"), F.lit("")), "category_slug": F.nullif(F.col("category_slug"), F.lit("")), "limit": F.coalesce("limit", F.lit(20)), "offset": F.coalesce("offset", F.lit(0)), "geo_intent": intent, "cleaned": F.col("geo.rest")})
    cleaned = F.when(F.col("geo_intent"), F.col("cleaned")).otherwise(F.coalesce("query", F.lit("")))
    rows = rows.withColumn("normalized", locale.normalize(cleaned)).drop("cleaned")
    place = F.when(F.coalesce("location_slug", F.lit("")) != "", "location").when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), "geo").otherwise("none")
    return rows.withColumn("route", F.when(blank | (F.col("geo_intent") & (F.col("normalized") == "")), place).otherwise("text")).drop("blank", "geo")


class Search:
    """The stages of a batch, each a DataFrame; only what is asked for is computed.

    What several stages read is written as a table at first use, which keeps plans short and outlives lost executors: the routed queries, their terms and
    hits, and the rows of the full-text and the fuzzy branch (3 and 2 x limit for each query at most). close() deletes the tables. Indexes are best built once,
    persisted or written, and handed in. stored() searches an index in files.
    """

    def __init__(self, entities: DataFrame, queries: DataFrame, synonyms: DataFrame, config: SearchConfig = SearchConfig(), indexes: Indexes | None = None):
        self.entities, self.config, self.synonyms = entities, config, synonyms
        self.indexes = indexes or build_indexes(entities)
        #: Branches that went beyond their budgets.
        self.timed_out: list[str] = []
        self._written: list[DataFrame] = []
        self.queries = self._kept(routed(queries, config), "queries")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self._written.append(materialize(df, f"search-{name}"))
        return self._written[-1]

    @classmethod
    def stored(cls, index: StoredIndex, queries: DataFrame, synonyms: DataFrame, config: SearchConfig = SearchConfig()) -> Search:
        return cls(index.entities(), queries, synonyms, config, stored_indexes(index))

    @cached_property
    def most(self) -> int:
        """The greatest limit of the batch."""
        return self.queries.agg(F.max("limit").alias("most")).first()["most"] or 0

    @cached_property
    def text(self) -> DataFrame:
        return self.queries.where("route = 'text'")

    @cached_property
    def expanded(self) -> DataFrame:
        return candidates.expand_synonyms(self.text, self.synonyms)

    @cached_property
    def terms(self) -> DataFrame:
        return self._kept(candidates.query_terms(self.expanded, self.config.max_terms), "terms")

    @cached_property
    def hits(self) -> DataFrame:
        return self._kept(candidates.term_hits(self.terms, self.indexes.text), "hits")

    @cached_property
    def ranked(self) -> DataFrame:
        if self.config.positive_rank:
            return candidates.positive_rank(self.terms, self.indexes.text).withColumn("fts_rank", -F.col("fts_rank"))
        return candidates.bm25(self.terms, self.indexes.text, self.hits)

    @cached_property
    def blocks(self) -> BlockMaxSearch:
        return BlockMaxSearch(self.terms, self.indexes.stored, self.text, self.config.locale)

    def _in_time(self, name: str, seconds: float | None, build: Callable[[], DataFrame], schema: str) -> DataFrame:
        """A branch's rows, written; none, if its budget is over first."""
        if seconds is None:
            return self._kept(build(), name)
        spark = self.queries.sparkSession
        done = within(spark, seconds, lambda: materialize(build(), f"search-{name}"))
        if done is None:
            self.timed_out.append(name)
            return spark.createDataFrame([], schema)
        self._written.append(done)
        return done

    @cached_property
    def fts(self) -> DataFrame:
        id_type = self.entities.schema["id"].dataType.simpleString()
        return self._in_time("fts", self.config.fts_seconds, self._fts, f"query_id long, id {id_type}, fts_rank double, pos int")

    def _fts(self) -> DataFrame:
        if self.indexes.stored is not None and not self.config.positive_rank:
            return self.blocks.top
        top = candidates.fts_top(self.ranked, self.text, self.entities, self.config.locale, self.most)
        return top.withColumn("fts_rank", -F.col("fts_rank")) if self.config.positive_rank else top

    @cached_property
    def gated_queries(self) -> DataFrame:
        """Text queries with the number of their full-text rows, and whether they go on to the fuzzy search."""
        hits = self.fts.groupBy("query_id").agg(F.count(F.lit(1)).alias("fts_rows"))
        counted = self.text.join(hits, "query_id", "left").withColumn("fts_rows", F.coalesce("fts_rows", F.lit(0)))
        return counted.withColumn("run_fuzzy", (F.col("fts_rows") < self.config.few_hits) & (F.length("normalized") >= self.config.least_fuzzy))

    @cached_property
    def fuzzy(self) -> DataFrame:
        id_type = self.entities.schema["id"].dataType.simpleString()
        return self._in_time("fuzzy", self.config.fuzzy_seconds, self._fuzzy, f"query_id long, id {id_type}, fuzzy_score double, pos int")

    def _fuzzy(self) -> DataFrame:
        asked, indexes = self.gated_queries.where("run_fuzzy"), self.indexes
        strict = self.config.locale if self.config.strict_category else None
        if self.config.positive_rank:
            return similarity_top(asked, indexes.similar, self.entities, most=self.most, strict=strict)
        return candidates.fuzzy_top(asked, indexes.trigrams, self.entities, indexes.counts, indexes.held, self.most, strict)

    @cached_property
    def merged(self) -> DataFrame:
        return ranking.merge(self.fts, self.fuzzy)

    @cached_property
    def scored(self) -> DataFrame:
        return ranking.score(self.merged, self.text, self.entities, self.config.positive_rank)

    @cached_property
    def gated(self) -> DataFrame:
        return ranking.gate(self.scored, self.config.quality)

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        return ranking.split(self.gated, self.text, self.config.primary_km, self.config.nearby_km, self.config.max_nearby)

    @property
    def pages(self) -> DataFrame:
        return self.split[0]

    @property
    def counts(self) -> DataFrame:
        return self.split[1]

    @cached_property
    def by_location(self) -> DataFrame:
        return candidates.location_scan(self.queries.where("route = 'location'"), self.entities, self.config.locale, self.most)

    @cached_property
    def by_point(self) -> DataFrame:
        return candidates.geo_scan(self.queries.where("route = 'geo'"), self.entities, self.config.primary_km, self.most)

    def close(self) -> None:
        if "blocks" in self.__dict__:
            self.blocks.close()
        for table in self._written:
            discard(table)
        self._written.clear()

    def results(self) -> DataFrame:
        """query_id, section, rank, id, name, slug, lat, lng, distance_km, walking_min, score (null for scans)."""
        columns = ["query_id", "section", "rank", "id", "name", "slug", "lat", "lng", "distance_km", "walking_min", "score"]
        scans = self.by_location.unionByName(self.by_point).join(self.entities.select("id", "name", "slug", "lat", "lng").hint("merge"), "id")
        scans = scans.select("*", F.lit("primary").alias("section"), F.col("pos").cast("int").alias("rank"), walking_minutes(F.col("distance_km")).alias("walking_min"), F.lit(None).cast("double").alias("score"))
        return self.pages.select(*columns).unionByName(scans.select(*columns))

    def summary(self) -> DataFrame:
        """One row for each query: query_id, no_local_results, searched_place, total_found."""
        scans = self.by_location.unionByName(self.by_point).groupBy("query_id").agg(F.count(F.lit(1)).alias("scanned"))
        rows = self.queries.join(self.counts, "query_id", "left").join(scans, "query_id", "left")
        shown, scanned = F.coalesce("shown", F.lit(0)), F.coalesce("scanned", F.lit(0))
        total = F.coalesce("total_found", F.lit(0))
        by_radius = F.col("location_slug").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
        empty = F.when(F.col("route") == "text", F.when(by_radius, total == 0).otherwise(shown == 0)).when(F.col("route") == "geo", scanned == 0).otherwise(False)
        return rows.select("query_id", empty.alias("no_local_results"), F.when(F.col("route") == "text", F.col("normalized")).alias("searched_place"), F.when(F.col("route") == "text", total).otherwise(scanned).alias("total_found"))
