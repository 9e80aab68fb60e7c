"""Candidates of a batch of queries: scans by place, full-text top-k by BM25, fuzzy top-k by trigrams, and synonyms.

Queries are a DataFrame; nothing here loops over them. Joins are equi-joins: prefixes meet tokens by their first characters. Tables that grow with the
entities are never broadcast: their files are far smaller than their rows, so an estimate by files would send millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import KM_PER_DEGREE, bounding_box, haversine_km
from ..functions.locale import Locale
from ..functions.text import aliases_of, fts_terms, min_overlap, trigrams_of
from .expansion import expanded
from .index import TextIndex, entity_trigrams, trigram_counts
from .mapping import is_mapped

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Fixed values of the positive rank: the weight of a place, the limit of the sum of 1 / j^2, and how many places of a token count.
PLACE_WEIGHT, SQUARES, MOST_PLACES = 0.1, 1.64493406685, 255
#: Of doubles that decide an order, so many decimal places count.
PLACES = 9
#: Canonicals of an alias that travel as one list, as a power of two.
LISTED_BITS = 8
#: Copies of the synonyms that queries meet, at most, and the rows that hold the lists of one copy.
COPIES, CHUNKS = 64, 256


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries (query_id, normalized, ...) with `tokens`: the words, then canonicals of words and adjacent pairs that aren't words already.

    Canonicals stand in the order of their first alias, then by name. The result grows with queries x canonicals of their words, so it is made within the
    queries' rows and isn't shuffled: the queries are dealt out, and each share of them meets a copy of the synonyms, of which there are at most COPIES.
    """
    copies = max(1, min(COPIES, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # The lists of an alias are ranges of its canonicals, so their order is that of what they hold.
    order = Window.partitionBy("alias").orderBy("canonical")
    each = synonyms.select("alias", "canonical").where("alias is not null and canonical is not null").distinct().withColumn("list", F.shiftright(F.row_number().over(order) - 1, LISTED_BITS))
    lists = each.groupBy("alias", "list").agg(F.sort_array(F.collect_list("canonical")).alias("canonicals"))
    chunks = lists.groupBy(F.pmod(F.xxhash64("alias", "list"), F.lit(CHUNKS)).alias("chunk")).agg(F.collect_list(F.struct("alias", "list", "canonicals")).alias("lists"))
    copied = chunks.select("chunk", "lists", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("share"))
    dealt = queries.select(F.struct("*").alias("query"), F.pmod(F.xxhash64("query_id", "normalized"), F.lit(copies)).cast("int").alias("share"))
    met = copied.unionByName(dealt, allowMissingColumns=True).repartitionById(copies, F.col("share")).sortWithinPartitions(F.asc_nulls_last("chunk"))
    schema = T.StructType([*queries.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])
    return met.select("chunk", "lists", "query").mapInArrow(expanded, schema)


def expand_for_terms(queries: DataFrame, synonyms: DataFrame, most: int = 6) -> DataFrame:
    """expand_synonyms as far as the first `most` full-text terms go: only queries whose own words give fewer are expanded, the others keep their words."""
    words = F.filter(F.split("normalized", " "), lambda t: t != "")
    enough = F.size(fts_terms(words, most)) >= most
    whole = queries.where(enough).withColumn("tokens", words)
    return whole.unionByName(expand_synonyms(queries.where(F.coalesce(~enough, F.lit(True))), synonyms))


def query_terms(expanded: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, term): the distinct full-text terms of expanded queries."""
    return expanded.select("query_id", F.explode(F.array_distinct(fts_terms(F.col("tokens"), most))).alias("term"))


def prefix_matches(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(prefix, token): the tokens that begin with each prefix. Prefixes of 3 characters or more meet tokens by these three."""
    prefixes = terms.select("prefix").distinct()
    out = None
    for n in (1, 2, 3):
        some = prefixes.where(F.length("prefix") == n if n < 3 else F.length("prefix") >= 3).withColumn("block", F.substring("prefix", 1, n))
        met = some.join(tokens.select("token", F.substring("token", 1, n).alias("block")), "block").where(F.col("token").startswith(F.col("prefix"))).select("prefix", "token")
        out = met if out is None else out.unionByName(met)
    return out


def token_hits(terms: DataFrame, index: TextIndex) -> DataFrame:
    """(term, token, id, f): occurrences of each token that a distinct term finds.

    The last word of a term is a prefix; words before it stand exactly and next to each other in one field. A term of several words is a token of its own.
    """
    words = terms.select("term").distinct().withColumn("words", F.split("term", " "))
    vocabulary = index.vocabulary
    one = words.where(F.size("words") == 1).select("term", F.col("term").alias("prefix"))
    single = one.join(prefix_matches(one, vocabulary), "prefix").join(index.postings.hint("merge"), "token").groupBy("term", "token", "id").agg(F.sum("tf").alias("f"))
    many = words.where(F.size("words") > 1).select("term", F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
    last = many.where("j = n - 1").withColumnRenamed("word", "prefix")
    exact = many.where("j < n - 1").select("term", "n", "j", F.col("word").alias("token"))
    parts = exact.unionByName(last.join(prefix_matches(last, vocabulary), "prefix").select("term", "n", "j", "token"))
    places = parts.join(index.postings.hint("merge"), "token").select("term", "n", "j", "id", "field", F.explode("positions").alias("p"))
    phrases = places.groupBy("term", "id", "field", (F.col("p") - F.col("j")).alias("at")).agg(F.count_distinct("j").alias("have"), F.first("n").alias("n")).where("have = n")
    return single.unionByName(phrases.groupBy("term", F.col("term").alias("token"), "id").agg(F.count(F.lit(1)).alias("f")))


def term_hits(terms: DataFrame, index: TextIndex) -> DataFrame:
    """(term, id, f): occurrences of each distinct term, of whatever tokens."""
    return token_hits(terms, index).groupBy("term", "id").agg(F.sum("f").alias("f"))


def positive_rank(terms: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, id, fts_rank), higher is better, by the public formula of a full-text database's rank for terms joined by OR.

    The n places of a token add weight x (1 + 1/4 + ... + 1/n^2) / (pi^2 / 6); the sum over the tokens of all terms is divided by the number of terms,
    those without a match included. All places have one weight, and a token's first 255 count.
    """
    squares = F.aggregate(F.sequence(F.lit(1), F.least(F.col("f"), F.lit(MOST_PLACES)).cast("int")), F.lit(0.0), lambda total, j: total + 1.0 / (j * j))
    parts = token_hits(terms, index).select("term", "id", (PLACE_WEIGHT / SQUARES * squares).alias("part")).groupBy("term", "id").agg(F.sum("part").alias("part"))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return terms.join(parts, "term").join(sizes, "query_id").groupBy("query_id", "id").agg((F.sum("part") / F.first("size")).alias("fts_rank"))


def bm25(terms: DataFrame, index: TextIndex, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, id, fts_rank): Okapi BM25, negative, lower is better. Numbers of documents and lengths are those of the whole index, whatever is filtered later.

    hits, from term_hits, is read twice: hand it in persisted where that pays.
    """
    hits = term_hits(terms, index) if hits is None else hits
    corpus = index.docs.agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg("doc_len").alias("mean_len"))
    seen = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = seen.crossJoin(corpus).select("term", "mean_len", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    scored = hits.join(weighed, "term").join(index.docs.hint("merge"), "id")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    by_term = scored.select("term", "id", part.alias("part"))
    return terms.join(by_term, "term").groupBy("query_id", "id").agg((-F.sum("part")).alias("fts_rank"))


def category_name(slug: Column, locale) -> Column:
    return locale.normalize(F.replace(slug, F.lit("-"), F.lit(" ")))


def at_location(entity_slug: Column, wanted: Column) -> Column:
    return wanted.isNull() | (entity_slug == wanted)


def in_category(categories: Column, wanted: Column, locale) -> Column:
    return wanted.isNull() | F.contains(F.lower(categories), category_name(wanted, locale))


def in_wanted_category(met: DataFrame, entities: DataFrame, locale: Locale | None) -> DataFrame:
    """met (id, q_category, ...) of entities in the category wanted; all of it without a locale, or where categories aren't mapped."""
    if locale is None or not is_mapped(entities, "categories_n"):
        return met
    return met.join(entities.select("id", "categories_n").hint("merge"), "id").where(in_category(F.col("categories_n"), F.col("q_category"), locale)).drop("categories_n")


def first_rows(rows: DataFrame, order: list[Column], times: int, most: int | None) -> DataFrame:
    """rows (query_id, limit, ...) with pos, their place in a query's order; the first times x limit of each stay.

    most is the greatest limit of the batch: a literal, which tasks apply to their own rows before a query's rows meet in one.
    """
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    placed = placed if most is None else placed.where(F.col("pos") <= times * most)
    return placed.where(F.col("pos") <= times * F.col("limit"))


def fts_top(ranked: DataFrame, queries: DataFrame, entities: DataFrame, locale, most: int | None = None) -> DataFrame:
    """(query_id, id, fts_rank, pos): at most 3 x limit for each query, after its filters on location and category. most: see first_rows."""
    kept = ranked.join(queries.select("query_id", F.col("location_slug").alias("q_location"), F.col("category_slug").alias("q_category"), "limit"), "query_id").join(entities.select("id", "location_slug", "categories_n").hint("merge"), "id")
    if is_mapped(entities, "location_slug"):
        kept = kept.where(at_location(F.col("location_slug"), F.col("q_location")))
    if is_mapped(entities, "categories_n"):
        kept = kept.where(in_category(F.col("categories_n"), F.col("q_category"), locale))
    return first_rows(kept, [F.round("fts_rank", PLACES), F.col("id")], 3, most).select("query_id", "id", "fts_rank", "pos")


def rarest(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, trigram) from (query_id, grams, least): the trigrams that suffice to find every entity that has `least` of them.

    Of q trigrams, any set of `least` holds one of the q - least + 1 rarest, so the long lists of frequent trigrams aren't read. Trigrams that no entity
    has count as rarest, which is right: they take a place and find nothing.
    """
    each = asked.select("query_id", F.explode("grams").alias("trigram"), (F.size("grams") - F.col("least") + 1).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "trigram")
    return each.join(counts, "trigram", "left").withColumn("place", F.row_number().over(order)).where("place <= most").select("query_id", "trigram")


def probed(asked: DataFrame, trigrams: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(query_id, id), each once: entities that have one of a query's rarest trigrams."""
    counts = trigram_counts(trigrams) if counts is None else counts
    return rarest(asked, counts).join(trigrams.select("trigram", "id").hint("merge"), "trigram").select("query_id", "id").distinct()


def fuzzy_top(queries: DataFrame, trigrams: DataFrame, entities: DataFrame, counts: DataFrame | None = None, held: DataFrame | None = None, most: int | None = None, strict: Locale | None = None) -> DataFrame:
    """(query_id, id, fuzzy_score, pos): at most 2 x limit entities that share enough of a query's trigrams in any field; only the location filters, with a
    locale as `strict` the category too.

    Candidates come from the rarest trigrams; how many they share is counted on the trigrams that each holds. counts and held, of trigram_counts and
    entity_trigrams, are made from the index where they aren't handed in.
    """
    wanted = [F.col("category_slug").alias("q_category")] if strict else []
    asked = queries.select("query_id", "limit", F.col("location_slug").alias("q_location"), *wanted, trigrams_of(F.col("normalized")).alias("grams"))
    asked = asked.select("*", F.size("grams").alias("q")).withColumn("least", min_overlap(F.col("q")))
    held = entity_trigrams(trigrams) if held is None else held
    met = probed(asked, trigrams, counts).join(asked, "query_id")
    if is_mapped(entities, "location_slug"):
        met = met.join(entities.select("id", "location_slug").hint("merge"), "id").where(at_location(F.col("location_slug"), F.col("q_location")))
    met = in_wanted_category(met, entities, strict)
    kept = met.join(held.hint("merge"), "id").withColumn("shared", F.size(F.array_intersect("grams", "held"))).where("shared >= least")
    kept = kept.withColumn("fuzzy_score", F.col("shared") / F.col("q").cast("double"))
    return first_rows(kept, [F.desc("fuzzy_score"), F.col("id")], 2, most).select("query_id", "id", "fuzzy_score", "pos")


def location_scan(queries: DataFrame, entities: DataFrame, locale, most: int | None = None) -> DataFrame:
    """(query_id, id, distance_km, pos): the first `limit` entities by id of a location (and category), then by distance where the query has a point."""
    asked = queries.select("query_id", "limit", F.col("location_slug").alias("q_location"), F.col("category_slug").alias("q_category"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"))
    rows = entities.select("id", "lat", "lng", "location_slug", "categories_n").join(asked, F.col("location_slug") == F.col("q_location"))
    if is_mapped(entities, "categories_n"):
        rows = rows.where(in_category(F.col("categories_n"), F.col("q_category"), locale))
    rows = first_rows(rows, [F.col("id")], 1, most)
    rows = rows.withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng")))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull(), F.coalesce(F.round("distance_km", PLACES), F.lit(999.0))), "id")
    return rows.withColumn("pos", F.row_number().over(order)).select("query_id", "id", "distance_km", "pos")


def _cell(degrees: Column, side: float, edge: float) -> Column:
    """The number of a cell along one axis; what lies beyond the edge counts to the last cell, so the order of places is kept."""
    last = int(edge / side) + 1
    return F.greatest(F.lit(-last), F.least(F.lit(last), F.floor(degrees / side)))


def geo_scan(queries: DataFrame, entities: DataFrame, radius_km: float, most: int | None = None) -> DataFrame:
    """(query_id, id, distance_km, pos): the nearest `limit` entities in the box around each query's point.

    Box and entity meet by cells of latitude and longitude about as high as the box, so the join is an equi-join and reads a few cells a query.
    """
    box = bounding_box(F.col("lat"), F.col("lng"), F.lit(radius_km))
    side = max(2 * radius_km / KM_PER_DEGREE, 0.01)
    asked = queries.where("lat is not null and lng is not null").select("query_id", "limit", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), *[v.alias(k) for k, v in box.items()])
    asked = asked.withColumn("row", F.explode(F.sequence(_cell(F.col("min_lat"), side, 90), _cell(F.col("max_lat"), side, 90))))
    asked = asked.withColumn("column", F.explode(F.sequence(_cell(F.col("min_lng"), side, 180), _cell(F.col("max_lng"), side, 180))))
    placed = entities.where("lat is not null and lng is not null").select("id", "lat", "lng", _cell(F.col("lat"), side, 90).alias("row"), _cell(F.col("lng"), side, 180).alias("column"))
    rows = placed.join(asked, ["row", "column"])
    rows = rows.where("lat between min_lat and max_lat and lng between min_lng and max_lng").withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng")))
    return first_rows(rows, [F.round("distance_km", PLACES), F.col("id")], 1, most).select("query_id", "id", "distance_km", "pos")
