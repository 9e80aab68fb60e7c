"""Top-k by similarity of whole fields: a join of sets of trigrams that reads few postings.

The trigrams of each field and query stand in one order, rare ones first. Two sets alike to a degree t share one of the first few trigrams of each, are of
like size, and the places of what they share leave enough for the rest. So a posting (trigram, id, field, size, place) is read only if all of that holds. A
batch begins with a high degree: queries with enough rows as good as that are done, and only the others go on to a lower one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locale import Locale
from ..functions.text import padded_similarity, padded_trigrams_of
from ..sources.shared import discard, materialize
from .candidates import PLACES, at_location, first_rows, in_wanted_category
from .mapping import FIELDS, field_texts, is_mapped

#: Degrees of similarity with which a batch begins, before its threshold.
DEGREES = (0.6, 0.3)


@dataclass
class SimilarityIndex:
    """fields (id, field, grams): the padded trigrams of each field, rare ones first; entries (trigram, id, field, size, place) of them; counts (trigram, n)."""

    fields: DataFrame
    entries: DataFrame
    counts: DataFrame

    @property
    def tables(self) -> list[DataFrame]:
        return [self.fields, self.entries, self.counts]


def _entries(fields: DataFrame) -> DataFrame:
    return fields.select("id", "field", F.size("grams").alias("size"), F.posexplode("grams").alias("place", "trigram"))


def similarity_index(entities: DataFrame, fields=FIELDS) -> SimilarityIndex:
    each = field_texts(entities, fields).select("id", "field", F.explode(padded_trigrams_of(F.col("text"))).alias("trigram")).distinct()
    counts = each.groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
    grams = F.transform(F.sort_array(F.collect_list(F.struct("n", "trigram"))), lambda g: g["trigram"])
    ordered = each.join(counts, "trigram").groupBy("id", "field").agg(grams.alias("grams"))
    return SimilarityIndex(ordered, _entries(ordered), counts)


def persisted(index: SimilarityIndex) -> SimilarityIndex:
    fields = index.fields.persist()
    return SimilarityIndex(fields, _entries(fields), index.counts.persist())


def _least(x: Column) -> Column:
    """The least integer not below x, errors of doubles aside."""
    return F.ceil(x - 1e-9)


def met(asked: DataFrame, index: SimilarityIndex, degree: float) -> DataFrame:
    """The postings that queries (query_id, grams) read to find all fields alike to a degree: query_id, id, field."""
    each = asked.select("query_id", F.size("grams").alias("q"), F.posexplode("grams").alias("q_place", "trigram")).where(F.col("q_place") <= F.col("q") - _least(F.col("q") * degree))
    shared = _least((F.col("q") + F.col("size")) * (degree / (1 + degree)))
    left = F.least(F.col("q") - F.col("q_place"), F.col("size") - F.col("place"))
    fits = (F.col("size") >= _least(F.col("q") * degree)) & (F.col("size") * degree <= F.col("q") + 1e-9) & (F.col("place") <= F.col("size") - _least(F.col("size") * degree)) & (left >= shared)
    return each.join(index.entries.hint("merge"), "trigram").where(fits).select("query_id", "id", "field")


def similarity_top(queries: DataFrame, index: SimilarityIndex, entities: DataFrame, threshold: float = 0.1, most: int | None = None, strict: Locale | None = None) -> DataFrame:
    """(query_id, id, fuzzy_score, pos): at most 2 x limit entities by the greatest padded_similarity of a field, beyond a threshold; only the location filters,
    with a locale as `strict` the category too.

    query_id tells queries apart. The rows of each degree are written as a small table.
    """
    wanted = F.col("category_slug") if strict else F.lit(None).cast("string")
    asked = queries.select("query_id", "limit", F.col("location_slug").alias("q_location"), wanted.alias("q_category"), F.explode_outer(padded_trigrams_of(F.col("normalized"))).alias("trigram"))
    rare = F.transform(F.sort_array(F.collect_list(F.when(F.col("trigram").isNotNull(), F.struct(F.coalesce("n", F.lit(0)), "trigram")))), lambda g: g["trigram"])
    open_ = materialize(asked.join(index.counts, "trigram", "left").groupBy("query_id", "limit", "q_location", "q_category").agg(rare.alias("grams")), "similar-queries")
    out, written = None, [open_]
    degrees = [d for d in DEGREES if d > threshold] + [threshold]
    for degree in degrees:
        pairs = met(open_, index, degree).distinct().join(index.fields.withColumnRenamed("grams", "held").hint("merge"), ["id", "field"]).join(open_, "query_id")
        if is_mapped(entities, "location_slug"):
            pairs = pairs.join(entities.select("id", "location_slug").hint("merge"), "id").where(at_location(F.col("location_slug"), F.col("q_location")))
        pairs = in_wanted_category(pairs, entities, strict)
        score = padded_similarity(F.col("grams"), F.col("held"))
        alike = pairs.withColumn("fuzzy_score", score).where(F.col("fuzzy_score") > threshold).groupBy("query_id", "id", "limit").agg(F.max("fuzzy_score").alias("fuzzy_score"))
        last = degree == threshold
        alike = alike if last else alike.where(F.col("fuzzy_score") >= degree)
        top = first_rows(alike, [F.desc(F.round("fuzzy_score", PLACES)), F.col("id")], 2, most)
        top = materialize(top.withColumn("many", F.col("pos") == 2 * F.col("limit")), "similar")
        written.append(top)
        full = top.where("many").select("query_id")
        done = top if last else top.join(full, "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        open_ = materialize(open_.join(full, "query_id", "left_anti"), "similar-queries")
        written.append(open_)
        if open_.isEmpty():
            break
    found = materialize(out.select("query_id", "id", "fuzzy_score", "pos"), "similar-top")
    for table in written:
        discard(table)
    return found
