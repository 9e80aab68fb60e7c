"""Ranking: merge of candidates, blended score, quality gate, split by radius and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, walking_minutes
from ..functions.text import jaccard, levenshtein_similarity, trigrams_of
from .candidates import PLACES

#: Weights of the score, and the distance at which nearness ends.
W_FTS, W_NAME, W_FIELD, W_FUZZY, W_NEAR, W_INTENT = 0.40, 0.25, 0.15, 0.30, 0.15, 0.25
NEAR_KM, RANK_SCALE = 30.0, 20.0


def merge(fts: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Full-text rows, then fuzzy ones; of an entity found by both the full-text row stays, without a fuzzy score."""
    one = fts.select("query_id", "id", "fts_rank", F.lit(None).cast("double").alias("fuzzy_score"), F.lit(0).alias("source"), "pos")
    two = fuzzy.select("query_id", "id", F.lit(None).cast("double").alias("fts_rank"), "fuzzy_score", F.lit(1).alias("source"), "pos")
    first = Window.partitionBy("query_id", "id").orderBy("source", "pos")
    return one.unionByName(two).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def score(merged: DataFrame, queries: DataFrame, entities: DataFrame, positive_rank: bool = False) -> DataFrame:
    """merged with the entities' columns, score, distance_km, walking_min and has_fts."""
    asked = queries.select("query_id", "normalized", "geo_intent", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), trigrams_of(F.col("normalized")).alias("grams"))
    rows = merged.join(asked, "query_id").join(entities.select("id", "name", "slug", "lat", "lng", "name_n", "categories_n", "location_n").hint("merge"), "id")
    rank = F.col("fts_rank") if positive_rank else F.greatest(F.lit(0.0), -F.col("fts_rank") / RANK_SCALE)
    alike = lambda c: jaccard(F.col("grams"), trigrams_of(F.col(c)))
    rows = rows.withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng")))
    near = F.greatest(F.lit(0.0), 1 - F.col("distance_km") / NEAR_KM)
    total = (
        F.coalesce(F.least(F.lit(1.0), rank), F.lit(0.0)) * W_FTS
        + F.greatest(alike("name_n"), levenshtein_similarity(F.col("normalized"), F.col("name_n"))) * W_NAME
        + F.greatest(alike("categories_n"), alike("location_n")) * W_FIELD
        + F.coalesce("fuzzy_score", F.lit(0.0)) * W_FUZZY
        + F.coalesce(near, F.lit(0.0)) * (W_NEAR + F.when(F.col("geo_intent"), W_INTENT).otherwise(0.0))
    )
    return rows.withColumns({"score": total, "walking_min": walking_minutes(F.col("distance_km")), "has_fts": F.col("fts_rank").isNotNull()})


def passes_gate(normalized: Column, has_fts: Column, *texts: Column, threshold: float = 0.75) -> Column:
    """Full-text hits pass; others need one text whole within the edit similarity."""
    return has_fts | (F.greatest(*[levenshtein_similarity(normalized, t) for t in texts]) >= threshold)


def gate(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    return scored.where(passes_gate(F.col("normalized"), F.col("has_fts"), F.col("name_n"), F.col("location_n"), F.col("categories_n"), threshold=threshold))


def section(distance: Column, primary_km: float, nearby_km: float) -> Column:
    """primary for no distance or one up to primary_km, nearby up to nearby_km, else null."""
    return F.when(distance.isNull() | (distance <= primary_km), "primary").when(distance <= nearby_km, "nearby")


def split(gated: DataFrame, queries: DataFrame, primary_km: float = 15.0, nearby_km: float = 30.0, max_nearby: int = 5) -> tuple[DataFrame, DataFrame]:
    """The pages, and (query_id, total_found, shown, nearby_shown) of queries with qualified rows.

    Queries with a location or without a point aren't split. Nearby rows ignore the offset.
    """
    asked = queries.select("query_id", "limit", "offset", (F.col("location_slug").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("by_radius"))
    rows = gated.join(asked, "query_id").withColumn("section", F.when(F.col("by_radius"), section(F.col("distance_km"), primary_km, nearby_km)).otherwise("primary")).where("section is not null")
    order = Window.partitionBy("query_id", "section").orderBy(F.desc(F.round("score", PLACES)), "source", "pos", "id")
    placed = rows.withColumn("place", F.row_number().over(order))
    on_page = F.when(F.col("section") == "primary", (F.col("place") > F.col("offset")) & (F.col("place") <= F.col("offset") + F.col("limit"))).otherwise(F.col("place") <= max_nearby)
    placed = placed.withColumn("on_page", on_page)
    counts = placed.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_found"), F.count(F.when(F.col("on_page"), 1)).alias("shown"))
    pages = placed.where("on_page").withColumn("rank", F.when(F.col("section") == "primary", F.col("place") - F.col("offset")).otherwise(F.col("place")).cast("int"))
    return pages, counts
