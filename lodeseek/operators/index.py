"""Trigram and inverted indexes: built in one pass, replaced in part, verified against the entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_of, trigrams_of
from .mapping import FIELDS, field_texts


def field_trigrams(entities: DataFrame, fields=FIELDS) -> DataFrame:
    """(trigram, id, field), each once where each id is."""
    return field_texts(entities, fields).select(F.explode(trigrams_of(F.col("text"))).alias("trigram"), "id", "field")


def trigram_index(entities: DataFrame, fields=FIELDS) -> DataFrame:
    """(trigram, id, field), each once, repeated ids or not."""
    return field_trigrams(entities, fields).distinct()


def replace_entries(index: DataFrame, changed: DataFrame, build) -> DataFrame:
    """An index with the entries of changed entities replaced by those that `build` makes of them."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").unionByName(build(changed))


def trigram_counts(index: DataFrame) -> DataFrame:
    """(trigram, n): how many entries each trigram has; queries probe their rarest ones alone."""
    return index.groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))


def entity_trigrams(index: DataFrame) -> DataFrame:
    """(id, held): the distinct trigrams of each entity in any field, which verify what the probes find."""
    return index.groupBy("id").agg(F.collect_set("trigram").alias("held"))


@dataclass
class TextIndex:
    """postings (token, id, field, tf, positions), docs (id, doc_len) and vocabulary (token), each token once."""

    postings: DataFrame
    docs: DataFrame
    vocabulary: DataFrame


def text_index(entities: DataFrame, fields=FIELDS) -> TextIndex:
    texts = field_texts(entities, fields).withColumn("tokens", tokens_of(F.col("text")))
    each = texts.select("id", "field", F.posexplode("tokens").alias("position", "token"))
    postings = each.groupBy("token", "id", "field").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    sizes = sum((F.size(tokens_of(F.col(c))) for _, c in fields), start=F.lit(0))
    return TextIndex(postings, entities.select("id", sizes.cast("long").alias("doc_len")), vocabulary_of(postings))


def vocabulary_of(postings: DataFrame) -> DataFrame:
    return postings.select("token").distinct()


def replace_text(index: TextIndex, changed: DataFrame, fields=FIELDS) -> TextIndex:
    """A text index with postings and lengths of the changed entities replaced, both from the same rows."""
    ids, new = changed.select("id").distinct(), text_index(changed, fields)
    postings = index.postings.join(ids, "id", "left_anti").unionByName(new.postings)
    return TextIndex(postings, index.docs.join(ids, "id", "left_anti").unionByName(new.docs), vocabulary_of(postings))


def search_text(entities: DataFrame, fields=FIELDS) -> DataFrame:
    """(id, search_text): the non-empty fields joined by spaces."""
    return entities.select("id", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for _, c in fields]).alias("search_text"))


def renormalize(raw: DataFrame, mapping, update=None) -> tuple[DataFrame, DataFrame, TextIndex]:
    """Entities mapped anew (after `update`, a DataFrame -> DataFrame, if any), with both indexes built from the new columns."""
    from .mapping import map_entities

    entities = map_entities(update(raw) if update else raw, mapping)
    return entities, trigram_index(entities), text_index(entities)


def sync_report(entities: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: in_entities, in_index, missing_from_index, orphaned_in_index. indexed holds the ids of the index, each once."""
    marks = entities.select("id", F.lit(1).alias("e"), F.lit(0).alias("i")).unionByName(indexed.select("id", F.lit(0).alias("e"), F.lit(1).alias("i")))
    both = marks.groupBy("id").agg(F.sum("e").alias("e"), F.sum("i").alias("i"))
    return both.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("in_entities"), F.coalesce(F.sum("i"), F.lit(0)).alias("in_index"),
        F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("e"))), F.lit(0)).alias("missing_from_index"), F.coalesce(F.sum(F.when(F.col("e") == 0, F.col("i"))), F.lit(0)).alias("orphaned_in_index"),
    )


def null_vectors(entities: DataFrame, vector: str) -> DataFrame:
    """One row as in sync_report for a vector column kept in the entity table itself: rows whose vector is null are missing."""
    missing = F.count(F.when(F.col(vector).isNull(), 1))
    return entities.agg(F.count(F.lit(1)).alias("in_entities"), (F.count(F.lit(1)) - missing).alias("in_index"), missing.alias("missing_from_index"), F.lit(0).cast("long").alias("orphaned_in_index"))


#: What a drift report compares: all that is indexed of an entity.
CONTENT = ("name_n", "categories_n", "location_n")


def fingerprints(rows: DataFrame, columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """(id, h): 64 bits of each row's id and content; nulls differ from empty texts."""
    return rows.select("id", F.xxhash64("id", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]).alias("h"))


def bucket_sums(prints: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, total, mixed): number, sum and exclusive or of the fingerprints of each bucket of ids. Worth keeping beside an index."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    return prints.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def drift(entities: DataFrame, indexed: DataFrame, columns: tuple[str, ...] = CONTENT, buckets: int = 65_536, sums: DataFrame | None = None) -> DataFrame:
    """(id, state) of ids whose content in the index isn't that of the entities: missing from the index, orphaned in it, or stale.

    Both sides have one row for each id. Buckets of ids are compared by the sums of their fingerprints first (sums: those kept of the index); only rows of
    buckets that differ are compared by id. Rows alike in 64 bits of hash count as equal.
    """
    mine, theirs = fingerprints(entities, columns), fingerprints(indexed, columns)
    sums = bucket_sums(theirs, buckets) if sums is None else sums
    both = bucket_sums(mine, buckets).alias("e").join(sums.alias("i"), F.col("e.bucket") == F.col("i.bucket"), "full")
    equal = F.col("e.n").eqNullSafe(F.col("i.n")) & F.col("e.total").eqNullSafe(F.col("i.total")) & F.col("e.mixed").eqNullSafe(F.col("i.mixed"))
    unequal = both.where(~equal).select(F.coalesce("e.bucket", "i.bucket").alias("bucket"))
    inside = lambda prints: prints.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).join(unequal, "bucket", "left_semi")
    marks = inside(mine).select("id", F.col("h").alias("e"), F.lit(None).cast("long").alias("i")).unionByName(inside(theirs).select("id", F.lit(None).cast("long").alias("e"), F.col("h").alias("i")))
    met = marks.groupBy("id").agg(F.max("e").alias("e"), F.max("i").alias("i"))
    state = F.when(F.col("i").isNull(), "missing").when(F.col("e").isNull(), "orphaned").when(F.col("e") != F.col("i"), "stale")
    return met.select("id", state.alias("state")).where("state is not null")
