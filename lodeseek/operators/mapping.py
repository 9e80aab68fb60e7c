"""How a table of entities maps to the columns that the operators read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locale import GENERIC, Locale


@dataclass(frozen=True)
class EntityMapping:
    """Column names of a raw table; those that are None are absent. Search texts are normalised here, once."""

    id: str
    name: str
    slug: str | None = None
    categories: str | None = None
    location: str | None = None
    location_slug: str | None = None
    lat: str | None = None
    lng: str | None = None
    extra: tuple[str, ...] = ()
    locale: Locale = field(default=GENERIC)


def slug_of(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit("-"))


def map_entities(df: DataFrame, m: EntityMapping) -> DataFrame:
    """id, name, slug, lat, lng, name_n, categories_n, location_n, location_slug and the extra columns. A missing column fails at once."""
    wanted = [c for c in (m.id, m.name, m.slug, m.categories, m.location, m.location_slug, m.lat, m.lng, *m.extra) if c]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    absent = {"mapped": False}
    text = lambda c: m.locale.normalize(F.col(c)) if c else F.lit("")
    number = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    location_slug = F.col(m.location_slug) if m.location_slug else slug_of(text(m.location)) if m.location else F.lit(None).cast("string")
    return df.select(
        F.col(m.id).alias("id"), F.col(m.name).alias("name"), (F.col(m.slug) if m.slug else slug_of(text(m.name))).alias("slug"),
        number(m.lat).alias("lat"), number(m.lng).alias("lng"),
        text(m.name).alias("name_n"), text(m.categories).alias("categories_n", metadata={} if m.categories else absent), text(m.location).alias("location_n"), location_slug.alias("location_slug", metadata={} if m.location or m.location_slug else absent),
        *[F.col(c) for c in m.extra],
    )


def is_mapped(entities: DataFrame, column: str) -> bool:
    """Does a column of mapped entities stand for one of the raw table? Filters on others are skipped. The mark is kept in the column's metadata."""
    return entities.schema[column].metadata.get("mapped", True)


#: Fields of the entities that are indexed, with the columns that hold their normalised texts.
FIELDS = (("name", "name_n"), ("categories", "categories_n"), ("location", "location_n"))


def field_texts(entities: DataFrame, fields=FIELDS, others: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, text) and other columns, one row for each non-empty field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in fields])
    return entities.select("id", *others, F.explode(pairs).alias("f")).select("id", "f.field", "f.text", *others).where("text is not null and text <> ''")
