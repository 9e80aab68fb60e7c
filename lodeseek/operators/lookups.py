"""Lookup tables of the resolver: names to slugs, areas, counts. Where keys repeat, the order of the source rows (ordinal) decides."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize
from .ordered import handed_down, last_before, numbered, reaches


def location_lookup(locations: DataFrame) -> DataFrame:
    """(name, slug) from (name_n, slug, ordinal): of equal names the last."""
    return locations.groupBy(F.col("name_n").alias("name")).agg(F.max_by("slug", "ordinal").alias("slug"))


def category_lookup(categories: DataFrame) -> DataFrame:
    """(name, slug) from (name_n, slug, aliases_n, ordinal).

    Names and aliases: the last wins, an alias after its own row's name. Words of names over 2 characters stand only for keys that are neither, the first
    wins.
    """
    source = categories.select("slug", "ordinal", "name_n", F.split(F.coalesce("aliases_n", F.lit("")), r"\s+").alias("aliases"))
    named = source.select(F.col("name_n").alias("name"), "slug", F.struct("ordinal", F.lit(0).alias("k"), F.lit(0).alias("i")).alias("place"), F.lit(True).alias("own"))
    aliased = source.select("slug", "ordinal", F.posexplode("aliases").alias("i", "name")).where("name <> ''").select("name", "slug", F.struct("ordinal", F.lit(1).alias("k"), "i").alias("place"), F.lit(True).alias("own"))
    derived = source.select("slug", "ordinal", F.posexplode(F.split("name_n", r"\s+")).alias("i", "name")).where("length(name) > 2").select("name", "slug", F.struct("ordinal", F.lit(0).alias("k"), "i").alias("place"), F.lit(False).alias("own"))
    each = named.unionByName(aliased).unionByName(derived)
    found = each.groupBy("name").agg(F.max_by("slug", F.when(F.col("own"), F.col("place"))).alias("last"), F.max("own").alias("own"), F.min_by("slug", "place").alias("first"))
    return found.select("name", F.when(F.col("own"), F.col("last")).otherwise(F.col("first")).alias("slug"))


def with_synonyms(lookup: DataFrame, synonyms: DataFrame, kinds: tuple[str, ...], locale) -> DataFrame:
    """lookup with the aliases of synonyms (alias, canonical, category, ordinal) of the given kinds. Materialized.

    Rows apply in order, of equal ordinals by alias and canonical: an alias gets the slug that its canonical has by then, so a chain resolves only forwards; a
    row whose canonical has none by then does nothing. Each row points to the last one before it that names its canonical. Which rows do anything
    is found first, by reaching back to a name of the lookup; then slugs are handed down along the pointers between those.
    """
    rows = synonyms.where(F.col("category").isin(*kinds)).select("ordinal", locale.normalize(F.col("alias")).alias("alias"), locale.normalize(F.col("canonical")).alias("canonical"))
    rows = numbered(rows, "ordinal", "alias", "canonical")
    known = lookup.where("slug is not null and slug <> ''").select(F.col("name").alias("canonical"), F.col("slug").alias("root"))
    rooted = materialize(rows.join(known, "canonical", "left").select("k", "alias", "canonical", "root"), "synonyms")
    events = rooted.select(F.col("alias").alias("name"), "k")
    back = last_before(rooted.select(F.col("canonical").alias("name"), "k"), events).select("k", F.col("before").alias("source"))
    again = last_before(events, events).select("k", F.col("before").alias("earlier"))
    edges = materialize(rooted.select("k", "root").join(back, "k").join(again, "k"), "edges")
    to = F.array_distinct(F.array_compact(F.array("source", "earlier")))
    defined = reaches(edges.select("k", F.when(F.col("root").isNotNull(), True).alias("yes"), to.alias("to")))
    acts = edges.join(defined.where("yes").select(F.col("k").alias("source"), "yes"), "source", "left").where("root is not null or yes").select("k")
    acting = materialize(rooted.join(acts, "k"), "acting")
    up = last_before(acting.select(F.col("canonical").alias("name"), "k", "root"), acting.select(F.col("alias").alias("name"), "k"))
    given = handed_down(up.select("k", F.when(F.col("before").isNull(), F.col("root")).alias("value"), F.col("before").alias("up")))
    last = acting.select("k", F.col("alias").alias("name")).join(given, "k").groupBy("name").agg(F.max_by("value", "k").alias("slug"))
    out = materialize(lookup.join(last.select("name"), "name", "left_anti").unionByName(last.select(*lookup.columns)), "lookup")
    for table in (rows, rooted, edges, acting):
        discard(table)
    return out


def area_lookup(areas: DataFrame, locale) -> DataFrame:
    """(location_slug, areas) from (location_slug, areas_json): normalised, in order; null, empty and malformed JSON give none."""
    parsed = F.coalesce(F.from_json(F.nullif("areas_json", F.lit("")), "array<string>"), F.array().cast("array<string>"))
    return areas.select("location_slug", F.transform(parsed, locale.normalize).alias("areas"))


@dataclass
class Lookups:
    """(name, slug) of locations and of categories, (location_slug, areas), and the places with their counts."""

    locations: DataFrame
    categories: DataFrame
    areas: DataFrame | None
    places: DataFrame

    @property
    def tables(self) -> list[DataFrame]:
        return [t for t in (self.locations, self.categories, self.areas, self.places) if t is not None]


class LookupsLoader:
    """Keeps the resolver's lookups for a time. Sources are functions that return the tables as they are then.

    load() gives the lookups held, or loads them where none are held or `seconds` have passed; reload() always loads; invalidate() lets them go. Of callers
    at the same time one loads, and those that wait get what it loaded. Lookups are computed before the former ones go.
    """

    def __init__(self, locations: Callable[[], DataFrame], categories: Callable[[], DataFrame], locale, synonyms: Callable[[], DataFrame] | None = None, areas: Callable[[], DataFrame] | None = None, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.locations, self.categories, self.synonyms, self.areas = locations, categories, synonyms, areas
        self.locale, self.seconds, self.clock = locale, seconds, clock
        self._held: Lookups | None = None
        self._since = 0.0
        self._loads = 0
        self._one = threading.RLock()

    def load(self) -> Lookups:
        with self._one:
            if self._held is not None and self.clock() - self._since < self.seconds:
                return self._held
            return self._load()

    def reload(self) -> Lookups:
        before = self._loads
        with self._one:
            # A load that began after the call is as fresh as one of its own.
            return self._held if self._loads > before + 1 and self._held is not None else self._load()

    def _load(self) -> Lookups:
        places = self.locations()
        names, kinds = location_lookup(places), category_lookup(self.categories())
        if self.synonyms is not None:
            named = self.synonyms()
            names, kinds = with_synonyms(names, named, ("city", "location"), self.locale), with_synonyms(kinds, named, ("style", "category"), self.locale)
        areas = area_lookup(self.areas(), self.locale).persist() if self.areas else None
        held = Lookups(names.persist(), kinds.persist(), areas, places.persist())
        for table in held.tables:
            table.count()
        self.invalidate()
        self._held, self._since = held, self.clock()
        self._loads += 1
        return held

    def invalidate(self) -> None:
        with self._one:
            held, self._held = self._held, None
            for table in held.tables if held else ():
                table.unpersist()
