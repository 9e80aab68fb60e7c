"""Inline inputs of the registered queries: the same rows as Spark DataFrames and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import QUERY_SCHEMA, SYNONYM_SCHEMA

#: query_id, query, location_slug, category_slug, lat, lng, limit, offset
QUERIES = [
    (1, "small ring", None, None, None, None, 20, 0),
    (2, "smal rng", None, None, None, None, 20, 0),
    (3, "anv", None, None, None, None, 20, 0),
    (4, "red widget", "brand-17", None, None, None, 20, 0),
    (5, "blue bolt", None, "economy", None, None, 20, 0),
    (6, "gizmo near me", None, None, 51.5, 18.2, 20, 0),
    (7, "", None, None, None, None, 20, 0),
    (8, "   ", None, None, 51.5, 18.2, 10, 0),
    (9, "!!!", None, None, None, None, 20, 0),
    (10, "near me", "brand-3", None, None, None, 8, 0),
    (11, "blisko mnie", None, None, 52.1, 20.4, 5, 0),
    (12, "hot gear", None, None, 50.9, 17.0, 20, 0),
    (13, "ring", None, None, None, None, 20, 1000),
    (14, "gadget", None, None, None, None, 20, 0),
    (15, "bielsko-biała", None, None, None, None, 20, 0),
    (16, "wheel thing", None, None, None, None, 20, 0),
    (17, "larg anvl", "brand-4", None, 51.0, 19.0, 20, 0),
    (18, None, "brand-12", "small", 51.0, 19.0, 6, 0),
    (19, "widgt", None, None, None, None, 20, 0),
    (20, "promoo", None, None, None, None, 12, 0),
    (21, "old", None, None, None, None, 5, 3),
    (22, "rd", None, None, None, None, 20, 0),
]
SYNONYMS = [("gadget", "gizmo", "style", 1), ("wheel thing", "cold gear", "style", 2), ("tiny", "small", "style", 3), ("thing", "widget", "style", 4), ("gadget", "red rod", "style", 5)]
#: name_n, slug, ordinal
LOCATIONS = [("krakow", "krakow", 1), ("warszawa", "warszawa", 2), ("lodz", "lodz", 3), ("zielona gora", "zielona-gora", 4), ("lodz", "lodz-2", 5), ("pusta", "", 6)]
#: name_n, slug, aliases_n, ordinal
CATEGORIES = [("hatha", "hatha-yoga", "hata", 1), ("vinyasa flow", "vinyasa-yoga", None, 2), ("yin", "yin-yoga", "spokojna cicha", 3), ("power flow", "power-yoga", "yin", 4)]
#: slug, name, lat, lng, count, ordinal
STATS = [("krakow", "Kraków", 50.06, 19.94, 15, 1), ("warszawa", "Warszawa", 52.23, 21.01, 20, 2), ("lodz", "Łódź", 51.77, 19.45, 5, 3), ("zielona-gora", "Zielona Góra", 51.94, 15.5, 0, 4), ("bez-mapy", "Bez mapy", None, None, 3, 5)]
#: location_slug, areas_json
AREAS = [("krakow", '["Zwierzyniec", "Krowodrza", "Podgórze"]'), ("warszawa", '["Mokotów", "Ursynów", "Wola"]'), ("lodz", None), ("gdynia", "")]
PLACE_SYNONYMS = [("Cracovia", "Kraków", "city", 1), ("Lodz City", "boat town", "city", 2), ("boat town", "Łódź", "location", 3), ("manufacture", "boat town", "city", 4), ("wawa", "warszawa", "style", 5)]
#: query_id, query
RAW = [(1, "Kraków"), (2, "hatha"), (3, "hatha Kraków"), (4, "hatha blisko mnie"), (5, "30-001 hatha"), (6, "zielona góra"), (7, ""), (8, "joga w Krakowie"), (9, "Kraków mokotów"), (10, "joga blisko mnie"), (11, None), (12, "vinyasa flow 30123 Łodzi"), (13, "cicha joga near me")]
#: query_id, query, location_slug
AREA_QUERIES = [(1, "zwierzyniec", "krakow"), (2, "bielany", "krakow"), (3, "mokotow", "krakow"), (4, "joga Mokotów wola", "warszawa"), (5, "wola", "nowhere"), (6, "podgorzem", "krakow")]
#: query_id, lat, lng, exclude_slug
POINTS = [(1, 51.94, 15.5, None), (2, 50.06, 19.94, "krakow"), (3, 52.0, 21.0, None), (4, None, 21.0, None)]
#: query_id, name
CITIES = [(i, c) for i, c in enumerate(["Kraków", "Warszawa", "Łódź", "Wrocław", "Bielany Wrocławskie", "Suchy Las", "Nowa Sól", "Bielsko-Biała", "Zakopane", " Ustka ", "Zamość", "Malbork", "Ostrów Wielkopolski", "Grudziądz", "Police", "Nowy Targ"], 1)]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def queries(spark: SparkSession) -> DataFrame:
    return frame(spark, QUERIES, QUERY_SCHEMA)


def synonyms(spark: SparkSession) -> DataFrame:
    return frame(spark, SYNONYMS, SYNONYM_SCHEMA)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def literal_row(row: tuple) -> str:
    return "(" + ", ".join(map(literal, row)) + ")"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of the rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join(map(literal_row, rows)) + ")"
