"""Candidates against SQLite's FTS5, the engine's branches, the resolver, lookups and indexes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.locale import POLISH
from lodeseek.operators import candidates, index, lookups, resolver
from lodeseek.operators.mapping import EntityMapping, map_entities
from lodeseek.plans import fixtures as fx
from lodeseek.plans.engine import QUERY_SCHEMA, SYNONYM_SCHEMA, Search, SearchConfig

NAMES = ["hot yoga studio", "hatha yoga", "hot stone", "yin", "power yoga hot", "hathor temple", "yoga yoga yoga", "pilates hot yogurt"]


@pytest.fixture(scope="module")
def studios(spark):
    rows = [(i, n, "Yoga" if i % 2 else "Spa", "Kraków" if i < 5 else "Łódź", 50.0 + i / 20, 20.0) for i, n in enumerate(NAMES)]
    df = spark.createDataFrame([*rows, (90, None, None, None, None, None)], "key long, name string, kind string, city string, y double, x double")
    return map_entities(df, EntityMapping("key", "name", categories="kind", location="city", lat="y", lng="x", locale=POLISH)).cache()


def test_mapping_rejects_missing_columns(spark):
    with pytest.raises(ValueError, match="nope"):
        map_entities(spark.range(1), EntityMapping("id", "nope"))


def test_bm25_equals_fts5(spark, studios):
    rows = studios.collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(name, categories, location)")
    for r in rows:
        db.execute("INSERT INTO f(rowid, name, categories, location) VALUES (?, ?, ?, ?)", (r.id + 1, r.name_n, r.categories_n, r.location_n))
    terms = [(1, "yog"), (2, "hot"), (2, "hat"), (3, "hot yo"), (4, "k"), (5, "zzz"), (6, "yoga")]
    got = candidates.bm25(spark.createDataFrame(terms, "query_id long, term string"), index.text_index(studios)).collect()
    for q in {q for q, _ in terms}:
        match = " OR ".join(f'"{t}"*' for k, t in terms if k == q)
        want = {i - 1: rank for i, rank in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        mine = {r.id: r.fts_rank for r in got if r.query_id == q}
        assert mine == pytest.approx(want, abs=1e-9)


def run(spark, studios, query, **more):
    row = {"query_id": 1, "query": query, "location_slug": None, "category_slug": None, "lat": None, "lng": None, "limit": None, "offset": None} | more
    synonyms = spark.createDataFrame([("gorace", "hot", "style", 1)], SYNONYM_SCHEMA)
    s = Search(studios, spark.createDataFrame([row], QUERY_SCHEMA), synonyms, SearchConfig(locale=POLISH))
    return [(r.section, r.id) for r in s.results().orderBy("section", "rank").collect()], s.summary().first()


def test_search_branches(spark, studios):
    found, summary = run(spark, studios, "hatha")
    assert found[0] == ("primary", 1) and summary.searched_place == "hatha" and summary.total_found == len(found) and not summary.no_local_results
    assert run(spark, studios, "gorace")[0], "synonym"
    found, _ = run(spark, studios, "hata yoga", location_slug="krakow")
    assert ("primary", 1) in found, "one edit passes the gate"
    found, summary = run(spark, studios, "", location_slug="krakow", limit=3)
    assert [i for _, i in found] == [0, 1, 2] and summary.searched_place is None and summary.total_found == 3
    found, summary = run(spark, studios, "  ", lat=50.0, lng=20.0)
    assert found[0] == ("primary", 0) and not summary.no_local_results
    found, summary = run(spark, studios, "blisko mnie", lat=10.0, lng=10.0)
    assert found == [] and summary.no_local_results and summary.total_found == 0
    found, summary = run(spark, studios, "!!!", lat=50.0, lng=20.0)
    assert found == [] and summary.no_local_results and summary.searched_place == ""
    found, summary = run(spark, studios, None)
    assert found == [] and not summary.no_local_results
    found, summary = run(spark, studios, "yoga", offset=50)
    assert found == [] and summary.no_local_results and summary.total_found > 0
    found, _ = run(spark, studios, "hot", lat=50.0, lng=20.0)
    assert ("primary", 0) in found and ("nearby", 4) in found and all(i != 7 for _, i in found)


def test_partitions_do_not_matter(spark, studios):
    def ranked():
        s = Search(studios, fx.queries(spark), fx.synonyms(spark), SearchConfig(locale=POLISH))
        return sorted((r.query_id, r.section, r["rank"], r.id) for r in s.results().select("query_id", "section", "rank", "id").collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = ranked()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ranked() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parse_queries(spark):
    locations = lookups.location_lookup(spark.createDataFrame([r for r in fx.LOCATIONS if r[2] != 5], "name_n string, slug string, ordinal int"))
    categories = lookups.category_lookup(spark.createDataFrame([("hatha", "hatha-yoga", None, 1), ("vinyasa", "vinyasa-yoga", None, 2), ("yin", "yin-yoga", None, 3)], "name_n string, slug string, aliases_n string, ordinal int"))
    got = {r.query_id: r for r in resolver.parse_queries(spark.createDataFrame(fx.RAW, "query_id long, query string"), locations, categories, POLISH).collect()}
    slug = lambda x: x and x.slug
    assert (slug(got[1].location), slug(got[1].category), got[1].rest) == ("krakow", None, [])
    assert slug(got[2].category) == "hatha-yoga" and slug(got[3].location) == "krakow" and got[4].geo_intent
    assert got[5].postal == "30-001" and slug(got[5].category) == "hatha-yoga"
    assert slug(got[6].location) == "zielona-gora" and got[6].rest == ["zielona", "gora"]
    assert got[7].normalized == "" and got[11].normalized == "" and slug(got[8].location) == "krakow" and "mokotow" in got[9].rest
    assert not got[10].geo_intent and got[10].working == ""


def test_lookups_and_places(spark):
    base = spark.createDataFrame([("krakow", "krakow"), ("lodz", "lodz")], "name string, slug string")
    rows = spark.createDataFrame(fx.PLACE_SYNONYMS, "alias string, canonical string, category string, ordinal int")
    got = dict(lookups.with_synonyms(base, rows, ("city", "location"), POLISH).collect())
    assert got == {"krakow": "krakow", "lodz": "lodz", "cracovia": "krakow", "boat town": "lodz", "manufacture": "lodz"}
    areas = dict(lookups.area_lookup(spark.createDataFrame([("a", "[\"Podgórze\"]"), ("b", "broken"), ("c", None)], "location_slug string, areas_json string"), POLISH).collect())
    assert areas == {"a": ["podgorze"], "b": [], "c": []}
    stats = spark.createDataFrame(fx.STATS, "slug string, name string, lat double, lng double, count long, ordinal int")
    near = {r.query_id: r.slug for r in resolver.nearest_location(spark.createDataFrame(fx.POINTS[:3], "query_id long, lat double, lng double, exclude_slug string"), stats).collect()}
    assert near[1] == "lodz" and near[2] != "krakow"


def test_index_maintenance(spark, studios):
    grams = index.trigram_index(studios)
    changed = studios.where("id = 1").withColumn("name_n", F.lit("zzz"))
    after = index.replace_entries(grams, changed, index.trigram_index)
    assert {r.trigram for r in after.where("id = 1 and field = 'name'").collect()} == {"zzz"}
    assert after.where("id <> 1").count() == grams.where("id <> 1").count()
    report = index.sync_report(studios, studios.select("id").where("id <> 3").union(spark.createDataFrame([(77,)], "id long"))).first()
    assert tuple(report) == (9, 9, 1, 1)
    assert tuple(index.sync_report(studios.limit(0), studios.select("id").limit(0)).first()) == (0, 0, 0, 0)


def test_tables_of_entities_are_not_broadcast(spark, studios):
    """However small their files are: the plans of a search send no table that grows with the entities through the driver."""
    queries = spark.createDataFrame([(1, "yoga", None, None, None, None, 20, 0)], QUERY_SCHEMA)
    search = Search(studios, queries, spark.createDataFrame([], SYNONYM_SCHEMA), SearchConfig(locale=POLISH))
    for stage in (search.ranked, search.scored, candidates.fuzzy_top(search.text, search.indexes.trigrams, studios)):
        optimized = stage._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in optimized
    search.close()
