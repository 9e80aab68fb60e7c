"""Operators beyond the registered queries: unmapped columns, white space, repeated ids, loaders, sinks, budgets; candidates by brute force."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text
from lodeseek.functions.locale import GENERIC
from lodeseek.operators import candidates, index, lookups, resolver
from lodeseek.operators.mapping import EntityMapping, map_entities
from lodeseek.plans.budget import within
from lodeseek.plans.engine import QUERY_SCHEMA, SYNONYM_SCHEMA, Search, SearchConfig
from lodeseek.sources import tables
from lodeseek.operators.similarity import similarity_index, similarity_top


def test_filters_on_unmapped_columns_are_skipped(spark):
    rows = map_entities(spark.createDataFrame([(1, "red lamp"), (2, "red chair"), (3, "blue lamp")], "id long, name string"), EntityMapping("id", "name"))
    queries = spark.createDataFrame([(1, "red", None, None, None, None, None, None), (2, "red", "here", "chairs", None, None, None, None), (3, "redd", "here", "chairs", None, None, None, None)], QUERY_SCHEMA)
    for positive in (False, True):
        search = Search(rows, queries, spark.createDataFrame([], SYNONYM_SCHEMA), SearchConfig(positive_rank=positive))
        found = {}
        for r in search.fts.collect():
            found.setdefault(r.query_id, set()).add(r.id)
        assert found[1] == found[2] == {1, 2}
        assert {r.id for r in search.fuzzy.collect() if r.query_id == 3} >= {1, 2}
        search.close()


def test_a_query_of_white_space_of_any_kind_is_blank(spark):
    rows = map_entities(spark.createDataFrame([(1, "a", 50.0, 20.0)], "id long, name string, lat double, lng double"), EntityMapping("id", "name", lat="lat", lng="lng"))
    blanks = ["\t\n", "\u00a0 \u2003", "", None, "  "]
    queries = spark.createDataFrame([(i, t, None, None, 50.0, 20.0, None, None) for i, t in enumerate(blanks)], QUERY_SCHEMA)
    search = Search(rows, queries, spark.createDataFrame([], SYNONYM_SCHEMA))
    assert {r.route for r in search.queries.collect()} == {"geo"} and search.by_point.count() == len(blanks)
    search.close()


def test_points_that_are_no_points_have_no_nearest_place(spark):
    stats = spark.createDataFrame([("a", "A", 50.0, 20.0, 3, 0)], "slug string, name string, lat double, lng double, count long, ordinal int")
    points = spark.createDataFrame([(1, None, 20.0, None), (2, float("nan"), 20.0, None), (3, 50.0, 20.0, "a"), (4, 50.0, 20.0, None)], "query_id long, lat double, lng double, exclude_slug string")
    assert sorted((r.query_id, r.slug, r.distance_km) for r in resolver.nearest_location(points, stats).collect()) == [(1, None, None), (2, None, None), (3, None, None), (4, "a", 0)]


def test_indexes_of_repeated_ids_and_of_changed_entities(spark):
    mapping = EntityMapping("id", "name")
    make = lambda *rows: map_entities(spark.createDataFrame(rows, "id long, name string"), mapping)
    twice = index.trigram_index(make((1, "lamp"), (1, "lamp"), (2, "chair")))
    assert twice.count() == twice.distinct().count() == 2 + 3
    changed = index.replace_text(index.text_index(make((1, "red lamp"), (2, "chair"))), make((2, "blue old chair"), (3, "new")))
    fresh = index.text_index(make((1, "red lamp"), (2, "blue old chair"), (3, "new")))
    for a, b in ((changed.postings, fresh.postings), (changed.docs, fresh.docs), (changed.vocabulary, fresh.vocabulary)):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def grams_of(text):
    return {w[i : i + 3] for w in text.split() for i in range(max(len(w) - 2, 1))}


def padded_of(text):
    return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text) for i in range(len(w) + 1)}


def test_rarest_trigrams_find_what_all_of_them_find(spark):
    """Brute force over queries of 1 to 12 trigrams, some known to no entity, and a word that a third of the entities share."""
    pick = random.Random(5)
    words = ["".join(pick.choices("abc", k=pick.randint(1, 6))) for _ in range(40)]
    names = [" ".join([*(["common"] if i % 3 == 0 else []), *pick.choices(words, k=pick.randint(0, 3))]) for i in range(300)]
    kinds = [pick.choice(words) for _ in names]
    rows = map_entities(spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], "id long, name string, kind string"), EntityMapping("id", "name", categories="kind"))
    texts = ["", "common", "zzz", "ab", *(" ".join(pick.choices([*words, "common", "zzzzz"], k=pick.randint(1, 3))) for _ in range(30))]
    queries = spark.createDataFrame([(i, t, None, 1000) for i, t in enumerate(texts)], "query_id long, normalized string, location_slug string, limit int")
    grams = index.trigram_index(rows)
    fuzzy, similar = set(), set()
    for q, words_of in enumerate(texts):
        asked = grams_of(words_of)
        n = len(asked)
        least = max(1, n - 1) if n <= 3 else max(2, math.ceil(n * 0.45))
        for i, fields in enumerate(zip(names, kinds, strict=True)):
            of = [grams_of(f) for f in fields]
            shared = len(asked & (of[0] | of[1]))
            if asked and shared >= least:
                fuzzy.add((q, i, round(shared / n, 6)))
            best = max(len(padded_of(words_of) & g) / len(padded_of(words_of) | g) if g else 0.0 for g in map(padded_of, fields))
            if best > 0.1:
                similar.add((q, i, round(best, 6)))
    of = lambda df: {(r.query_id, r.id, round(r.fuzzy_score, 6)) for r in df.collect()}
    assert of(candidates.fuzzy_top(queries, grams, rows)) == fuzzy and of(similarity_top(queries, similarity_index(rows), rows)) == similar


def test_positive_rank_by_hand(spark):
    """Two tokens under one prefix, a token in two fields, a phrase, and a term that nothing has."""
    rows = map_entities(spark.createDataFrame([(1, "red rod red", "rodeo"), (2, "rod", "blue"), (3, "green", "grass")], "id long, name string, kind string"), EntityMapping("id", "name", categories="kind"))
    terms = spark.createDataFrame([(1, "rod"), (1, "red"), (1, "zzz"), (2, "red ro"), (3, "zzz")], "query_id long, term string")
    one, two = 0.1 / 1.64493406685, 0.1 * 1.25 / 1.64493406685
    found = {(r.query_id, r.id): r.fts_rank for r in candidates.positive_rank(terms, index.text_index(rows)).collect()}
    assert found == {(1, 1): pytest.approx((one + one + two) / 3), (1, 2): pytest.approx(one / 3), (2, 1): pytest.approx(one)}


def test_padded_trigrams(spark):
    found = spark.createDataFrame([("cat",), ("a-b a",), ("",), (None,), ("--",)], "t string").select(text.padded_trigrams_of(F.col("t"))).collect()
    assert [r[0] for r in found] == [["  c", " ca", "cat", "at "], ["  a", " a ", "  b", " b "], [], [], []]


def test_nearest_place_by_cells_equals_all_pairs(spark):
    """Points and places anywhere: near poles, the date line, equal places, points beyond 180 degrees and far from all places."""
    pick = random.Random(8)
    some = [(pick.uniform(45, 55), pick.uniform(10, 25)) for _ in range(60)] + [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(12)] + [(89.9, 0.0), (10.0, 179.95), (10.0, -179.95), (50.0, 20.0), (50.0, 20.0)]
    places = [(f"p{i}", f"P{i}", a, b, 1 + i % 2, i) for i, (a, b) in enumerate(some)] + [("empty", "E", 50.0, 20.0, 0, 999), ("nowhere", "N", None, 1.0, 3, 1000)]
    points = [(i, pick.uniform(44, 56), pick.uniform(8, 27), f"p{i % 70}") for i in range(150)] + [(200 + i, pick.uniform(-90, 90), pick.uniform(-180, 180), None) for i in range(80)]
    points += [(400, 10.0, 180.0, None), (401, 10.0, -180.0, None), (402, 90.0, 33.0, None), (403, 50.0, 20.0, None), (404, 50.0, 380.0, None), (405, None, 2.0, None), (406, float("nan"), 2.0, None)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    wanted = {}
    for i, lat, lng, slug in points:
        away = [(km(lat, lng, p[2], p[3]), p[5], p[0]) for p in places if p[4] > 0 and p[2] is not None and p[0] != slug] if lat is not None and lat == lat else []
        wanted[i] = min(away)[2] if away else None
    stats = spark.createDataFrame(places, "slug string, name string, lat double, lng double, count long, ordinal int")
    asked = spark.createDataFrame(points, "query_id long, lat double, lng double, exclude_slug string")
    rows = resolver.nearest_location(asked, stats).collect()
    assert len(rows) == len(points) and {r.query_id: r.slug for r in rows} == wanted
    assert all(r.slug is None for r in resolver.nearest_location(asked, stats.limit(0)).collect())


def test_cells_find_what_boxes_hold(spark):
    """Brute force with points near poles, the date line and beyond, where a box spans all longitudes."""
    pick = random.Random(6)
    points = [(i, pick.uniform(49, 51), pick.uniform(19, 21)) for i in range(200)]
    points += [(1000 + i, pick.choice([89.95, 90.0, -89.99, 95.0]), pick.uniform(-400, 400)) for i in range(60)] + [(2000, float("nan"), 0.0), (2001, 50.0, 180.0), (2002, None, 3.0)]
    rows = map_entities(spark.createDataFrame([(i, str(i), y, x) for i, y, x in points], "id long, name string, lat double, lng double"), EntityMapping("id", "name", lat="lat", lng="lng"))
    asked = [(0, 50.0, 20.0), (1, 50.9, 20.9), (2, 89.97, 10.0), (3, 90.0, -170.0), (4, -89.99, 179.9), (5, 50.0, 179.9), (6, 95.0, 0.0), (7, float("nan"), 1.0)]
    queries = spark.createDataFrame([(q, y, x, 10000) for q, y, x in asked], "query_id long, lat double, lng double, limit int")
    for km in (15.0, 60.0):
        expected = set()
        for q, y, x in asked:
            high, width = km / 111.32, math.cos(math.radians(y))
            wide = 360.0 if abs(width) < 1e-12 else km / (111.32 * width)
            expected |= {(q, i) for i, a, b in points if a is not None and y - high <= a <= y + high and x - wide <= b <= x + wide}
        assert {(r.query_id, r.id) for r in candidates.geo_scan(queries, rows, km).collect()} == expected


def test_lookups_loader_holds_reloads_and_lets_go(spark):
    now, loads = [0.0], []

    def locations():
        loads.append(1)
        return spark.createDataFrame([("krakow", f"krakow-{len(loads)}", 0)], "name_n string, slug string, ordinal int")

    categories = lambda: spark.createDataFrame([("pizza place", "pizza", "pie", 0)], "name_n string, slug string, aliases_n string, ordinal int")
    synonyms = lambda: spark.createDataFrame([("cracow", "krakow", "city", 0)], SYNONYM_SCHEMA)
    areas = lambda: spark.createDataFrame([("krakow", '["Stare Miasto"]')], "location_slug string, areas_json string")
    loader = lookups.LookupsLoader(locations, categories, GENERIC, synonyms, areas, 10, lambda: now[0])
    held = loader.load()
    assert dict(held.locations.collect()) == {"krakow": "krakow-1", "cracow": "krakow-1"} and loader.load() is held and held.areas.first().areas == ["stare miasto"]
    now[0] = 11.0
    assert dict(loader.load().locations.collect())["krakow"] == "krakow-2" and not held.locations.is_cached
    loader.invalidate()
    assert loader.load() is not held and len(loads) == 3
    loader.invalidate()


def test_event_stream_session_and_parameters(spark, tmp_path):
    assert tables.session_id(spark) == tables.session_id(spark) and len(tables.session_id(spark)) == 36
    rows = [("q", "q", "home", None, "search", None, 3, None, None, tables.session_id(spark))]
    spark.createDataFrame(rows, tables.EVENT_SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(tables.EVENT_SCHEMA).parquet(str(tmp_path / "in"))
        query = tables.stream_events(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert tables.read_sql(spark, "SELECT :a AS a", a="x' OR 1 = 1").first().a == "x' OR 1 = 1"


def test_budgets_cancel_what_takes_too_long_and_nothing_else(spark):
    def sleeping(batches):
        time.sleep(20)
        yield from batches

    slow = lambda: spark.range(2).mapInPandas(sleeping, "id long").collect()
    began = time.monotonic()
    assert within(spark, 1.0, slow, otherwise=[]) == [] and time.monotonic() - began < 10
    assert within(spark, 60.0, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, 60.0, lambda: 1 // 0)


def test_a_category_filters_the_fuzzy_branch_if_asked_to(spark):
    rows = [(i, "bakori", "tool" if i % 2 else "toy", None) for i in range(6)]
    entities = map_entities(spark.createDataFrame(rows, "id long, name string, kind string, city string"), EntityMapping("id", "name", categories="kind"))
    asked = spark.createDataFrame([(1, "bakorx", None, "tool", None, None, 20, 0)], QUERY_SCHEMA)
    for positive in (False, True):
        for strict, want in ((False, set(range(6))), (True, {1, 3, 5})):
            search = Search(entities, asked, spark.createDataFrame([], SYNONYM_SCHEMA), SearchConfig(strict_category=strict, positive_rank=positive))
            assert {r.id for r in search.fuzzy.collect()} == want
            search.close()


def test_a_database_is_read_by_a_query_and_in_parts(spark):
    url, driver = "jdbc:derby:memory:lodeseek;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id", "concat('place ', id) as name").write.format("jdbc").options(url=url, dbtable="places", driver=driver).mode("overwrite").save()
    some = tables.read_jdbc(spark, url, 'SELECT * FROM places WHERE "id" < 7', driver=driver)
    assert sorted(r.id for r in some.collect()) == list(range(7))
    whole = tables.read(spark, None, "jdbc", url=url, dbtable="places", driver=driver, partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 100
