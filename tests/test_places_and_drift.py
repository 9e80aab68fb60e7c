"""Nearest places anywhere on the globe, drift by content, exact folding, and budgets of the search's branches."""

from __future__ import annotations

import math
import random
import sys
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.text import expanding, strip_diacritics
from lodeseek.operators import index, resolver
from lodeseek.operators.mapping import EntityMapping, map_entities
from lodeseek.plans import budget
from lodeseek.plans.engine import QUERY_SCHEMA, SYNONYM_SCHEMA, Search, SearchConfig

POINTS = "query_id long, lat double, lng double, exclude_slug string"
PLACES = "slug string, name string, lat double, lng double, count long, ordinal int"


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("sides", [resolver.CELLS, ()])
def test_the_nearest_place_equals_all_pairs(spark, monkeypatch, sides):
    monkeypatch.setattr(resolver, "FEW", 3)
    rnd = random.Random(11)
    anywhere = lambda: (math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180))
    places = [(f"s{i % 70}", f"n{i}", *anywhere(), rnd.randrange(3), i) for i in range(120)]
    places += [(f"c{i % 2}", f"c{i}", 40.0, 179.999, 1, 1000 + i) for i in range(40)] + [("crowd", f"t{i}", 10 + i * 1e-4, 20.0, 1, 2000 + i) for i in range(60)]
    places += [("pole", "p", 90.0, 0.0, 1, 3000), ("south", "q", -90.0, 77.0, 1, 3001), (None, "unnamed", 0.0, 0.0, 1, 3002), ("bad", "b", 91.0, 0.0, 1, 1), ("bad", "b", None, 0.0, 1, 2), ("bad", "b", 0.0, float("nan"), 1, 3)]
    points = [(i, *anywhere(), rnd.choice([None, "s3", "crowd", "c0", "pole"])) for i in range(80)]
    points += [(900, 90.0, 12.0, "pole"), (901, -89.99, -179.9, None), (902, 40.0, -179.999, "c0"), (903, 40.0, 180.0, "c1"), (904, 10.003, 20.0, None), (905, 10.003, 20.0, "crowd"), (906, None, 1.0, None), (907, 1.0, float("nan"), None), (908, 0.001, 0.001, None)]
    near = resolver.nearest_location(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), sides)
    got = {r.query_id: (r.name, r.distance_km, r["count"]) for r in near.collect()}
    assert len(got) == len(points)
    fine = [p for p in places if p[4] > 0 and p[2] is not None and abs(p[2]) <= 90 and not math.isnan(p[3])]
    for i, lat, lng, excluded in points:
        if lat is None or math.isnan(lng):
            assert got[i] == (None, None, None)
            continue
        d, _, name, n = min((round(km(lat, lng, p[2], p[3]), 9), p[5], p[1], p[4]) for p in fine if p[0] != excluded)
        assert got[i] == (name, math.floor(d + 0.5), n), i


def test_no_place_is_near_where_there_is_none(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 1.0, 1.0, "only")], POINTS)
    none = resolver.nearest_location(points, spark.createDataFrame([], PLACES)).collect()
    assert sorted((r.query_id, r.slug) for r in none) == [(1, None), (2, None)]
    one = resolver.nearest_location(points, spark.createDataFrame([("only", "o", -50.0, 170.0, 1, 1)], PLACES)).collect()
    assert sorted((r.query_id, r.slug or "") for r in one) == [(1, "only"), (2, "")]


def test_crowded_cells_neither_sort_nor_shuffle_pairs(spark, monkeypatch):
    """Points meet the spots around them within a row, and what is returned reads settled rows alone, once for each point."""
    monkeypatch.setattr(resolver, "LISTED_BITS", 2)
    places = spark.createDataFrame([(f"s{i}", f"n{i}", 50 + i % 20 * 1e-3, 20 + i // 20 * 1e-3, 1, i) for i in range(400)], PLACES)
    points = spark.createDataFrame([(i, 50 + i % 21 * 1e-3, 20 + i % 19 * 1e-3, f"s{i % 5}") for i in range(300)], POINTS)
    near = resolver.nearest_location(points, places, (0.125,))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and near.count() == 300
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, resolver.nearest_location(points, places, ()).collect()))


def test_drift_names_ids_and_reads_unequal_buckets_alone(spark):
    columns = "id long, name_n string, categories_n string, location_n string"
    rows = [(i, f"n{i}", None if i % 5 else "", "x") for i in range(500)]
    entities = spark.createDataFrame(rows, columns)
    held = [r for r in rows if r[0] not in (3, 4)] + [(1000, "n", None, None)]
    held = [(i, n + "!" if i == 7 else n, "" if i == 11 else c, o) for i, n, c, o in held]
    indexed = spark.createDataFrame(held, columns)
    want = {3: "missing", 4: "missing", 7: "stale", 11: "stale", 1000: "orphaned"}
    assert dict(index.drift(entities, indexed, buckets=64).collect()) == want
    assert dict(index.drift(entities, indexed, buckets=1).collect()) == want
    sums = index.bucket_sums(index.fingerprints(indexed), 64)
    assert dict(index.drift(entities, indexed, buckets=64, sums=sums).collect()) == want
    assert index.drift(entities, entities).count() == 0 and index.drift(entities.limit(0), entities.limit(0)).count() == 0
    assert index.drift(entities, entities.limit(0)).count() == 500


def test_folding_equals_unicodedata_on_all_code_points(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c), f"a{chr(c)}Ł{chr(c)}") for c in codes], "one string, more string")
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")
    wrong = [r for r in rows.select("one", strip_diacritics(F.col("one")).alias("got"), strip_diacritics(F.col("more")).alias("more")).collect() if (r.got, r.more) != (plain(r.one), plain(f"a{r.one}Ł{r.one}"))]
    # A mark outside the range may only change its place.
    assert not [r for r in wrong if sorted(r.more) != sorted(plain(f"a{r.one}Ł{r.one}")) or r.got != plain(r.one)]
    assert len(expanding()) < 1000 and len(wrong) < 10
    assert "PythonUDF" not in rows.select(strip_diacritics(F.col("one")))._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def slow_search(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "blue bolt", None, None) for i in range(3)], "id long, name string, kind string, city string")
    entities = map_entities(rows, EntityMapping("id", "name", categories="kind", location="city"))
    asked = spark.createDataFrame([(1, "blue bold", None, None, None, None, 5, 0)], QUERY_SCHEMA)

    def slow(ranked, *args, **kwargs):
        wait = F.udf(lambda x: time.sleep(60) or x, "double")
        return original(ranked.withColumn("fts_rank", wait("fts_rank")), *args, **kwargs)

    from lodeseek.operators import candidates

    original = candidates.fts_top
    monkeypatch.setattr(candidates, "fts_top", slow)

    def search(**config):
        return Search(entities, asked, spark.createDataFrame([], SYNONYM_SCHEMA), SearchConfig(**config))

    return search


def test_a_branch_beyond_its_budget_gives_no_rows_and_stops(spark, slow_search):
    search = slow_search(fts_seconds=4.0, fuzzy_seconds=120.0)
    began = time.monotonic()
    found = search.results().collect()
    assert time.monotonic() - began < 50 and search.timed_out == ["fts"]
    assert {r.id for r in found} == {0, 1, 2} and search.fts.count() == 0 and search.fuzzy.count() == 3
    tracker = spark.sparkContext.statusTracker()
    deadline = time.monotonic() + 20
    while tracker.getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds(), "its jobs were cancelled"
    search.close()


def test_what_begins_after_the_deadline_is_cancelled_too(spark):
    ran = []

    def jobs():
        for i in range(200):
            spark.range(1).count()
            ran.append(i)

    assert budget.within(spark, 0.6, jobs, "late") == "late"
    time.sleep(3)
    so_far = len(ran)
    time.sleep(1)
    assert len(ran) == so_far < 200
