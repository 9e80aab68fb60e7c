"""Scalar functions against golden rows and independent Python models."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import geo, text
from lodeseek.functions.locale import GENERIC, POLISH, polish_locative


def one(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).coalesce(1).select(column).collect()]


def model_normalize(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s or "") if not "̀" <= c <= "ͯ").lower()
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c in "-") else " " for c in s).split())


def model_trigrams(s):
    out = []
    for w in s.split(" ") if s else []:
        out += [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    return list(dict.fromkeys(out))


def test_strip_diacritics(spark):
    assert one(spark, ["café", "naïve", None, "한글é"], text.strip_diacritics(F.col("x")))[:3] == ["cafe", "naive", None]
    exact = one(spark, ["한글é", None, ""], text.strip_diacritics_exact(F.col("x")))
    assert exact == ["".join(c for c in unicodedata.normalize("NFD", "한글é") if not "̀" <= c <= "ͯ"), None, ""]


def test_normalize_golden_and_model(spark):
    cases = ["  Hello World  ", "yoga & pilates!", None, "", "Kraków", "Łódź", "a-b -- c", "ÀÉÎõü ß", "İstanbul", "x\ty\nz", "!!!", "é́", "日本 go"]
    got = one(spark, cases, text.normalize(F.col("x")))
    assert got[:3] == ["hello world", "yoga pilates", ""]
    assert got == [model_normalize(c) for c in cases]
    assert one(spark, ["Kraków", "Łódź"], POLISH.normalize(F.col("x"))) == ["krakow", "lodz"]


def test_trigrams_and_similarity(spark):
    cases = ["hatha", "ab", "", "aaa", "hot yoga a", "abcabc"]
    assert one(spark, cases, text.trigrams_of(F.col("x"))) == [model_trigrams(c) for c in cases]
    pairs = [("hatha", "hatha"), ("abc", "xyz"), ("hatha", "hata"), ("", ""), ("", "abc")]
    got = one(spark, pairs, text.jaccard(text.trigrams_of(F.col("a")), text.trigrams_of(F.col("b"))), "a string, b string")
    assert got == [1.0, 0.0, 0.25, 1.0, 0.0]
    got = one(spark, [("hata", "hatha"), ("inowroclaw", "wroclaw"), ("", "")], text.levenshtein_similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([0.8, 0.7, 1.0])


def test_postcodes_terms_and_overlap(spark):
    assert one(spark, ["30-001", "30001", "hello", "123456", " 30-001 "], text.is_postcode(F.col("x"))) == [True, True, False, False, True]
    got = one(spark, [(["bielsko-biala", "!!", "a", "b", "c", "d", "e", "f"],)], text.fts_terms(F.col("x")), "x array<string>")
    assert got == [["bielskobiala", "a", "b", "c", "d", "e"]]
    assert one(spark, [1, 2, 3, 4, 10], text.min_overlap(F.col("x")), "x int") == [1, 1, 2, 2, 5]
    assert one(spark, [(["a"],), (["a", "b", "c"],), ([],)], text.aliases_of(F.col("x")), "x array<string>") == [["a"], ["a", "b", "c", "a b", "b c"], []]


def test_geo_intent_and_stop_words(spark):
    cases = ["joga blisko mnie", "yoga near me", "yoga nearby", "hatha yoga"]
    assert one(spark, cases, POLISH.has_geo_intent(F.col("x"))) == [True, True, True, False]
    assert one(spark, ["blisko mnie"], GENERIC.has_geo_intent(F.col("x"))) == [False]
    assert one(spark, cases[:2], POLISH.strip_geo_intent(F.col("x"))) == ["joga", "yoga"]
    assert one(spark, ["Łnear me", "łnearby"], POLISH.has_geo_intent(F.col("x"))) == [False, False]
    stops = ["joga hatha", "szkola jogi krakow", "w krakowie na mokotowie", "joga yoga"]
    assert one(spark, stops, POLISH.strip_stop_words(F.col("x"))) == ["hatha", "krakow", "krakowie mokotowie", ""]


def test_stems_and_locatives(spark):
    stems = one(spark, ["krakowie", "warszawy", "krakow", "zielonej gory"], POLISH.stems(F.col("x")))
    assert "krakow" in stems[0] and "warszaw" in stems[1] and stems[2] == ["krakow"] and stems[3][0] == "zielonej gory" and len(stems[3]) > 1
    names = {"Kraków": "Krakowie", "Warszawa": "Warszawie", "Łódź": "Łodzi", "Katowice": "Katowicach", "Bielany Wrocławskie": "Bielanach Wrocławskich", "Suchy Las": "Suchym Lesie", "Malbork": "Malborku", "Ostrów Wielkopolski": "Ostrowie Wielkopolskim", "Lębork": "Lęborku", "Leszno": "Lesznie"}
    assert one(spark, list(names), polish_locative(F.col("x"))) == list(names.values())


def test_geo(spark):
    points = [(50.0647, 19.9450, 50.0647, 19.9450), (50.0647, 19.9450, 52.2297, 21.0122), (50.0647, 19.9450, 50.0647, 19.9590)]
    km = one(spark, points, geo.haversine_km(*map(F.col, "abcd")), "a double, b double, c double, d double")
    assert km[0] == 0 and 240 < km[1] < 260 and 0.5 < km[2] < 2
    assert one(spark, [1.0, 0.0], geo.walking_minutes(F.col("x")), "x double") == [16, 0]
    assert one(spark, [0.85, 2.3, 0.9996, 1.25, 1234.55], geo.format_distance(F.col("x")), "x double") == ["850 m", "2.3 km", "1000 m", "1.3 km", "1234.6 km"]
    assert one(spark, [12, 75, 120], geo.format_walking_time(F.col("x")), "x int") == ["12 min walk", "1 hr 15 min walk", "2 hr walk"]
    box = geo.bounding_box(F.lit(50.0), F.lit(20.0), F.lit(10.0))
    row = spark.range(1).select(*[v.alias(k) for k, v in box.items()]).first()
    assert 50 - row.min_lat == pytest.approx(row.max_lat - 50) and 20 - row.min_lng == pytest.approx(row.max_lng - 20)


def test_intent_and_rest_come_from_one_fold(spark):
    """Texts are folded once, and no pattern stands for texts that lack its letters."""
    said = ["Żółw BLISKO   mnie i dalej", "blisko", "nearme closest", "W  Okolicy, niedaleko", "étude Å 각 w poblizu", "", None, " x  y ", "najblizszy near me around me"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, q string").repartition(2)
    both = rows.select("i", POLISH.geo(F.col("q")).alias("geo"), POLISH.has_geo_intent(F.col("q")).alias("intent"), POLISH.strip_geo_intent(F.col("q")).alias("rest"))
    assert all((r.geo.intent, r.geo.rest) == (r.intent, r.rest) for r in both.collect())
    plan = rows.select("i", POLISH.geo(F.col("q")).alias("geo"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?!)" not in plan
    assert "x y" in {r.geo.rest for r in both.collect()}


def test_words_are_found_by_ranges(spark):
    """Runs of what is no letter, digit or hyphen become one space, whatever they are made of; blank is what trims to nothing."""
    every = "".join(map(chr, [*range(1, 0xD800, 1), *range(0xE000, 0x11000)]))
    rows = spark.createDataFrame([(every,), ("a  -b\t\n{|}~c,./:d",), (" 　 ﻿",), (" x",), ("",)], "t string")
    slow = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.translate(F.col("t"), text.folding(True)[0], text.folding(True)[1]), text.MARKS, "")), r"[^a-z0-9\s-]", " "), r"\s+", " "))
    got = rows.select(text.normalize(F.col("t")).alias("fast"), slow.alias("slow"), text.is_blank(F.col("t")).alias("blank"), (text.trimmed(F.col("t")) == "").alias("none")).collect()
    assert all(r.fast == r.slow and r.blank == r.none for r in got) and [r.blank for r in got] == [False, False, True, False, True]
