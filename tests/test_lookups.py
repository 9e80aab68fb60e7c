"""Ordered synonyms, areas in texts and the loader against plain models of what they mean."""

from __future__ import annotations

import random
import re
import threading

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lodeseek.functions.locale import GENERIC, POLISH, Locale
from lodeseek.operators import candidates, expansion, lookups, ordered, resolver
from lodeseek.operators.prefilter import may_be_among


def folded(lookup, rows, kinds):
    """The meaning: rows in order, each sees what those before it did."""
    state = {n: s for n, s in lookup}
    for _, alias, canonical in sorted((o, a, c) for a, c, k, o in rows if k in kinds):
        if state.get(canonical):
            state[alias] = state[canonical]
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_synonyms_apply_in_order(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "WINDOW_BITS", 3)
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    lookup = [("n0", "zero"), ("n1", "one"), ("n2", ""), ("n3", None), ("other", "o")]
    rows = [(rnd.choice(names), rnd.choice(names), rnd.choice(["city", "city", "style"]), rnd.randrange(150)) for _ in range(200)]
    rows += [("hot", rnd.choice(names), "city", 60 + i) for i in range(40)] + [("n9", "hot", "city", 70 + i) for i in range(20)] + [("n2", None, "city", 5)]
    got = lookups.with_synonyms(spark.createDataFrame(lookup, "name string, slug string"), spark.createDataFrame(rows, "alias string, canonical string, category string, ordinal int"), ("city",), GENERIC)
    plain = [(a, c or "", k, o) for a, c, k, o in rows]
    assert {r.name: r.slug for r in got.collect()} == folded(lookup, plain, ("city",)) and got.count() == len({r.name for r in got.collect()})


def test_long_chains_of_synonyms_take_few_rounds(spark):
    n, rounds = 600, []
    rows = [(f"c{i + 1}", f"c{i}", "city", i) for i in range(n)] + [(f"d{i}", f"d{i + 1}", "city", i) for i in range(50)]
    count = ordered.materialize
    ordered.materialize = lambda df, label: (rounds.append(label), count(df, label))[1]
    try:
        got = lookups.with_synonyms(spark.createDataFrame([("c0", "start"), ("d50", "end")], "name string, slug string"), spark.createDataFrame(rows, "alias string, canonical string, category string, ordinal int"), ("city",), GENERIC)
    finally:
        ordered.materialize = count
    assert {r.name: r.slug for r in got.collect()} == {f"c{i}": "start" for i in range(n + 1)} | {"d50": "end", "d49": "end"}, "a chain resolves forwards only"
    assert rounds.count("graph") <= 13 and rounds.count("handed") <= 13


def test_synonyms_of_empty_tables(spark):
    none = spark.createDataFrame([], "alias string, canonical string, category string, ordinal int")
    some = spark.createDataFrame([("a", "x")], "name string, slug string")
    assert [tuple(r) for r in lookups.with_synonyms(some, none, ("city",), GENERIC).collect()] == [("a", "x")]


def test_areas_in_texts_equal_brute_force(spark):
    rnd = random.Random(7)
    words = ["ab", "abc", "b", "nowa", "huta", "stare", "miasto", "ab-b"]
    name = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    areas = {f"p{i}": [name(rnd.randrange(1, 4)) for _ in range(rnd.randrange(0, 9))] for i in range(6)} | {"none": None, "blank": ["", None, "b"]}
    texts = [(i, name(rnd.randrange(0, 9)), rnd.choice([*areas, "unknown", None])) for i in range(300)] + [(900, None, "blank"), (901, "Ą nowa, Huta!", "p1")]

    def first(text, place):
        said = f" {' '.join(''.join(c if c.isalnum() or c == '-' else ' ' for c in (text or '').lower().replace('ą', 'a')).split())} "
        return next((a for a in areas.get(place) or [] if a is not None and f" {a} " in said), None)

    got = resolver.match_area(spark.createDataFrame(texts, "query_id long, query string, location_slug string"), spark.createDataFrame(list(areas.items()), "location_slug string, areas array<string>"), POLISH)
    assert {r.query_id: r.area for r in got.collect()} == {i: first(t, p) for i, t, p in texts}


def test_synonyms_of_a_query_of_very_many_words(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    queries = spark.createDataFrame([(1, text), (2, "a b"), (3, "")], "query_id long, normalized string")
    synonyms = spark.createDataFrame([("w7", "seven"), ("w29999", "w7"), ("a b", "pair"), ("w1 w2", "three")], "alias string, canonical string")
    got = {r.query_id: r.tokens for r in candidates.expand_synonyms(queries, synonyms).collect()}
    assert got[1][30_000:] == ["seven", "three"] and got[2] == ["a", "b", "pair"] and got[3] == []


def loader(spark, source, clock):
    places = lambda: spark.createDataFrame([("lodz", f"lodz-{source()}", 1)], "name_n string, slug string, ordinal int")
    kinds = lambda: spark.createDataFrame([("yin", "yin", None, 1)], "name_n string, slug string, aliases_n string, ordinal int")
    return lookups.LookupsLoader(places, kinds, POLISH, seconds=10, clock=clock)


def test_callers_at_the_same_time_share_one_load(spark):
    calls, now, gate = [], [0.0], threading.Barrier(4)
    held = loader(spark, lambda: calls.append(1) or len(calls), lambda: now[0])
    out = []

    def call():
        gate.wait()
        out.append(held.load())

    threads = [threading.Thread(target=call) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1 and all(x is out[0] for x in out)
    now[0] = 11
    again = held.load()
    assert len(calls) == 2 and again is not out[0] and again.locations.first().slug == "lodz-2"
    assert held.reload() is not again and len(calls) == 3
    held.invalidate()
    held.load()
    assert len(calls) == 4
    held.invalidate()


def test_a_load_that_fails_keeps_the_former_lookups(spark):
    broken = []
    held = loader(spark, lambda: 1 / 0 if broken else 1, lambda: 0.0)
    first = held.load()
    broken.append(True)
    with pytest.raises(ZeroDivisionError):
        held.reload()
    assert held.load() is first and first.locations.count() == 1
    held.invalidate()


def test_patterns_of_any_form_are_looked_for(spark):
    """Only patterns of plain letters are prefiltered by them."""
    locale = Locale("own", geo_patterns=(r"(?:close|next) to", r"clos?e", r"\d+ km"))
    rows = spark.createDataFrame([("next to me",), ("cloe",), ("5 km off",), ("far",), (None,)], "q string")
    got = [tuple(r) for r in rows.select(locale.has_geo_intent(F.col("q")), locale.strip_geo_intent(F.col("q"))).collect()]
    assert got == [(True, "me"), (True, ""), (True, "off"), (False, "far"), (False, "")]
    assert POLISH.strip_geo_intent(F.lit("x")) is not None and Locale().has_geo_intent(F.lit("x")) is not None


def test_the_prefilter_lets_all_keys_pass_and_few_others(spark):
    rows = spark.range(50_000).selectExpr("concat('w', id) as word", "id as n")
    held = spark.range(0, 50_000, 100).selectExpr("concat('w', id) as alias")
    passed = {r.word for r in may_be_among(rows, F.col("word"), held, F.col("alias")).collect()}
    assert {f"w{i}" for i in range(0, 50_000, 100)} <= passed and len(passed) < 700
    assert may_be_among(rows, F.col("word"), held.limit(0), F.col("alias")).count() == 0


def test_candidates_of_small_files_are_not_broadcast(spark, tmp_path):
    """Queries of few bytes on disk give many candidates: an estimate by the size of files must not send them through the driver."""
    spark.range(200).selectExpr("id AS query_id", "split(repeat('word kraków ', 300), ' ') AS tokens").write.parquet(f"{tmp_path}/queries")
    spark.sql("SELECT 'word' AS name, 'w' AS slug").write.parquet(f"{tmp_path}/lookup")
    found = resolver.match_tokens(spark.read.parquet(f"{tmp_path}/queries"), spark.read.parquet(f"{tmp_path}/lookup"), POLISH)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["matched"], r["slug"]) for r in found.collect()} == {("word", "w")} and found.count() == 200


def test_queries_with_enough_words_need_no_synonyms(spark):
    queries = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b"), (3, "- a - b c d e"), (4, "")], "query_id long, normalized string")
    synonyms = spark.createDataFrame([("a", f"s{i:03}") for i in range(200)] + [("a b", "-")], "alias string, canonical string")
    short, whole = (f(queries, synonyms).collect() for f in (candidates.expand_for_terms, candidates.expand_synonyms))
    sizes = {r.query_id: len(r.tokens) for r in short}
    assert sizes[1] == 7 and sizes[2] > 200 and len(short) == 4
    terms = lambda rows: {r.query_id: [t for t in (x.replace("-", "") for x in r.tokens) if t][:6] for r in rows}
    assert terms(short) == terms(whole)


def test_synonyms_travel_in_lists_of_their_alias(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LISTED_BITS", 3)
    named = {"a": [f"c{i:02}" for i in range(40)], "b": [f"c{i:02}" for i in range(0, 60, 3)], "b a": ["a", "zz", "c01"], "x": ["y"]}
    synonyms = spark.createDataFrame([(a, c) for a, cs in named.items() for c in cs + cs[:2]] + [("a", None)], "alias string, canonical string")
    queries = spark.createDataFrame([(1, "b a"), (2, "a b c05"), (3, "q"), (4, "")], "query_id long, normalized string")
    got = candidates.expand_synonyms(queries, synonyms)

    def model(text):
        words = text.split()
        aliases = words + [" ".join(p) for p in zip(words, words[1:])]
        return words + [c for c in dict.fromkeys(c for a in aliases for c in sorted(named.get(a, []))) if c not in words]

    assert {r.query_id: r.tokens for r in got.collect()} == {r.query_id: model(r.normalized) for r in queries.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[query_id#\d+L?, canonical", plan), "a row for each query and canonical isn't shuffled"


def expanded_by_model(text, named):
    if text is None:
        return None
    words = [w for w in text.split(" ") if w]
    aliases = words + [" ".join(p) for p in zip(words, words[1:])]
    return words + [c for c in dict.fromkeys(c for a in aliases for c in sorted(named.get(a, []))) if c not in words]


def test_expanded_queries_are_not_shuffled(spark, monkeypatch):
    """Queries meet copies of the synonyms, and nothing stands above that: what is found grows with queries x canonicals."""
    monkeypatch.setattr(candidates, "LISTED_BITS", 2)
    monkeypatch.setattr(candidates, "CHUNKS", 5)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    named = {a: rnd.sample([*words, "w1 w2", "ą", "x y"], rnd.randrange(1, 30)) for a in [*words[::2], "w1 w2", "w3 w3", "w1 w2 w3", ""]}
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(12))) for _ in range(300)] + ["", "  w3  w3 ", None, "none known", "w1 w2", "w1", "w2"]
    queries = spark.createDataFrame([(f"s{i % 7}", i, t) for i, t in enumerate(texts)], "query string, query_id long, normalized string")
    got = candidates.expand_synonyms(queries, spark.createDataFrame([(a, c) for a, cs in named.items() for c in [*cs, None]] + [(None, "n")], "alias string, canonical string"))
    assert [tuple(r) for r in got.orderBy("query_id").collect()] == [(f"s{i % 7}", i, t, expanded_by_model(t, named)) for i, t in enumerate(texts)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    none = candidates.expand_synonyms(queries, spark.createDataFrame([], "alias string, canonical string"))
    assert {r.query_id: r.tokens for r in none.collect()} == {i: expanded_by_model(t, {}) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("together", "tokens"), [(1, 1), (2, 7), (3, 1000)])
def test_expansion_in_small_batches(monkeypatch, together, tokens):
    monkeypatch.setattr(expansion, "TOGETHER", together)
    monkeypatch.setattr(expansion, "BATCH_TOKENS", tokens)
    named = {"a": ["b", "c", "z"], "b a": ["c", "d"], "b": ["a b", "y"]}
    lists = [{"alias": a, "list": k, "canonicals": cs[k : k + 1]} for a, cs in named.items() for k in range(len(cs))]
    texts = ["b a b", None, "", "a", "b", "a", "q", "b a"]
    schema = pa.schema([("chunk", pa.int64()), ("lists", pa.list_(pa.struct(list(expansion.LISTS)))), ("query", pa.struct([("query_id", pa.int64()), ("normalized", pa.string())]))])
    chunk = lambda n: {"chunk": n, "lists": lists[n::2], "query": None}
    rows = [chunk(0), chunk(0), chunk(1), *({"chunk": None, "lists": None, "query": {"query_id": i, "normalized": t}} for i, t in enumerate(texts))]
    batches = [pa.RecordBatch.from_pylist(rows[:2], schema), pa.RecordBatch.from_pylist(rows[2:6], schema), pa.RecordBatch.from_pylist(rows[6:], schema)]
    got = [r for batch in expansion.expanded(iter(batches)) for r in batch.to_pylist()]
    assert got == [{"query_id": i, "normalized": t, "tokens": expanded_by_model(t, named)} for i, t in enumerate(texts)]
    with pytest.raises(ValueError, match="after queries"):
        list(expansion.expanded(iter([batches[2], batches[0]])))


@pytest.mark.parametrize(("first", "few"), [(0, 100), (2, 100), (64, 3)])
def test_first_areas_settle_queries_in_their_rows(spark, monkeypatch, first, few):
    """Only texts that hold none of the first areas are taken apart; too many areas for every task are met by joins alone."""
    monkeypatch.setattr(resolver, "FIRST_AREAS", first)
    monkeypatch.setattr(resolver, "FEW_AREAS", few)
    tried = []
    write = resolver.materialize
    monkeypatch.setattr(resolver, "materialize", lambda df, label: (out := write(df, label), tried.append(out) if label == "areas-tried" else None)[0])
    areas = {"p": ["a", "b c", "a", None, "c d", "d", ""], "r": [None, None, None, "late"], "s": []}
    texts = [(1, "b c a", "p"), (2, "x b c d", "p"), (3, "c d", "p"), (4, "", "p"), (5, "late", "r"), (6, "a", "s"), (7, "a", None), (8, "z", "p"), (9, "d c", "p"), (10, None, "r")]
    got = resolver.match_area(spark.createDataFrame(texts, "query_id long, query string, location_slug string"), spark.createDataFrame(list(areas.items()), "location_slug string, areas array<string>"), POLISH)
    assert {r.query_id: r.area for r in got.collect()} == {1: "a", 2: "b c", 3: "c d", 4: "", 5: "late", 6: None, 7: None, 8: None, 9: "d", 10: None}
    open_ = [{r.query_id for r in t.where("q is not null").collect()} for t in tried]
    assert open_ == {0: [{1, 2, 3, 4, 5, 8, 9, 10}], 2: [{3, 4, 5, 8, 9, 10}], 64: []}[first]


def test_what_an_ask_carries_is_not_joined_again(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_BITS", 2)
    asks = spark.createDataFrame([("a", k, f"r{k}") for k in range(0, 40, 3)] + [("b", 5, None), ("none", 7, "x")], "name string, k long, root string")
    events = spark.createDataFrame([("a", 0), ("a", 17), ("a", 18), ("b", 5), ("b", 4)], "name string, k long")
    got = ordered.last_before(asks, events)
    assert {(r.name, r.k, r.root, r.before) for r in got.collect()} == {("a", k, f"r{k}", None if k == 0 else 0 if k <= 17 else 17 if k == 18 else 18) for k in range(0, 40, 3)} | {("b", 5, None, 4), ("none", 7, "x", None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
