"""The similarity join against all pairs and the share of postings it reads; sessions of a stream against those of a batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import similarity
from lodeseek.operators.mapping import EntityMapping, map_entities
from lodeseek.streaming import events

SYLLABLES = ["ba", "ko", "ri", "stu", "me", "lan", "do", "vi", "tra", "ne"]


def padded(text):
    return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in text).split() for i in range(len(w) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def named(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices(SYLLABLES, k=rnd.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(1, 4))), rnd.choice([None, word()]), rnd.choice(["lodz", "nowa sol"])) for i in range(400)]
    rows += [(1000 + i, "bakori stumelan", None, "lodz") for i in range(30)]
    entities = map_entities(spark.createDataFrame(rows, "id long, name string, kind string, city string"), EntityMapping("id", "name", categories="kind", location="city"))
    return rows, entities, similarity.persisted(similarity.similarity_index(entities))


def test_the_similarity_join_equals_all_pairs(spark, named):
    rows, entities, index = named
    rnd = random.Random(5)
    asked = [(i, " ".join("".join(rnd.choices(SYLLABLES, k=2)) for _ in range(rnd.randrange(1, 3))), None, rnd.randrange(1, 8)) for i in range(25)]
    asked += [(100, "bakori stumelan", None, 5), (101, "bakori stumelan", "nowa-sol", 5), (102, "", None, 5), (103, "zzz", None, 5), (104, "bakori", "lodz", 40), (105, "ba", None, 3)]
    queries = spark.createDataFrame(asked, "query_id long, normalized string, location_slug string, `limit` int")
    want = {}
    for q, text, city, limit in asked:
        scored = []
        for i, *fields in rows:
            best = max(jaccard(padded(text), padded(f or "")) for f in fields)
            if best > 0.1 and city in (None, fields[2].replace(" ", "-")):
                scored.append((-round(best, 9), i))
        want[q] = [(i, -s, n) for n, (s, i) in enumerate(sorted(scored)[: 2 * limit], 1)]
    for most in (None, 40):
        got = {q: [] for q in want}
        for r in similarity.similarity_top(queries, index, entities, most=most).orderBy("query_id", "pos").collect():
            got[r.query_id].append((r.id, round(r.fuzzy_score, 9), r.pos))
        assert got == want


def test_few_postings_are_read_of_a_query_with_near_neighbours(spark, named):
    """Of the postings that the query's trigrams have (all would be read without bounds) a third at most is read."""
    _, _, index = named
    asked = spark.createDataFrame([(1, "bakori stumelan", sorted(padded("bakori stumelan")))], "query_id long, normalized string, grams array<string>")
    counts = {r.trigram: r.n for r in index.counts.collect()}
    ordered = sorted(asked.first().grams, key=lambda g: (counts.get(g, 0), g))
    asked = spark.createDataFrame([(1, ordered)], "query_id long, grams array<string>")
    everything = sum(counts.get(g, 0) for g in ordered)
    high, low = (similarity.met(asked, index, d).count() for d in (0.6, 0.1))
    assert 30 <= high < 0.35 * everything and high < 0.5 * low, (high, low, everything)


BEGIN = datetime(2024, 5, 1)
EVENTS = "event_id long, user_id long, ts timestamp"


def visits(seed, users=6, n=300):
    rnd = random.Random(seed)
    out, clock = [], 0.0
    for i in range(n):
        clock += rnd.expovariate(1 / 400)
        out.append((i, rnd.randrange(users), BEGIN + timedelta(seconds=round(clock))))
    return out


def test_sessions_of_a_batch_equal_a_loop(spark):
    rows = visits(1) + visits(1)[:50] + [(None, 1, BEGIN), (9000, None, BEGIN), (9001, 1, None)]
    got = sorted((r.user_id, r.session_start, r.session_end, r.n) for r in events.track(spark.createDataFrame(rows, EVENTS), 1800).collect())
    want = []
    for user in range(6):
        runs = []
        for t in sorted(t for i, u, t in visits(1) if u == user):
            if runs and t - runs[-1][-1] <= timedelta(seconds=1800):
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(user, r[0], r[-1], len(r)) for r in runs]
    assert got == sorted(want) and len({r.session_id for r in events.track(spark.createDataFrame(rows, EVENTS), 1800).collect()}) == len(want)


def test_a_stream_out_of_order_and_with_repeats_gives_the_sessions_of_the_batch(spark, tmp_path):
    """Events come up to 10 minutes late and some again; one far too late is left out; one of the next year closes all sessions."""
    rnd = random.Random(2)
    rows = visits(2)
    arrivals = sorted([(t + timedelta(seconds=rnd.uniform(0, 500)), (i, u, t)) for i, u, t in rows] + [(t + timedelta(seconds=rnd.uniform(0, 500)), (i, u, t)) for i, u, t in rnd.sample(rows, 80)])
    sent = [r for _, r in arrivals]
    sent.insert(len(sent) // 2, (7777, 0, BEGIN - timedelta(days=1)))
    parts = [sent[k : k + 40] for k in range(0, len(sent), 40)] + [[(8888, 99, BEGIN + timedelta(days=365))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = events.track_stream(source, 1800, "10 minutes").writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    closed = spark.table("tracked").where("user_id <> 99")
    want = events.track(spark.createDataFrame(rows, EVENTS), 1800)
    plain = lambda df: sorted((r.session_id, r.user_id, r.session_start, r.session_end, r.n) for r in df.collect())
    assert plain(closed) == plain(want) and closed.agg(F.sum("n")).first()[0] == len(rows)
