"""The stored index: changes against an index built anew, files that stay, blocks that are skipped, joins without an exchange of the index."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import candidates
from lodeseek.operators.blockmax import tokens_of_prefixes
from lodeseek.operators.index import text_index, trigram_index
from lodeseek.operators.mapping import EntityMapping, map_entities
from lodeseek.operators.segments import StoredIndex
from lodeseek.plans.engine import QUERY_SCHEMA, SYNONYM_SCHEMA, Search
from lodeseek.sources.shared import Folder

MAPPING = EntityMapping("id", "name", categories="kind", location="city")
WORDS = ["red", "reed", "ring", "rings", "bolt", "blue", "old", "hot", "yoga", "yodel", "x", "averyveryverylongwordindeed", "averyveryverylongwordindeeds", "small-gear"]


def entities(spark, rows):
    return map_entities(spark.createDataFrame(rows, "id long, name string, kind string, city string"), MAPPING)


def made(seed, ids):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 5))) or None, rnd.choice(["tool", "toy", None]), rnd.choice(["lodz", "nowa sol"])) for i in ids]


def queries(spark, *texts, limit=2, city=None):
    return spark.createDataFrame([(i, t, city, None, None, None, limit, 0) for i, t in enumerate(texts, 1)], QUERY_SCHEMA)


TEXTS = ("red ring", "r", "yo", "hot yoga", "x bolt", "averyveryverylongwordindeed", "small", "gear blue", "nothing", "t")
SYNONYMS = [("gear", "hot yo", "s", 1), ("bolt", "old averyveryverylongword", "s", 2)]


def ranks(df):
    return sorted((r.query_id, r.id, round(r.fts_rank, 9), r.pos) for r in df.collect())


def both_ways(spark, index, rows, asked):
    """The stored index's full-text rows, and those of an index built anew of the rows."""
    synonyms = spark.createDataFrame(SYNONYMS, SYNONYM_SCHEMA)
    stored, anew = Search.stored(index, asked, synonyms), Search(entities(spark, rows), asked, synonyms)
    out = ranks(stored.fts), ranks(anew.fts)
    stored.close()
    anew.close()
    return out


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_changes_equal_an_index_built_anew(spark, tmp_path):
    rows = dict((r[0], r) for r in made(1, range(60)))
    index = StoredIndex.create(entities(spark, [*rows.values(), (None, "red", None, None)]), f"file://{tmp_path}/ix", buckets=3, block_bits=3)
    first = files(tmp_path / "ix")
    changes = made(2, [3, 9, 100, 101]), [5, 6, 7, 999]
    rows |= {r[0]: r for r in changes[0]}
    rows = {k: v for k, v in rows.items() if k not in changes[1]}
    later = index.apply(entities(spark, changes[0]), spark.createDataFrame([(i,) for i in changes[1]], "id long"))
    assert first.items() <= files(tmp_path / "ix").items() and later.manifest.segments == [1, 2]
    back = made(3, [5, 100])
    rows |= {r[0]: r for r in back}
    later = later.apply(entities(spark, back))
    for at in (later, StoredIndex.open(spark, f"file://{tmp_path}/ix")):
        want = entities(spark, list(rows.values()))
        assert sorted(map(tuple, at.entities().collect())) == sorted(map(tuple, want.collect()))
        assert sorted(at.postings().collect()) == sorted(text_index(want).postings.select("token", "id", "field", "tf", "positions").collect())
        assert sorted(at.trigrams().collect()) == sorted(trigram_index(want).select("trigram", "id", "field").collect())
        assert at.manifest.docs == len(rows) and at.manifest.length == text_index(want).docs.agg(F.sum("doc_len")).first()[0]
    got, want = both_ways(spark, later, list(rows.values()), queries(spark, *TEXTS))
    assert got == want and len(got) > 20
    got, want = both_ways(spark, later, list(rows.values()), queries(spark, *TEXTS, limit=1, city="lodz"))
    assert got == want
    assert sorted(r.id for r in index.entities().collect()) == list(range(60)), "a reader of an older version sees it whole"
    whole = later.compact()
    assert whole.manifest.segments == [whole.manifest.version] and not whole.manifest.dirty
    assert sorted(map(tuple, whole.entities().collect())) == sorted(map(tuple, later.entities().collect()))
    got, want = both_ways(spark, whole, list(rows.values()), queries(spark, *TEXTS))
    assert got == want
    assert set(whole.vacuum()) == {1, 2, 3} | {s for s in later.manifest.segments if s not in whole.manifest.segments}
    assert StoredIndex.open(spark, f"file://{tmp_path}/ix").entities().count() == len(rows)


def test_small_segments_are_compacted_and_large_ones_stay(spark, tmp_path):
    index = StoredIndex.create(entities(spark, made(4, range(40))), f"file://{tmp_path}/ix", buckets=2, block_bits=3)
    kept = {k: v for k, v in files(tmp_path / "ix").items() if "segment=1" in k}
    for i in range(3):
        index = index.apply(entities(spark, made(5 + i, [100 + i, i])))
    assert index.manifest.segments[0] == 1 and len(index.manifest.segments) == 2, "the changes are one segment, the large one stays"
    assert kept.items() <= files(tmp_path / "ix").items()
    index = index.apply(deletes=spark.createDataFrame([(i,) for i in (0, 1, 102, 5)], "id long"))
    assert sorted(r.id for r in index.entities().collect()) == [i for i in range(40) if i not in (0, 1, 5)] + [100, 101]
    index = index.apply(entities(spark, made(9, range(200, 215))))
    assert len(index.manifest.segments) == 1


def test_of_a_change_rows_that_share_an_id_the_least_counts(spark, tmp_path):
    rows = [(1, "b", None, None), (1, "a", None, None), (2, None, None, None)]
    index = StoredIndex.create(entities(spark, rows), f"file://{tmp_path}/ix", buckets=2)
    assert [(r.id, r.name) for r in index.entities().orderBy("id").collect()] == [(1, "a"), (2, None)]
    with pytest.raises(FileExistsError):
        StoredIndex.create(entities(spark, rows), f"file://{tmp_path}/ix")
    with pytest.raises(ValueError, match="has the columns"):
        index.apply(entities(spark, rows).drop("slug"))
    with pytest.raises(ValueError, match="columns of the index itself"):
        StoredIndex.create(entities(spark, rows).withColumn("block", F.lit(1)), f"file://{tmp_path}/other")
    Folder(spark, f"file://{tmp_path}/ix").claim("claim-2")
    with pytest.raises(RuntimeError, match="another writer"):
        index.apply(entities(spark, rows))


def test_an_empty_index(spark, tmp_path):
    index = StoredIndex.create(entities(spark, []), f"file://{tmp_path}/ix", buckets=2)
    assert both_ways(spark, index, [], queries(spark, "red", "")) == ([], [])
    with pytest.raises(FileNotFoundError):
        StoredIndex.open(spark, f"file://{tmp_path}/none")


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """600 entities that all have the word `all`, some of them `rare`, in blocks of 8; few have names so short that they rank best."""
    rows = [(i, "all" if i in (77, 300, 301) else "all " + " ".join(["filler"] * (2 + i % 3)) + (" rare" if i % 150 == 4 else ""), None, None) for i in range(600)]
    path = tmp_path_factory.mktemp("stored")
    return rows, StoredIndex.create(entities(spark, rows), f"file://{path}/ix", buckets=4, block_bits=3)


def test_blocks_without_a_result_are_skipped(spark, common):
    rows, index = common
    asked = queries(spark, "all", "rare", "a", "all rare")
    search = Search.stored(index, asked, spark.createDataFrame([], SYNONYM_SCHEMA))
    anew = Search(entities(spark, rows), asked, spark.createDataFrame([], SYNONYM_SCHEMA))
    assert ranks(search.fts) == ranks(anew.fts)
    blocks = search.blocks
    for query in (1, 3):
        of = F.col("query_id") == query
        assert blocks.pairs.where(of).count() == 75, "the term stands in every block"
        assert blocks.needed.where(of).count() == 0, "none can be better than the k-th row of the first few"
    per_task = blocks.scored(blocks.pairs.select("query_id", "block")).groupBy("query_id", "block").count().agg(F.max("count")).first()[0]
    assert per_task <= 8, "rows of a query that meet are those of a block"
    search.close()
    anew.close()


def test_without_enough_rows_in_the_first_blocks_all_are_read(spark, common):
    rows, index = common
    asked = queries(spark, "all", limit=200)
    search = Search.stored(index, asked, spark.createDataFrame([], SYNONYM_SCHEMA))
    assert search.blocks.needed.count() == 71 and search.fts.count() == 600
    search.close()


def tree(plan):
    """(depth, text) of each node of a physical plan."""
    return [(len(m[1]), m[2]) for line in plan.splitlines() if (m := re.match(r"^([ :+\-]*)(.+)$", line))]


def exchanged_scans(df):
    """Scans of bucketed tables with an exchange between them and their nearest join or aggregate."""
    nodes, found, seen = tree(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]), [], 0
    for i, (depth, text) in enumerate(nodes):
        if "FileScan" not in text or "Bucketed: true" not in text:
            continue
        seen += 1
        for above, what in reversed(nodes[:i]):
            if above < depth:
                depth = above
                if "Exchange" in what:
                    found.append(text)
                if "Join" in what or "Exchange" in what:
                    break
    return seen, found


def test_the_index_side_of_joins_has_no_exchange(spark, common):
    _, index = common
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        search = Search.stored(index, queries(spark, "all", "filer", "rar"), spark.createDataFrame([], SYNONYM_SCHEMA))
        scored = search.blocks.scored(search.blocks.pairs.select("query_id", "block"))
        for df, least in ((scored, 2), (search._fuzzy(), 2)):
            seen, found = exchanged_scans(df)
            assert seen >= least and not found, found
        search.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prefixes_meet_the_dictionary_part_by_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodeseek.operators.segments.PART_BITS", 2)
    words = sorted({f"{a}{b}{c}" for a in "ab" for b in "xyz" for c in ("", "1", "12", "żółw")} | {"a", "b"})
    index = StoredIndex.create(entities(spark, [(i, w, None, None) for i, w in enumerate(words)]), f"file://{tmp_path}/ix", buckets=2)
    tokens = {r.token for r in index.table("dictionary").collect()}
    asked = ["a", "ax", "ax1", "b", "bz12", "c", "0", "by"]
    got = {(r.prefix, r.token) for r in tokens_of_prefixes(spark.createDataFrame([(p,) for p in asked], "prefix string"), index).collect()}
    assert got == {(p, t) for p in asked for t in tokens if t.startswith(p)}
    assert index.table("dictionary").groupBy("part").count().agg(F.max("count")).first()[0] <= 4


def test_a_greatest_limit_reaches_every_task(spark):
    rows = spark.range(1000).selectExpr("id % 2 as query_id", "3 as `limit`", "id", "double(id % 10) as fts_rank")
    top = candidates.first_rows(rows, [F.col("fts_rank"), F.col("id")], 2, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == 12 and candidates.first_rows(rows, [F.col("fts_rank"), F.col("id")], 2, None).count() == 12




def shuffled_records(spark):
    """Records that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_shuffles_what_it_writes_not_what_derives_from_each_row(spark, tmp_path):
    words = [f"{a}{b}" for a in ("wonder", "redund", "machin", "bright") for b in ("ful", "ant", "ery", "ness", "able")]
    n, rnd = 2000, random.Random(6)
    rows = [(i, " ".join(rnd.choices(words, k=4)), "tool", "lodz") for i in range(n)]
    before = shuffled_records(spark)
    index = StoredIndex.create(entities(spark, rows), f"file://{tmp_path}/ix", buckets=2)
    moved = shuffled_records(spark) - before
    written = index.table("postings").count() + index.table("trigrams").count()
    prefixes, tasks = index.table("prefixes").count(), 8
    assert moved <= written + 4 * n + tasks * (prefixes + len(words)), "each entity moves four times itself; prefixes and trigrams are counted where it lies"


@pytest.mark.parametrize("short", [0, 2, 64])
def test_short_and_long_entities_are_counted_alike(spark, tmp_path, monkeypatch, short):
    monkeypatch.setattr("lodeseek.operators.segments.SHORT", short)
    rows = [*made(11, range(20)), (20, "red red rings ring red", "red", "nowa sol"), (21, None, None, None), (22, "x " * 3, "xx", "lodz")]
    index = StoredIndex.create(entities(spark, rows), f"file://{tmp_path}/ix", buckets=2, block_bits=3)
    want = text_index(entities(spark, rows)).postings.select("token", "id", "field", "tf", "positions").collect()
    assert sorted(index.postings().collect()) == sorted(want)
    block = {r.id: r.block for r in index.table("entities").collect()}
    size, found = {}, {}
    for r in want:
        size[r.id] = size.get(r.id, 0) + r.tf
        for k in range(1, min(len(r.token), 24) + 1):
            per_id = found.setdefault((r.token[:k], block[r.id]), {})
            per_id[r.id] = per_id.get(r.id, 0) + r.tf
    got = {(r.prefix, r.block): (r.n, r.max_f, r.min_len) for r in index.table("prefixes").collect()}
    assert got == {k: (len(f), max(f.values()), min(size[i] for i in f)) for k, f in found.items()}
    assert all(sorted(r.held) == sorted({t.trigram for t in index.trigrams().where(F.col("id") == r.id).collect()}) for r in index.table("entities").where("id >= 19").collect())
