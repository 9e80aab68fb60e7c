"""The registered queries against DuckDB on the smallest tables, sources, sinks and streams."""

import os

import duckdb
import pytest

from lodeseek.plans import registry
from lodeseek.sources import tables
from lodeseek.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    listed = ",".join(f'"{c}"' for c in columns)
    assert mine == sorted(tuple(map(plain, r)) for r in duck.execute(f"SELECT {listed} FROM ({registry.ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", ["stored_postings_changed", "stored_trigrams_changed"])
def test_a_new_part_with_the_number_of_another_one(spark, tmp_path, name):
    """Beyond a million parts the numbers of new parts are taken already."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * REPLACE (CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 999999 END AS p_partkey) FROM '{SF}/part.parquet' WHERE p_partkey <= 60")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {','.join(df.columns)} FROM ({registry.ORACLE[name]})").fetchall())
    registry.forget()


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE) and registry.FLAGSHIP in registry.QUERIES


def test_sinks_and_streams(spark, tmp_path):
    row = ("q", "q", "home", None, "search", None, 3, None, None, "s")
    df = spark.createDataFrame([row], tables.EVENT_SCHEMA)
    for _ in range(2):
        tables.append_events(df, str(tmp_path / "events"))
    assert tables.read(spark, str(tmp_path / "events")).count() == 2
    tables.write_index(spark.createDataFrame([("b", 1), ("a", 2)], "token string, id long"), str(tmp_path / "index"), "token")
    assert tables.read(spark, str(tmp_path / "index")).count() == 2
    source = spark.read.parquet(f"{SF}/events.parquet")
    os.makedirs(tmp_path / "in")
    source.write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in/a"))
    query = events.streaming_rollup(stream).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    closed = {(r.window_start, r.event_type): (r.n, round(r.total, 4)) for r in spark.table("rolled").collect()}
    batch = {(r.window_start, r.event_type): (r.n, r.total) for r in events.rollup(source).collect()}
    assert closed and all(batch[k] == pytest.approx(v) for k, v in closed.items())
    assert events.sessions(source).selectExpr("sum(n)").first()[0] == source.count()
