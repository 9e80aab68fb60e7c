"""Sources and sinks: tables in any format or database that Spark reads, and the sink of search events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = "query string, query_normalized string, page string, location_context string, action string, layer string, result_count int, clicked_type string, clicked_id string, session_id string"


def read(spark: SparkSession, path: str | None, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_sf(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a database query; give partitionColumn, bounds and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Rows of a query with named parameters (:name), which are values and never become SQL."""
    return spark.sql(sql, args=args)


def session_id(spark: SparkSession, key: str = "lodeseek.session.id") -> str:
    """The id that the session's events carry: made at first use, the same ever after."""
    if not (known := spark.conf.get(key, None)):
        spark.conf.set(key, known := str(uuid.uuid4()))
    return known


def stream_events(events: DataFrame, path: str, checkpoint: str):
    """A stream of search events to the same table, each once; returns the query."""
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return events.select(*columns).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def append_events(events: DataFrame, path: str) -> None:
    """Search events to a table of Parquet files, by session of the event stream's schema."""
    events.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def write_index(df: DataFrame, path: str, key: str) -> None:
    """An index sorted by its key within range partitions, so that scans for a few keys skip files and row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
