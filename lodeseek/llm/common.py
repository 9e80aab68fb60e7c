"""Shared pieces of the corpus operators: tables in the shared folder, names, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space, and TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may name none: it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, and the size becomes known to the optimizer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    hadoop = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(hadoop).delete(folder, True)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(wanted: str, columns: list[str]) -> str:
    """A prefix with which no column begins, in whatever case: `wanted`, with further underscores before it while there is one."""
    while any(c.lower().startswith(wanted.lower()) for c in columns):
        wanted = "_" + wanted
    return wanted


def finite(x: Column) -> Column:
    """Is an array of doubles there, with no component null or non-finite? An empty one is."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def spaced(text: Column) -> Column:
    """text with a space for each character of white space; null is empty. Splitting at one fixed character needs no regular expression."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")


def words_of(text: Column) -> Column:
    """Runs of characters other than white space; null text has none."""
    return F.array_remove(F.split(spaced(text), " "), "")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node reachable.

    Only nodes with an edge to another node are returned; nulls and loops are ignored. Alternating large-star and small-star steps
    over the edge table, each written to the shared folder; the number of steps grows with the logarithm of
    the longest path. Minima are pre-aggregated, and the joins back onto the edges have an exchange on either side, so
    that adaptive execution splits the edges of a hub. Nothing is collected but counts.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("proper")).where("proper").select("u", "v")
    now = materialize(pairs.distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "edges")
        for old in (now, least, large, lower):
            discard(old)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.distinct()), "components")
    discard(now)
    return found


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
