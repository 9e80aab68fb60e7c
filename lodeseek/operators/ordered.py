"""Rows that apply in order, without a loop over rows: as-of edges to earlier rows, and pointers that jump along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Numbers of rows that share a window are alike but for so many low bits: a name that stands in very many rows is spread over windows.
WINDOW_BITS = 20


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `k`, unique numbers that grow in the order given; materialized, so that numbers stay."""
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("k", F.monotonically_increasing_id()), "numbered")


def last_before(asks: DataFrame, events: DataFrame) -> DataFrame:
    """asks (name, k, ...) with `before`, the greatest k of an event (name, k) of that name strictly less than the ask's; else null. ks of asks are unique.

    Within a run of numbers a window finds it; across runs each run's last event is carried on. So no task sorts all rows of a name. The asks' other columns
    travel with them and needn't be joined again.
    """
    extra = [c for c in asks.columns if c not in ("name", "k")]
    run = F.shiftright("k", WINDOW_BITS).alias("run")
    marks = events.select("name", "k", F.lit(1).alias("event")).unionByName(asks.select("*", F.lit(0).alias("event")), allowMissingColumns=True).select("*", run)
    inside = Window.partitionBy("name", "run").orderBy("k", "event")
    near = marks.withColumn("near", F.last(F.when(F.col("event") == 1, F.col("k")), ignorenulls=True).over(inside)).where("event = 0").select(*asks.columns, "run", "near")
    lasts = marks.groupBy("name", "run").agg(F.max(F.when(F.col("event") == 1, F.col("k"))).alias("last"))
    carried = lasts.withColumn("far", F.last("last", ignorenulls=True).over(Window.partitionBy("name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("far is not null").select("name", "run", "far")
    return near.join(carried, ["name", "run"], "left").select("name", "k", *extra, F.coalesce("near", "far").alias("before"))


def reaches(graph: DataFrame) -> DataFrame:
    """(k, yes) from (k, yes, to): does a node reach one that is true? yes is true or null; to is an array of at most two earlier nodes.

    In each round a node that sees a true one is true, pointers to false ones go, and a pointer to a node with only one pointer jumps to that one's aim:
    chains are halved in each round. Materialized.
    """
    state = F.when(F.col("yes"), True).when(F.size("to") == 0, False)
    now = materialize(graph.select("k", "to", state.alias("yes")), "graph")
    while not now.where("yes is null").isEmpty():
        each = now.where("yes is null").select("k", F.explode("to").alias("at"))
        aims = now.select(F.col("k").alias("at"), F.col("yes").alias("known"), F.col("to").alias("further"))
        on = F.when(F.col("known") == F.lit(False), F.array().cast("array<bigint>")).when(F.size("further") == 1, F.col("further")).otherwise(F.array("at"))
        told = each.join(aims, "at").groupBy("k").agg(F.coalesce(F.max("known"), F.lit(False)).alias("seen"), F.array_distinct(F.flatten(F.collect_list(on))).alias("to"))
        open_ = told.select("k", "to", F.when(F.col("seen"), True).when(F.size("to") == 0, False).alias("yes"))
        after = materialize(now.where("yes is not null").unionByName(open_), "graph")
        discard(now)
        now = after
    return now.select("k", "yes")


def handed_down(rows: DataFrame) -> DataFrame:
    """(k, value) from (k, value, up): a row's own value, else that of the row that `up` names, and so on. Pointers jump, so rounds grow with the logarithm
    of the longest chain. Materialized."""
    now = materialize(rows.select("k", "value", "up"), "handed")
    while not now.where("value is null and up is not null").isEmpty():
        above = now.select(F.col("k").alias("up"), F.col("value").alias("given"), F.col("up").alias("higher"))
        open_ = now.where("value is null and up is not null").drop("value").join(above, "up").select("k", F.col("given").alias("value"), F.col("higher").alias("up"))
        after = materialize(now.where("value is not null or up is null").unionByName(open_), "handed")
        discard(now)
        now = after
    return now.select("k", "value")
