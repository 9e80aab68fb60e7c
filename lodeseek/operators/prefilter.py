"""A filter of bounded size that lets pass what may be in a table, so that the rest needn't be shuffled to meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, as a power of two: 16,384 rows of 64 bits at most, whatever the table's size. A filter that is full lets everything pass.
BITS = 20


def may_be_among(rows: DataFrame, value: Column, held: DataFrame, key: Column) -> DataFrame:
    """rows whose value may be a key of `held`: none that is one goes, most others do while `held` has far fewer keys than bits.

    The filter's rows are broadcast: their number is bounded.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    marks = held.select(place(key).alias("p")).select(F.shiftright("p", 6).alias("filter_at"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    bits = marks.groupBy("filter_at").agg(F.bit_or("bit").alias("filter_bits"))
    marked = rows.withColumn("filter_place", place(value)).withColumn("filter_at", F.shiftright("filter_place", 6))
    met = marked.join(F.broadcast(bits), "filter_at").where(F.getbit("filter_bits", (F.col("filter_place") % 64).cast("int")) == 1)
    return met.select(*rows.columns)
