"""Running totals and ranks over groups of any size.

A window over one group puts it into one task. Here rows are dealt by ranges of their order, each range adds up its own
rows, and what came before a range is looked up: no task holds more than one range of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.shared import settle


def running_total(rows: DataFrame, by: str, order: list[str], value: Column, name: str, total: str | None = None) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` over the rows of their group that come before them; and with ``total``, if
    it is given: the sum over all rows of their group."""
    dealt = settle(rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    before = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    whole = [F.sum("_sum").over(Window.partitionBy(by)).cast("bigint").alias(total)] if total else []
    ahead = sums.select(by, "_range", F.sum("_sum").over(Window.partitionBy(by).orderBy("_range").rowsBetween(*before)).alias("_ahead"), *whole)
    inside = F.sum(value).over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(*before))
    zero = F.lit(0).cast("bigint")
    # one row for each range of each group, whatever the number of rows
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(ahead), [by, "_range"])
    return placed.withColumn(name, (F.coalesce("_ahead", zero) + F.coalesce("_inside", zero)).cast("bigint")).drop("_range", "_ahead", "_inside")


def numbered(rows: DataFrame, by: str, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Rows with ``name``: 0, 1, 2 .. in order within their group; and with ``total``, if it is given: the group's rows."""
    return running_total(rows, by, order, F.lit(1), name, total)
