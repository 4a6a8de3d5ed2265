"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _by_node(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join on u, by a key that ``low`` is not grouped by: both sides are dealt anew, so that Spark may split a hub."""
    key = F.bitwise_not("u")
    return edges.withColumn("key", key).join(low.select(key.alias("key"), "m"), "key").drop("key")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns): the smallest node that is reachable.

    Loops and repeated edges are allowed. Each round is written to the shared folder, so nothing gathers on the
    driver but a count and a checksum; a hub's rows meet in joins that adaptive execution may split. Fails where
    ``max_rounds`` rounds don't settle the labels.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(pairs, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _by_node(both, low).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _by_node(large, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
