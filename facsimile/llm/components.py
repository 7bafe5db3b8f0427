"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.sources.staging import stage


def _star(links: DataFrame) -> DataFrame:
    """Every neighbour pair (u, v), both ways, with the least id next to u or u itself."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): component is the least node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of its neighbourhood; the number of rounds grows with the
    logarithm of the longest path. The least of a neighbourhood is found with
    map-side aggregation and Spark splits hot join keys, so a node may have any
    number of links.
    """
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        large = _star(links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every link goes from a node to a smaller one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = stage(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
