"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns ``a`` and ``b``), root
    being the smallest node of its component.

    Large-star and small-star steps alternate until the links no longer change:
    each node sends its larger, then its smaller neighbours to the smallest node
    it knows.  A step is one partially aggregated minimum and one equi join, and
    its result is written before the next one.  The number of links never grows,
    and the number of rounds is logarithmic.
    """
    links = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = (large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        links = written(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
