"""Connected components of a table of links, by alternating large and small stars.

Large star: every node sends its larger neighbours to the least node it knows. Small star: every node sends itself and
its smaller neighbours to the least of them. Links only ever move to smaller ends, and when nothing changes each
component is a star on its least node; that takes a few rounds even for long chains. A round is two aggregations and
two joins, written to the shared folder, so nothing is gathered anywhere and a lost executor costs one round's part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, settle


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any order, repeats and loops allowed) -> node, root (the least node of its component), for linked nodes.

    The result is a settled table.
    """
    now = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = settle(now, "links"), None
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == mark or not total[0]:
            ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            stars = settle(ends.unionByName(tops), "stars")
            free(now)
            return stars
        mark = total
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        free(now)
        now = then
