"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of `links` (u long, v long): comp is the smallest node that can be reached.

    A large star ties all greater neighbours of a node to its smallest neighbour, a small star all smaller ones; both keep what
    is connected, and after a logarithmic number of rounds every node points to the smallest of its component. Each round is a
    minimum by node, summed up in tasks first, and a join; its result is written, so no round repeats the ones before.
    Loops and repeated links add nothing; no links give no rows.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = staged(small.where("u <> v").distinct())
