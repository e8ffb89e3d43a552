"""Connected components of a link table, as iterated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id it reaches.

    Alternates two star steps until nothing changes: each id hands its larger
    neighbours to the smallest id it knows, then each id hands its smaller
    neighbours on likewise. The number of links never grows and depth at least
    halves, so rounds grow with the logarithm of the longest chain. Smallest
    neighbours come from aggregates that combine before the shuffle; the joins
    back keep one row per id on one side, so a hub is split by adaptive joins.
    Loops, repeated and null links are ignored; without links the result is empty.
    """
    edges = scratch.table(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("v", "p").cast("decimal(20,0)"))
        ).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("v").alias("id"), F.col("p").alias("component")).union(
                edges.select("p", "p").distinct()
            )
        seen = mark
        both = edges.union(edges.select("p", "v"))
        low = both.groupBy("v").agg(F.least(F.col("v"), F.min("p")).alias("low"))
        large = scratch.table(
            both.join(low, "v").where("p > v").select(F.col("p").alias("v"), F.col("low").alias("p")).distinct(), "large"
        )
        low = large.groupBy("v").agg(F.min("p").alias("low"))
        joined = large.join(low, "v").select("v", "p", "low")
        small = joined.select(F.explode(F.array(F.struct("v", F.col("low").alias("p")), F.struct(F.col("p").alias("v"), F.col("low").alias("p")))).alias("e"))
        nxt = scratch.table(small.select("e.v", "e.p").where("v <> p").distinct(), "edges")
        scratch.drop(edges, large)
        edges = nxt
