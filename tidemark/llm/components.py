"""Connected components of a link table by alternating large-star and small-star steps.

Every step sums per node first and joins the sums back, so that a node with very many links is never one task's group: the
sums are written to the shared folder first, which leaves plain exchanges that Spark can split. So are a round's links.
The driver sees whether stars are all that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(links: DataFrame) -> bool:
    """Whether every linked node has one smaller neighbour at most, and then no larger one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id that each linked node reaches, itself included; ids of nodes without links do
    not occur. Loops, repeated and reversed links are allowed; links with a null end are none; no links, no rows."""
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u != v").distinct()
        large = written(large, "links")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    rows = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.unionByName(rows.select(F.col("component").alias("node"), "component").distinct())
