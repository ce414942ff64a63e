"""Connected components of a link table by alternating large and small stars.

Each round hangs every vertex's neighbours on the smallest vertex known near it; rounds grow with the logarithm of the
longest chain. All state is a table of links in the shared folder; groups are reduced to their minimum by aggregation and
never gathered, so a vertex with very many links is one row a task. Null ends and loops are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """``links`` hold u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): each vertex that has a link, with the smallest vertex it can reach."""
    scratch = Scratch(links.sparkSession, "components")
    now = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") > F.col("v")))
    now = scratch.table(now.distinct(), "0")
    before, i = None, 0
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    while True:
        if (after := state(now)) == before:
            break
        before, i = after, i + 1
        now = scratch.table(_small(_large(now)), str(i))
        scratch.drop(str(i - 1))
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
