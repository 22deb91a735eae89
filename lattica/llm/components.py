"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize


def _figure(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def rekeyed(name: str):
    """A key equal where ``name`` is equal, by which an aggregate by ``name`` is not yet partitioned.

    A join on it exchanges both sides, which is what adaptive execution needs to split a hot key.
    """
    return F.col(name).bitwiseXOR(F.lit(1).cast("long")).alias("key")


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node reachable, of every node of an edge.

    Each round links all larger neighbours of a node to its least one, then all smaller
    ones; a fixed point is a forest of stars.  Minima are pre-aggregated, so a node with
    very many neighbours makes no large group; the join with them has one row a key on one
    side, and an exchange of its own on either, so that adaptive execution can split the
    other side of a hot key.  Rounds grow as the square of the logarithm of the nodes at
    most.  Loops and nulls are ignored; edges may repeat.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    start = edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    stars = materialize(start, "stars")
    before = _figure(stars)
    while before[0]:
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(rekeyed("x"), F.least("m", "x").alias("m"))
        large = both.where("y > x").select(rekeyed("x"), "y").join(least, "key").select(F.col("y").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select(rekeyed("u"), "v").join(lowest.select(rekeyed("u"), "m"), "key").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        figure = _figure(after)
        drop_tables(stars.sparkSession, stars)
        stars = after
        if figure == before:
            break
        before = figure
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
