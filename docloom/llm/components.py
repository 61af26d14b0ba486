"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a grouped minimum and its return to the edges, both dealt by salt, so a hub
with very many edges is shared by many tasks.  The number of rounds grows with the
logarithm of the longest chain.  Each round is a written table, and the round before it is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .skew import with_totals


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_totals(both, "u", "v", m=("min", "v")).withColumn("m", F.least("u", "m"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = with_totals(edges, "u", "v", m=("min", "v"))
    moved = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is
    the smallest node reachable.

    Direction, repeats and self-loops don't matter; edges with a null end are ignored;
    no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.distinct(), "edges")
    state = _digest(now)
    while state[0]:
        before, now = now, stored(_small_star(_large_star(now)), "edges")
        discard(before)
        then, state = state, _digest(now)
        if then == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
