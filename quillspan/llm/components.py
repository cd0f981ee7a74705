"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import forget, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
    return row["n"], row["x"]


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(m, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every id in a link; component is the least id reachable.

    Links with a null end, or from an id to itself, say nothing and are left out; repeated links count
    once.  No links give an empty table.  Each round is written to the shared folder; rounds grow
    with the logarithm of the number of ids, and no round holds a group of links in one place:
    minima are pre-aggregated and joined back, where Spark can split a hot id.
    """
    pair = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = materialize(pair.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u")).distinct()
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = materialize(new.where(F.col("u") != F.col("v")).distinct())
        now = _digest(new)
        forget(edges)
        edges = new
        if now == state:
            break
        state = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
