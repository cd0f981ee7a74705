"""Graphs as tables of edges (src < dst), and their packed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform


def bernoulli_edges(nodes: DataFrame, node: str, rate: float, seed: int) -> DataFrame:
    """(src, dst) for each two nodes src < dst, with probability rate; the nodes of one graph are few."""
    a, b = nodes.select(F.col(node).cast("int").alias("src")), nodes.select(F.col(node).cast("int").alias("dst"))
    return a.join(b, F.col("src") < F.col("dst")).where(uniform(seed, "edge", "src", "dst") < rate)


def cauchy_edges(nodes: DataFrame, node: str, group: list[str], bias: float, seed: int) -> DataFrame:
    """(group, src, dst): edges of one random graph for each group, each with probability sigmoid(A + B_src + C_dst + bias), A, B and C Cauchy.

    A is drawn for the graph, B and C for its nodes; the nodes of one graph are few, and graphs are spread.
    """
    cauchy = lambda path, *key: F.tan(F.lit(np.pi) * (uniform(seed, path, *key) - 0.5))
    a = nodes.select(*group, F.col(node).alias("src"))
    b = nodes.select(*[F.col(g).alias(f"g#{g}") for g in group], F.col(node).alias("dst"))
    pairs = a.join(b, [*[F.col(g).eqNullSafe(F.col(f"g#{g}")) for g in group], F.col("src") < F.col("dst")])
    z = cauchy("graph", *group) + cauchy("from", *group, "src") + cauchy("to", *group, "dst") + F.lit(float(bias))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
    return pairs.where(uniform(seed, "edge", *group, "src", "dst") < p).select(*group, "src", "dst")


def density(edges: DataFrame, n_nodes: int) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges")).withColumn("density", F.col("n_edges") / (n_nodes * (n_nodes - 1) / 2))


def depths(edges: DataFrame, nodes: DataFrame, node: str, group: list[str] | None = None) -> DataFrame:
    """(group, node, depth): nodes on the longest path that ends at each node, of one graph or of one for each group.

    A graph's edges go upwards, so one fold over them in order sees a node's depth settled before
    its edges go on; a graph is one row, its nodes being few by contract, and graphs are spread.
    """
    group = group or []
    held = nodes.groupBy(*group).agg(F.array_sort(F.collect_set(F.col(node).cast("int"))).alias("ns"))
    joined = edges.groupBy(*group).agg(F.array_sort(F.collect_set(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")))).alias("es"))
    both = held.join(joined, group, "left") if group else held.crossJoin(F.broadcast(joined))  # one row
    place = lambda n: F.array_position("ns", n).cast("int")
    step = lambda deep, e: F.transform(deep, lambda d, i: F.when(i + 1 == place(e["dst"]), F.greatest(d, F.element_at(deep, place(e["src"])) + 1)).otherwise(d))
    deep = F.aggregate(F.coalesce("es", F.array().cast("array<struct<src:int,dst:int>>")), F.transform("ns", lambda _: F.lit(1)), step)
    return both.select(*group, F.explode(F.arrays_zip(F.col("ns").alias("node"), deep.alias("depth"))).alias("e")).select(*group, "e.node", "e.depth")


def pack_upper(adjacency: np.ndarray) -> bytes:
    """The strict upper triangle, row by row, as little-endian bits."""
    return np.packbits(adjacency[np.triu_indices(len(adjacency), 1)].astype(bool), bitorder="little").tobytes()


def unpack_upper(payload: bytes, n: int) -> np.ndarray:
    bits = n * (n - 1) // 2
    if len(payload) != -(-bits // 8):
        raise ValueError("payload has the wrong length")
    out = np.zeros((n, n), dtype=bool)
    out[np.triu_indices(n, 1)] = np.unpackbits(np.frombuffer(payload, dtype=np.uint8), bitorder="little")[:bits].astype(bool)
    return out
