"""Row-batch functions of vectors as Column expressions: products, distances, trees, warps, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(v: Column, weights: list[float]) -> Column:
    """v times a weight vector."""
    return dot(v, F.array(*(F.lit(float(w)) for w in weights)))


def quadratic(v: Column, matrix: list[list[float]]) -> Column:
    """v' Q v."""
    rows = [linear(v, row) for row in matrix]
    return reduce(lambda a, b: a + b, (F.element_at(v, i + 1) * r for i, r in enumerate(rows)))


def lp_power(a: Column, b: Column, p: float) -> Column:
    """The p-th power of the L_p distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x)


def nearest(v: Column, centers: list[list[float]], p: float = 2.0) -> Column:
    """The number of the nearest centre by L_p distance, the lowest on a tie.

    Centres are a bounded list of literals, so rows are neither joined nor moved.
    """
    ranked = [F.struct(lp_power(v, F.array(*(F.lit(float(x)) for x in c)), p).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]
    return F.array_min(F.array(*ranked))["i"]


def soft_assignment(v: Column, centers: list[list[float]], sigma: list[float], p: float, q: float) -> Column:
    """Shares of the centres: softmax of -log(2 pi s^2)/2 - (d_p / s)^q."""
    from math import log, pi

    from .activations import softmax

    scores = []
    for c, s in zip(centers, sigma, strict=True):
        d = F.pow(lp_power(v, F.array(*(F.lit(float(x)) for x in c)), p), F.lit(1.0 / p))
        scores.append(F.lit(-0.5 * log(2 * pi * s * s)) - F.pow(d / F.lit(float(s)), F.lit(float(q))))
    return softmax(F.array(*scores))


def leaf_index(features: list[Column], thresholds: list[float]) -> Column:
    """Leaf of an oblivious tree: bit k is set where feature k exceeds threshold k."""
    return reduce(lambda a, b: a + b, (F.when(f > F.lit(float(t)), 2**k).otherwise(0) for k, (f, t) in enumerate(zip(features, thresholds, strict=True))))


def kumaraswamy(u: Column, a: float, b: float) -> Column:
    """The warp 1 - (1 - u^a)^b of a value in [0, 1]."""
    return 1 - F.pow(1 - F.pow(u, F.lit(float(a))), F.lit(float(b)))


def gate(x: Column, first: Column, second: Column, temperature: float, bias: float) -> Column:
    """A blend of two functions, by a logistic gate of x."""
    g = 1 / (1 + F.exp(-(x + F.lit(float(bias))) * F.lit(float(temperature))))
    return g * first + (1 - g) * second


def sampled_label(x: Column, u: Column) -> Column:
    """A place in x drawn from its softmax by one uniform: the first whose cumulated share exceeds u."""
    top = F.array_max(x)
    w = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    # The cumulated shares do not fall, so those up to u are counted.
    passed = F.aggregate(w, start, lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when((a["sum"] + v) / total <= u, 1).otherwise(0)).alias("n")))
    return F.least(passed["n"], F.size(x) - 1)
