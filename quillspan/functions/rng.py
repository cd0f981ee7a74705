"""Seeds and draws that do not depend on how rows are partitioned.

Seeds are derived by hashing a path of names below a base seed; a draw for a row hashes the seed, a
path and the row's key, so equal keys draw equal values on any cluster.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_MODULUS = 2**32 - 1
#: What stands for a null part of a row's key.
NULL_KEY = "~null~"


def derive_seed(base: int, *path: object) -> int:
    """A 32-bit child seed of base for a path of names and numbers."""
    h = hashlib.blake2s(str(int(base)).encode(), digest_size=8)
    for part in path:
        h.update(b"|" + str(part).encode())
    return int.from_bytes(h.digest(), "little") % SEED_MODULUS


class SeedPath:
    """A namespace of seeds; siblings do not disturb each other."""

    def __init__(self, seed: int, *path: object):
        self.base, self.path = int(seed), tuple(path)

    def __truediv__(self, name: object) -> SeedPath:
        return SeedPath(self.base, *self.path, name)

    @property
    def seed(self) -> int:
        return derive_seed(self.base, *self.path)

    def generator(self) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=self.seed))


def uniform(seed: int | str, path: str, *key: str | Column) -> Column:
    """A uniform in [0, 1) of 32 bits for each row's key; integers and strings make keys that other engines repeat. A null is a key of its own."""
    parts = [F.lit(str(seed)), F.lit(path), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(NULL_KEY)) for k in key)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int | str, path: str, *key: str) -> str:
    """The same uniform in DuckDB's SQL."""
    parts = ", ".join([f"'{seed}'", f"'{path}'", *(f"coalesce(CAST({k} AS VARCHAR), '{NULL_KEY}')" for k in key)])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"


def bernoulli(rate: float | Column, seed: int | str, path: str, *key: str | Column) -> Column:
    return uniform(seed, path, *key) < rate


def log_uniform(u: Column, low: float, high: float) -> Column:
    return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))


def log_uniform_int(u: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(log_uniform(u, low, high)))).cast("int")


def normal(seed: int | str, path: str, *key: str | Column) -> Column:
    """A standard normal by Box and Muller's method."""
    u1 = F.greatest(uniform(seed, path + "/r", *key), F.lit(2.0**-33))
    u2 = uniform(seed, path + "/t", *key)
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def laplace(u: Column) -> Column:
    """The inverse distribution function of a standard Laplace variable."""
    v = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), u))
    return F.when(v < 0.5, F.ln(2 * v)).otherwise(-F.ln(2 * (1 - v)))


def student_t(seed: int | str, path: str, df: int, *key: str | Column) -> Column:
    """A Student t of a whole number of degrees of freedom over 2: a normal by the root of a mean of squared normals."""
    if df <= 2:
        raise ValueError("df must be over 2")
    squares = [F.pow(normal(seed, f"{path}/{i}", *key), F.lit(2.0)) for i in range(df)]
    return normal(seed, path, *key) / F.sqrt(sum(squares[1:], squares[0]) / df)


def mixture_noise(seed: int | str, path: str, weights: dict[str, float], df: int, *key: str | Column) -> Column:
    """Noise whose family each row draws by weight."""
    family = component(uniform(seed, path + "/family", *key), weights)
    other = F.when(family == "laplace", laplace(uniform(seed, path + "/laplace", *key))).when(family == "student_t", student_t(seed, path + "/student", df, *key))
    return other.otherwise(normal(seed, path + "/normal", *key))


def component(u: Column, weights: dict[str, float]) -> Column:
    """The name whose share of the cumulated positive weights holds u."""
    kept = {k: w for k, w in weights.items() if w > 0}
    total, upto, out, last = math.fsum(kept.values()), 0.0, None, list(kept)[-1]
    for name, w in list(kept.items())[:-1]:
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(last) if out is None else out.otherwise(F.lit(last))


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    """Positive weights scaled to sum to one; the others are dropped."""
    kept = {k: float(w) for k, w in weights.items() if w > 0 and math.isfinite(w)}
    if not kept:
        raise ValueError("no positive weight")
    top = max(kept.values())
    total = math.fsum(w / top for w in kept.values())
    return {k: w / top / total for k, w in kept.items()}


def sample_noise(rng: np.random.Generator, shape: tuple[int, ...], family: str = "gaussian", *, scale: float = 1.0, df: float = 5.0, weights: dict[str, float] | None = None) -> np.ndarray:
    """Noise of a family: gaussian, laplace, student_t (df over 2), or a mixture cell by cell."""
    if family == "gaussian":
        return scale * rng.standard_normal(shape)
    if family == "laplace":
        return scale * rng.laplace(size=shape)
    if family == "student_t":
        if df <= 2:
            raise ValueError("df must be over 2")
        return scale * rng.standard_t(df, size=shape)
    if family == "mixture":
        share = normalize_weights(weights or {"gaussian": 1, "laplace": 1, "student_t": 1})
        pick = rng.choice(len(share), size=shape, p=list(share.values()))
        parts = [sample_noise(rng, shape, f, df=df) for f in share]
        return scale * np.choose(pick, parts)
    raise ValueError(f"unknown noise family {family!r}")
