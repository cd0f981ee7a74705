"""The activation catalogue as Column expressions: scalars take a double, the array ones an array of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the self-normalising unit.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772


def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


SCALAR: dict[str, Callable[[Column], Column]] = {
    "tanh": F.tanh,
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "identity": lambda x: x,
    "silu": lambda x: x * _sigmoid(x),
    "swiglu": lambda x: x * x * _sigmoid(x),
    "relu": _relu,
    "relu_sq": lambda x: _relu(x) * _relu(x),
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(20.0))))),
    "sign": F.signum,
    "gauss": lambda x: F.exp(-x * x),
    "exp": lambda x: F.exp(F.least(x, F.lit(20.0))),
    "sin": F.sin,
    "square": lambda x: x * x,
    "abs": F.abs,
    "logsigmoid": lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x))),
    "logabs": lambda x: F.ln(F.greatest(F.abs(x), F.lit(1e-6))),
    "sigmoid": _sigmoid,
    "round": F.rint,
    "mod1": lambda x: x - F.floor(x),
    "selu": lambda x: SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * F.expm1(x)),
    "relu6": lambda x: F.least(_relu(x), F.lit(6.0)),
    "hardtanh": lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)),
    "indicator_01": lambda x: F.when((x >= 0) & (x <= 1), 1.0).otherwise(0.0),
}

PARAMETRIC: dict[str, Callable[[Column, float], Column]] = {
    "relu_pow": lambda x, q: F.pow(_relu(x), F.lit(q)),
    "signed_pow": lambda x, q: F.signum(x) * F.pow(F.abs(x), F.lit(q)),
    "inv_pow": lambda x, q: F.pow(F.abs(x) + 0.001, F.lit(-q)),
    "poly": lambda x, m: F.pow(x, F.lit(m)),
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(v: Column) -> Column:
    """Softmax over an array."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    shifted = lambda x: once(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top)))
    return once(v, lambda x: once(shifted(x), lambda e: once(add(e), lambda total: F.transform(e, lambda y: y / total))))


def onehot_argmax(v: Column) -> Column:
    """1 at the first greatest entry, 0 elsewhere."""
    place = lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1
    return once(v, lambda x: once(place(x), lambda at: F.transform(x, lambda _, i: (i == at).cast("double"))))


def argsort(v: Column) -> Column:
    """Positions from 0 in ascending order of value, ties by position."""
    return F.transform(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def rank(v: Column) -> Column:
    """Rank from 1 of each entry, ties by position."""
    return F.transform(argsort(argsort(v).cast("array<double>")), lambda i: i + 1)


def gumbel_softmax(v: Column, u: Column, temperature: float) -> Column:
    """Softmax of v with Gumbel noise from the uniforms u, at a temperature of 0.001 or more."""
    t = max(temperature, 1e-3)
    noisy = F.zip_with(v, u, lambda x, w: (x - F.ln(-F.ln(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), w))))) / t)
    return softmax(noisy)


ARRAY = {"softmax": softmax, "onehot_argmax": onehot_argmax, "argsort": argsort, "rank": rank}


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sanitize(x: Column, limit: float = 1e6) -> Column:
    """NaN and null to 0, the rest clamped to +-limit."""
    clean = F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), clean))
