"""Typed plans of mechanism functions, matrices, activations and converters, as JSON.

A plan holds what is drawn once for all datasets of a layout: kinds, depths, widths, numbers of
centres.  The values (weights, thresholds, centres) are drawn for each dataset when a plan is run, in kernels.py.
"""

from __future__ import annotations

import numpy as np

#: Names of the activations, of those with a parameter, and of the kinds of matrices and families.
FIXED = (
    "tanh", "leaky_relu", "elu", "identity", "silu", "swiglu", "relu", "relu_sq", "softplus", "sign", "gauss", "exp", "sin", "square", "abs", "softmax", "logsigmoid",
    "logabs", "sigmoid", "round", "mod1", "selu", "relu6", "hardtanh", "indicator_01", "onehot_argmax", "argsort", "rank",
)
PARAMETRIC = ("relu_pow", "signed_pow", "inv_pow", "gumbel_softmax", "poly")
MATRICES = ("gaussian", "weights", "singular_values", "kernel", "activation")
FAMILIES = ("nn", "tree", "discretization", "gp", "linear", "quadratic", "em", "product", "piecewise")
#: Families that product and piecewise are made of, the forms of gp, and the bases of a root.
INNER = ("tree", "discretization", "gp", "linear", "quadratic")
GP_BRANCHES = ("ha", "projected")
GP_VARIANTS = ("standard", "periodic", "multiscale")
ROOTS = ("normal", "uniform", "unit_ball", "normal_cov")
AGGREGATIONS = ("sum", "product", "max", "logsumexp")
#: How a categorical converter finds labels, and what becomes of its latent.
CONVERTERS = (("neighbor", "input"), ("neighbor", "index_repeat"), ("neighbor", "center"), ("neighbor", "center_random_fn"), ("softmax", "input"), ("softmax", "index_repeat"), ("softmax", "softmax_points"))


def log_u(rng: np.random.Generator, low: float, high: float) -> float:
    return float(np.exp(rng.uniform(np.log(low), np.log(high))))


def log_u_int(rng: np.random.Generator, low: int, high: int) -> int:
    return int(np.clip(int(log_u(rng, low, max(low, high))), low, max(low, high)))


def one_of(rng: np.random.Generator, names: tuple):
    return names[int(rng.integers(len(names)))]


def activation_plan(rng: np.random.Generator) -> dict:
    """One of the parametric activations with probability one third, else one of the fixed."""
    if rng.random() >= 1 / 3:
        return {"kind": one_of(rng, FIXED)}
    kind = one_of(rng, PARAMETRIC)
    more = {"poly": lambda: {"power": int(rng.integers(2, 6))}, "gumbel_softmax": lambda: {"temperature": log_u(rng, 0.25, 4.0)}}
    return {"kind": kind, **more.get(kind, dict)()}


def matrix_plan(rng: np.random.Generator) -> dict:
    kind = one_of(rng, MATRICES)
    return {"kind": kind} if kind != "activation" else {"kind": kind, "base": one_of(rng, MATRICES[:4]), "activation": activation_plan(rng)}


def function_plan(rng: np.random.Generator, family: str, out: int) -> dict:
    """The plan of one function of a family with ``out`` outputs."""
    plan: dict = {"family": family, "out": out}
    if family in ("linear", "quadratic"):
        plan["matrix"] = matrix_plan(rng)
    elif family == "nn":
        layers = int(rng.integers(1, 4))
        plan["widths"] = [*(log_u_int(rng, 1, 127) for _ in range(layers - 1)), out]
        plan["matrices"] = [matrix_plan(rng) for _ in range(layers)]
        plan["before"] = activation_plan(rng) if rng.random() < 0.5 else None
        plan["between"] = [activation_plan(rng) for _ in range(layers - 1)]
        plan["after"] = activation_plan(rng) if rng.random() < 0.5 else None
    elif family == "tree":
        plan["depths"] = [int(rng.integers(1, 8)) for _ in range(log_u_int(rng, 1, 32))]
    elif family == "discretization":
        plan |= {"centers": log_u_int(rng, 2, 128), "matrix": matrix_plan(rng)}
    elif family == "gp":
        plan |= {"branch": one_of(rng, GP_BRANCHES), "variant": one_of(rng, GP_VARIANTS)}
    elif family == "em":
        plan |= {"centers": log_u_int(rng, 2, max(16, 2 * out)), "matrix": matrix_plan(rng)}
    elif family in ("product", "piecewise"):
        plan["parts"] = [function_plan(rng, one_of(rng, INNER), out) for _ in range(2)]
        if family == "piecewise":
            plan["gate"] = matrix_plan(rng)
    else:
        raise ValueError(f"unknown family {family!r}")
    return plan


def draw_family(rng: np.random.Generator, odds: dict[str, float]) -> str:
    return list(odds)[int(rng.choice(len(odds), p=list(odds.values())))]


def converter_plan(rng: np.random.Generator, cardinality: int, width: int, odds: dict[str, float], method: str | None = None) -> dict:
    """Whether a number is warped, or how labels are found and what becomes of the latent; ``method`` overrides how they are found."""
    if not cardinality:
        return {"warp": bool(rng.random() >= 0.5)}
    found, variant = one_of(rng, CONVERTERS)
    if method is not None and method not in ("neighbor", "softmax"):
        raise ValueError(f"unknown method {method!r}")
    plan = {"method": method or found, "variant": variant}
    if variant == "center_random_fn":
        plan["function"] = function_plan(rng, draw_family(rng, odds), width)
    return plan


def functions_of(plan: dict):
    """All function plans within a plan of nodes, nested ones too, each with its depth of nesting."""

    def walk(f: dict, depth: int):
        yield f, depth
        for part in f.get("parts", ()):
            yield from walk(part, depth + 1)

    for node in plan["nodes"]:
        for f in node["functions"]:
            yield from walk(f, 0)
        for c in node["converters"]:
            if "function" in c["plan"]:
                yield from walk(c["plan"]["function"], 1)
