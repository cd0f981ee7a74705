"""Numeric kernels of the generator: random weights, matrices, mechanism functions and converters on row batches."""

from __future__ import annotations

import numpy as np

from .draws import FAMILIES, INNER, MATRICES, ROOTS, activation_plan, function_plan, log_u, log_u_int, matrix_plan, one_of  # noqa: F401
from .rng import sample_noise

EPS = 1e-6


def standardize(x: np.ndarray) -> np.ndarray:
    x = np.clip(np.nan_to_num(x, nan=0.0, posinf=1e6, neginf=-1e6), -1e6, 1e6)
    if len(x) < 2:
        return x - x.mean(axis=0, keepdims=True)
    return (x - x.mean(axis=0)) / np.maximum(x.std(axis=0, ddof=1), EPS)


def random_weights(rng: np.random.Generator, n: int, sigma_scale: float = 1.0) -> np.ndarray:
    """Positive weights summing to one: a noisy power law of the rank, in random order."""
    q = log_u(rng, 0.1 / np.log(n + 1), 6.0)
    sigma = log_u(rng, 1e-4, 10.0) * sigma_scale
    z = np.clip(-q * np.log(np.arange(1, n + 1)) + sigma * rng.standard_normal(n), -60, 60)
    w = np.maximum(np.exp(z - z.max()), 1e-12)
    return rng.permutation(w / w.sum())


def random_matrix(rng: np.random.Generator, rows: int, cols: int, plan: str | dict | None = None) -> np.ndarray:
    """A matrix of one of the five kinds, by name, by plan, or drawn, with unit rows."""
    plan = matrix_plan(rng) if plan is None else {"kind": plan} if isinstance(plan, str) else plan
    kind = plan["kind"]
    if kind == "gaussian":
        m = rng.standard_normal((rows, cols))
    elif kind == "weights":
        m = rng.standard_normal((rows, cols)) * np.stack([random_weights(rng, cols) for _ in range(rows)])
    elif kind == "singular_values":
        k = min(rows, cols)
        u, _ = np.linalg.qr(rng.standard_normal((rows, k)))
        v, _ = np.linalg.qr(rng.standard_normal((cols, k)))
        m = (u * random_weights(rng, k)) @ v.T
    elif kind == "kernel":
        a, b = rng.standard_normal((rows, 3)), rng.standard_normal((cols, 3))
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        m = np.exp(-log_u(rng, 0.1, 10.0) * d) * rng.choice([-1.0, 1.0], size=(rows, cols))
    elif kind == "activation":
        base = random_matrix(rng, rows, cols, plan.get("base") or one_of(rng, MATRICES[:4]))
        m = activate(rng, base, plan=plan.get("activation")) + 1e-3 * rng.standard_normal((rows, cols))
    else:
        raise ValueError(f"unknown matrix {kind!r}")
    m = m + EPS * rng.standard_normal((rows, cols))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


_FIXED = {
    "tanh": np.tanh, "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x), "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "identity": lambda x: x, "silu": lambda x: x * _sigmoid(x), "swiglu": lambda x: x * x * _sigmoid(x), "relu": lambda x: np.maximum(x, 0), "relu_sq": lambda x: np.maximum(x, 0) ** 2,
    "softplus": lambda x: np.logaddexp(0, x), "sign": np.sign, "gauss": lambda x: np.exp(-x * x), "exp": lambda x: np.exp(np.minimum(x, 20)),
    "sin": np.sin, "square": lambda x: x * x, "abs": np.abs, "softmax": _softmax, "logsigmoid": lambda x: -np.logaddexp(0, -x),
    "logabs": lambda x: np.log(np.maximum(np.abs(x), 1e-6)), "sigmoid": _sigmoid, "round": np.rint, "mod1": lambda x: x - np.floor(x),
    "selu": lambda x: 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0))), "relu6": lambda x: np.clip(x, 0, 6), "hardtanh": lambda x: np.clip(x, -1, 1),
    "indicator_01": lambda x: ((x >= 0) & (x <= 1)).astype(float), "onehot_argmax": lambda x: np.eye(x.shape[-1])[x.argmax(axis=-1)],
    "argsort": lambda x: x.argsort(axis=-1, kind="stable").astype(float), "rank": lambda x: x.argsort(axis=-1, kind="stable").argsort(axis=-1) + 1.0,
}


def _apply_activation(rng: np.random.Generator, plan: dict, x: np.ndarray) -> np.ndarray:
    kind = plan["kind"]
    if kind in _FIXED:
        return _FIXED[kind](x)
    if kind == "poly":
        return x ** plan["power"]
    if kind == "gumbel_softmax":
        return _softmax((x - np.log(-np.log(rng.uniform(1e-9, 1 - 1e-9, x.shape)))) / plan["temperature"])
    q = log_u(rng, 0.1, 10.0)
    if kind == "relu_pow":
        return np.maximum(x, 0) ** q
    if kind == "signed_pow":
        return np.sign(x) * np.abs(x) ** q
    if kind == "inv_pow":
        return (np.abs(x) + 1e-3) ** -q
    raise ValueError(f"unknown activation {kind!r}")


def activate(rng: np.random.Generator, x: np.ndarray, scaled: bool = True, plan: dict | None = None) -> np.ndarray:
    """A planned or random activation of standardised, scaled and shifted rows, standardised again."""
    z = standardize(x)
    if scaled:
        z = log_u(rng, 1.0, 10.0) * (z - z[rng.integers(len(z))])
    with np.errstate(all="ignore"):
        return standardize(_apply_activation(rng, plan or activation_plan(rng), z))


def lp_distances(x: np.ndarray, c: np.ndarray, p: float, block: int = 32) -> np.ndarray:
    """p-th powers of L_p distances of rows to centres, in blocks of centres."""
    return np.hstack([(np.abs(x[:, None] - c[None, i : i + block]) ** p).sum(axis=2) for i in range(0, len(c), block)])


def _radii(rng: np.random.Generator, shape: tuple[int, ...], a: float) -> np.ndarray:
    """Radii whose tail falls with the power a."""
    return (1 - rng.random(shape)) ** (1 / (1 - a)) - 1


def _fourier(rng: np.random.Generator, x: np.ndarray, plan: dict, out: int, sigma: float) -> np.ndarray:
    """Random Fourier features: frequencies by axis (ha), or along random directions of projected rows."""
    features, (n, d) = 256, x.shape
    a = log_u(rng, 2.0, 20.0)
    if plan["branch"] == "ha":
        w = _radii(rng, (features, d), a) * rng.choice([-1.0, 1.0], size=(features, d))
    else:
        way = rng.standard_normal((features, d))
        w = _radii(rng, (features, 1), a) * way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), EPS)
        x = x @ (log_u(rng, 0.5, 10.0) * random_weights(rng, d, sigma)[:, None] * rng.standard_normal((d, d))).T
    if plan["variant"] == "periodic":
        w = w * rng.integers(1, 6, size=(features, 1))
    elif plan["variant"] == "multiscale":
        low, high = log_u(rng, 0.35, 1.0), log_u(rng, 1.5, 6.0)
        w = w * np.where(np.arange(features)[:, None] < features // 2, low, high)
    z = np.cos(x @ w.T + rng.uniform(0, 2 * np.pi, features))
    return z @ rng.standard_normal((features, out)) / np.sqrt(features)


def apply_family(rng: np.random.Generator, family: str, x: np.ndarray, out: int, noise: dict | None = None, plan: dict | None = None, sigma: float = 1.0) -> np.ndarray:
    """One mechanism function of a family, from n rows to n rows of ``out`` values, by its plan (drawn if there is none)."""
    plan = plan or function_plan(rng, family, out)
    x = standardize(x)
    n, d = x.shape
    if family == "linear":
        return x @ random_matrix(rng, out, d, plan["matrix"]).T
    if family == "quadratic":
        some = rng.permutation(d)[:20]
        z = np.hstack([x[:, some], np.ones((n, 1))])
        return np.stack([((z @ random_matrix(rng, z.shape[1], z.shape[1], plan["matrix"])) * z).sum(axis=1) for _ in range(out)], axis=1)
    if family == "nn":
        h = activate(rng, x, plan=plan["before"]) if plan["before"] else x
        for i, (width, matrix) in enumerate(zip(plan["widths"], plan["matrices"], strict=True)):
            if i:
                h = activate(rng, h, plan=plan["between"][i - 1])
            h = h @ random_matrix(rng, width, h.shape[1], matrix).T
        return activate(rng, h, plan=plan["after"]) if plan["after"] else h
    if family == "tree":
        total, chance = np.zeros((n, out)), np.maximum(x.std(axis=0), 1e-12)
        for depth in plan["depths"]:
            f = rng.choice(d, size=depth, p=chance / chance.sum())
            t = x[rng.integers(n, size=depth), f]
            leaf = (x[:, f] > t) @ (1 << np.arange(depth))
            total += rng.standard_normal((1 << depth, out))[leaf]
        return total / len(plan["depths"])
    if family == "discretization":
        c = x[rng.permutation(n)[: min(n, plan["centers"])]]
        near = lp_distances(x, c, log_u(rng, 0.5, 4.0)).argmin(axis=1)
        return c[near] @ random_matrix(rng, out, d, plan["matrix"]).T
    if family == "gp":
        return _fourier(rng, x, plan, out, sigma)
    if family == "em":
        m = min(n, plan["centers"])
        c = x[rng.permutation(n)[:m]] + 0.1 * sample_noise(rng, (m, d), **(noise or {}))
        s, p, q = np.exp(0.1 * rng.standard_normal(m)), log_u(rng, 1.0, 4.0), log_u(rng, 1.0, 2.0)
        dist = lp_distances(x, c, p) ** (1 / p)
        return _softmax(-0.5 * np.log(2 * np.pi * s * s) - (dist / s) ** q) @ random_matrix(rng, out, m, plan["matrix"]).T
    if family in ("product", "piecewise"):
        one, two = (apply_family(rng, part["family"], x, out, noise, part, sigma) for part in plan["parts"])
        if family == "product":
            return standardize(one) * standardize(two)
        z = (x @ random_matrix(rng, 1, d, plan["gate"]).T + 1.5 * rng.uniform(-1, 1)) * log_u(rng, 2.0, 16.0)
        g = _sigmoid(z)
        return g * one + (1 - g) * two
    raise ValueError(f"unknown family {family!r}")


def root_points(rng: np.random.Generator, n: int, d: int, kind: str | None = None) -> np.ndarray:
    """Rows of a root node: normal, uniform, in the unit ball, or correlated normal."""
    kind = kind or one_of(rng, ROOTS)
    if kind == "normal":
        return rng.standard_normal((n, d))
    if kind == "uniform":
        return rng.uniform(-1, 1, (n, d))
    if kind == "unit_ball":
        way = rng.standard_normal((n, d))
        return way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12) * rng.random((n, 1)) ** (1 / d)
    if kind == "normal_cov":
        return (rng.standard_normal((n, d)) * random_weights(rng, d)) @ random_matrix(rng, d, d).T
    raise ValueError(f"unknown points {kind!r}")


def combine(parts: list[np.ndarray], how: str) -> np.ndarray:
    """Parents' outputs together: sum, product, max or logsumexp."""
    stack = np.stack(parts)
    if how == "logsumexp":
        top = stack.max(axis=0)
        return top + np.log(np.exp(stack - top).sum(axis=0))
    return {"sum": stack.sum, "product": stack.prod, "max": stack.max}[how](axis=0)


def numeric_converter(rng: np.random.Generator, x: np.ndarray, warp: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value, latent): the first column, and the latent or a Kumaraswamy warp of it."""
    value = x[:, 0].copy()
    if not warp:
        return value, x
    lo, hi = x.min(axis=0), x.max(axis=0)
    u = (x - lo) / np.maximum(hi - lo, EPS)
    return value, 1 - (1 - u ** log_u(rng, 0.2, 5.0)) ** log_u(rng, 0.2, 5.0)


def categorical_converter(rng: np.random.Generator, x: np.ndarray, k: int, plan: dict, noise: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label, latent): labels of the nearest of k rows, or drawn from a softmax; the latent stays, or becomes what the label stands for.

    index_repeat repeats the label's number; center is the row that names the label, center_random_fn a function of it;
    softmax_points are vectors of the labels' own.
    """
    n, d = x.shape
    c = x[rng.integers(n, size=k)]
    if plan["method"] == "neighbor":
        label = lp_distances(x, c, log_u(rng, 0.5, 4.0)).argmin(axis=1)
    else:
        z = x if d == k else x @ random_matrix(rng, k, d).T
        p = _softmax(log_u(rng, 0.1, 10.0) * standardize(z) + np.log(rng.random(k) + 1e-4))
        label = np.minimum((p.cumsum(axis=1) < rng.random((n, 1))).sum(axis=1), k - 1)
    variant = plan["variant"]
    if variant == "input":
        return label, x
    if variant == "index_repeat":
        return label, np.repeat(label[:, None].astype(np.float64), d, axis=1)
    if variant == "center":
        return label, c[label]
    if variant == "center_random_fn":
        return label, apply_family(rng, plan["function"]["family"], c[label], d, noise, plan["function"])
    if variant == "softmax_points":
        return label, rng.standard_normal((k, d))[label]
    raise ValueError(f"unknown variant {variant!r}")
