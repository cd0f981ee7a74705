"""Logical planning of a corpus: shift, family probabilities, layout, graph and the plan of each node."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

import numpy as np

from ..functions.draws import AGGREGATIONS, FAMILIES, ROOTS, converter_plan, draw_family, function_plan, functions_of, log_u_int, one_of
from ..functions.rng import SeedPath, normalize_weights
from .config import Config

#: Base log-weights of the mechanism families under a tilt.
FAMILY_LOGITS = {"nn": 0.7, "tree": 0.7, "discretization": 0.5, "gp": 0.5, "linear": -0.8, "quadratic": -0.6, "em": -0.3, "product": 0.9, "piecewise": 0.8}
#: Fixed value: families that count as nonlinear.
NONLINEAR = ("nn", "tree", "discretization", "gp", "product", "piecewise")
#: piecewise takes part only where a mix names it.
DEFAULT_FAMILIES = tuple(f for f in FAMILIES if f != "piecewise")
#: Default scales (graph, mechanism, variance) of the shift modes.
SHIFT_DEFAULTS = {"off": (0, 0, 0), "graph_drift": (0.5, 0, 0), "mechanism_drift": (0, 0.5, 0), "noise_drift": (0, 0, 0.5), "mixed": (1 / 3, 1 / 3, 1 / 3), "custom": (0, 0, 0)}


@dataclass(frozen=True)
class ShiftParams:
    edge_logit_bias: float
    mechanism_tilt: float
    sigma_multiplier: float


def shift_params(config: Config) -> ShiftParams:
    s = config.shift
    g, m, v = (d if x is None else x for d, x in zip(SHIFT_DEFAULTS[s.mode], (s.graph_scale, s.mechanism_scale, s.variance_scale), strict=True))
    if s.mode == "off":
        g = m = v = 0
    return ShiftParams(math.log(2) * g, m, math.exp(0.5 * math.log(2) * v))


def family_probabilities(tilt: float = 0.0, mix: dict[str, float] | None = None) -> dict[str, float]:
    """Base weights times exp(tilt * centred logits), normalised."""
    base = normalize_weights(mix or dict.fromkeys(DEFAULT_FAMILIES, 1.0))
    mean = sum(FAMILY_LOGITS[f] for f in base) / len(base)
    return normalize_weights({f: w * math.exp(tilt * (FAMILY_LOGITS[f] - mean)) for f, w in base.items()})


def shift_facts(config: Config) -> dict[str, float]:
    """What the shift does, as metrics that each dataset of a corpus shares."""
    s, p = config.shift, shift_params(config)
    scales = (0, 0, 0) if s.mode == "off" else (d if x is None else x for d, x in zip(SHIFT_DEFAULTS[s.mode], (s.graph_scale, s.mechanism_scale, s.variance_scale), strict=True))
    shares = family_probabilities(p.mechanism_tilt, config.mechanism.function_family_mix)
    out = {"shift_enabled": s.mode != "off"} | dict(zip(("shift_graph_scale", "shift_mechanism_scale", "shift_variance_scale"), scales, strict=True))
    out |= {"shift_edge_odds_multiplier": math.exp(p.edge_logit_bias), "shift_mechanism_nonlinear_mass": sum(w for f, w in shares.items() if f in NONLINEAR), "shift_noise_variance_multiplier": p.sigma_multiplier**2}
    return {k: float(v) for k, v in out.items()}


@dataclass(frozen=True)
class Layout:
    n_features: int
    kinds: tuple[str, ...]
    cardinalities: tuple[int, ...]
    n_classes: int
    edges: tuple[tuple[int, int], ...]
    n_nodes: int
    feature_nodes: tuple[int, ...]
    target_node: int

    def signature(self) -> str:
        return stable_hash(asdict(self))


def stable_hash(payload: object, size: int = 16) -> str:
    """BLAKE2s of the canonical JSON of a payload."""
    return hashlib.blake2s(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode(), digest_size=size).hexdigest()


def sample_dag(rng: np.random.Generator, n: int, edge_bias: float = 0.0) -> list[tuple[int, int]]:
    """Edges src < dst, each with probability sigmoid(A + B_src + C_dst + bias), A, B and C Cauchy."""
    a, b, c = rng.standard_cauchy(), rng.standard_cauchy(n), rng.standard_cauchy(n)
    p = 1 / (1 + np.exp(-np.clip(a + b[:, None] + c[None, :] + edge_bias, -60, 60)))
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(rng.random((n, n)) < p, 1))]


def sample_layout(config: Config, seeds: SeedPath) -> Layout:
    d, rng = config.dataset, (seeds / "layout").generator()
    n = int(rng.integers(d.n_features_min, d.n_features_max + 1))
    ratio = d.categorical_ratio if d.categorical_ratio is not None else rng.uniform(d.categorical_ratio_min, d.categorical_ratio_max)
    cats = set(rng.permutation(n)[: round(ratio * n)].tolist())
    kinds = tuple("cat" if i in cats else "num" for i in range(n))
    cards = tuple(log_u_int(rng, 2, d.max_cardinality) if k == "cat" else 0 for k in kinds)
    classes = int(rng.integers(d.n_classes_min, d.n_classes_max + 1)) if d.task == "classification" else 0
    nodes = max(2, log_u_int(rng, config.graph.n_nodes_min, config.graph.n_nodes_max))
    edges = tuple(sample_dag((seeds / "graph").generator(), nodes, shift_params(config).edge_logit_bias))
    eligible = np.sort(rng.permutation(nodes)[: int(rng.integers(1, nodes + 1))])
    return Layout(n, kinds, cards, classes, edges, nodes, tuple(int(x) for x in rng.choice(eligible, n)), int(rng.choice(eligible)))


def longest_path(edges: list[tuple[int, int]], n: int) -> int:
    """Nodes on the longest path of a graph whose edges go upwards."""
    deep = [1] * n
    for s, t in sorted(edges, reverse=True):
        deep[s] = max(deep[s], 1 + deep[t])
    return max(deep, default=0)


def edge_density(n_edges: int, n: int) -> float:
    return n_edges / (n * (n - 1) / 2) if n > 1 else 0.0


def sample_plan(config: Config, layout: Layout, seeds: SeedPath) -> dict:
    """The typed plan of all nodes, as JSON: source, width, functions and converters, shared by all datasets of the layout."""
    shift = shift_params(config)
    odds = family_probabilities(shift.mechanism_tilt, config.mechanism.function_family_mix)
    nodes = []
    for node in range(layout.n_nodes):
        rng = (seeds / "plan" / node).generator()
        parents = [s for s, t in layout.edges if t == node]
        own = [i for i, x in enumerate(layout.feature_nodes) if x == node]
        converters = []
        for i in own + ([-1] if layout.target_node == node else []):
            card = layout.cardinalities[i] if i >= 0 else layout.n_classes
            width = 1 if not card else card if rng.random() < 0.5 or card <= 2 else int(rng.integers(1, card))
            width = max(width, 2) if i < 0 and card else width
            converters.append({"feature": i, "cardinality": card, "width": width, "plan": converter_plan(rng, card, width, odds)})
        width = max(1, sum(c["width"] for c in converters)) + log_u_int(rng, 1, 8)
        source = "root" if not parents else "concat" if rng.random() < 0.5 else "stacked"
        functions = [function_plan(rng, draw_family(rng, odds), width) for _ in (parents if source == "stacked" else [0])]
        base = one_of(rng, ROOTS) if source == "root" else None
        nodes.append({"node": node, "parents": parents, "source": source, "base": base, "functions": functions, "aggregation": one_of(rng, AGGREGATIONS), "width": width, "converters": converters})
    return {"nodes": nodes, "sigma_multiplier": shift.sigma_multiplier}


class CorrelatedSampler:
    """Draws by name: all draws of a name share latent parameters, so they resemble each other; each is keyed by its number."""

    def __init__(self, seeds: SeedPath):
        self.seeds = seeds
        self.draws: dict[tuple, int] = {}

    def _next(self, *key: object) -> np.random.Generator:
        n = self.draws[key] = self.draws.get(key, -1) + 1
        return (self.seeds / "draw" / "/".join(map(str, key)) / n).generator()

    def number(self, name: str, low: float, high: float, *, log: bool = False, whole: bool = False) -> float | int:
        """A value between low and high from the name's Beta distribution, of a mean and a strength drawn once."""
        latent = (self.seeds / "number" / name).generator()
        mean, strength = latent.random(), float(np.exp(latent.uniform(np.log(0.1), np.log(1e4))))
        u = self._next("number", name).beta(max(strength * mean, 1e-12), max(strength * (1 - mean), 1e-12))
        value = float(low * (high / low) ** u) if log else low + u * (high - low)
        return int(np.floor(value)) if whole else value

    def category(self, name: str, n: int) -> int:
        """One of n categories by weights drawn once for the name."""
        raw = (self.seeds / "weights" / name / n).generator().random(n) + 1e-6
        return int(self._next("category", name, n).choice(n, p=raw / raw.sum()))


def plan_rows(plan: dict) -> list[tuple[str, str | None, int]]:
    """(family, gp variant, depth of nesting) of each function of a plan, nested ones included."""
    return [(f["family"], f.get("variant"), depth) for f, depth in functions_of(plan)]


def plan_family_counts(plan: dict) -> dict[str, int]:
    """Functions of each family, nested ones included."""
    out: dict[str, int] = {}
    for family, _, _ in plan_rows(plan):
        out[family] = out.get(family, 0) + 1
    return out


def gp_variant_counts(plan: dict) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, variant, _ in plan_rows(plan):
        if variant is not None:
            out[variant] = out.get(variant, 0) + 1
    return out


def dataset_id(run: str, layout: str, index: int, seed: int) -> str:
    return stable_hash({"run": run, "layout": layout, "index": index, "seed": seed})
