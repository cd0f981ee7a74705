"""Learnability filter: bagged extremely randomised trees, judged out of bag against the mean."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.rng import SeedPath


def _best_split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tries: int, leaf: int) -> tuple | None:
    """(loss, feature, threshold, left) of the best of ``tries`` random splits that leave ``leaf`` rows or more on each side."""
    best = None
    for f in rng.permutation(x.shape[1])[:tries]:
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo == hi:
            continue
        t = rng.uniform(lo, hi)
        left = x[:, f] <= t
        n = int(left.sum())
        if min(n, len(x) - n) < max(1, leaf):
            continue
        loss = y[left].var(axis=0).sum() * n + y[~left].var(axis=0).sum() * (len(x) - n)
        if best is None or loss < best[0]:
            best = (loss, f, t, left)
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tries: int, leaf: int = 1, leaves: int | None = None) -> list:
    """A tree as nested [feature, threshold, left, right] or a mean: the best of ``tries`` random splits at each node.

    With ``leaves`` the node whose split saves most is split first, until there are so many leaves; else all are, down to ``depth``.
    """
    if leaves is not None:
        return _grow_best_first(x, y, rng, depth, tries, leaf, leaves)
    if depth == 0 or len(x) < 2 * max(1, leaf) or (y == y[0]).all():
        return y.mean(axis=0)
    best = _best_split(x, y, rng, tries, leaf)
    if best is None:
        return y.mean(axis=0)
    _, f, t, left = best
    return [f, t, *(grow(x[side], y[side], rng, depth - 1, tries, leaf) for side in (left, ~left))]


def _grow_best_first(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tries: int, leaf: int, leaves: int) -> list:
    def look(at: np.ndarray, deep: int, put) -> None:
        own = y[at]
        if deep and len(at) >= 2 * max(1, leaf) and not (own == own[0]).all() and (best := _best_split(x[at], own, rng, tries, leaf)):
            heapq.heappush(todo, (best[0] - own.var(axis=0).sum() * len(at), next(number), at, deep, best, put))

    todo: list[tuple] = []
    number, root = count(), [y.mean(axis=0)]
    look(np.arange(len(x)), depth, lambda node: root.__setitem__(0, node))
    made = 1
    while todo and made < leaves:
        _, _, at, deep, (_, f, t, left), put = heapq.heappop(todo)
        node = [f, t, y[at[left]].mean(axis=0), y[at[~left]].mean(axis=0)]
        put(node)
        made += 1
        for place, side in ((2, left), (3, ~left)):
            look(at[side], deep - 1, lambda child, node=node, place=place: node.__setitem__(place, child))
    return root[0]


def features_tried(setting: str | int | float, n: int, classes: bool) -> int:
    """Features that a split tries: auto (the root of their number for classes, else all), sqrt, log2, a number, or a share."""
    if setting == "auto":
        setting = "sqrt" if classes else 1.0
    if setting in ("sqrt", "log2"):
        return max(1, int(np.sqrt(n) if setting == "sqrt" else np.log2(n)))
    if isinstance(setting, bool) or not isinstance(setting, (int, float)) or setting <= 0:
        raise ValueError(f"max_features: {setting!r}")
    return min(n, max(1, setting if isinstance(setting, int) else int(setting * n)))


def predict(tree, x: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    if not isinstance(tree, list):
        out[at] = tree
        return
    left = x[at, tree[0]] <= tree[1]
    predict(tree[2], x, out, at[left])
    predict(tree[3], x, out, at[~left])


def threshold_for(requested: float, n_classes: int) -> float:
    relax = 0.0 if n_classes <= 8 else 0.05 if n_classes <= 16 else 0.10 if n_classes <= 24 else 0.15
    return min(requested, max(requested - relax, 0.80))


def judge(x: np.ndarray, y: np.ndarray, task: str, rng: np.random.Generator, *, trees: int = 25, depth: int = 6, bootstraps: int = 200, threshold: float = 0.95, leaf: int = 1, leaves: int | None = None, max_features: str | int | float = "auto") -> dict:
    """wins_ratio, threshold, accepted and reason: the share of bootstraps of out-of-bag rows in which the forest beats the mean."""
    x, n = np.nan_to_num(x), len(x)
    k = len(np.unique(y)) if task == "classification" else 0
    t = np.eye(k)[np.unique(y, return_inverse=True)[1]] if k else y[:, None].astype(float)
    limit = threshold_for(threshold, k) if k else threshold
    tries = features_tried(max_features, x.shape[1], bool(k))
    total, seen = np.zeros_like(t), np.zeros(n)
    for _ in range(trees):
        bag = rng.integers(n, size=n)
        out = np.setdiff1d(np.arange(n), bag)
        if not len(out):
            continue
        p = np.zeros_like(t)
        predict(grow(x[bag], t[bag], rng, depth, tries, leaf, leaves), x, p, out)
        total[out] += p[out]
        seen[out] += 1
    ok = seen > 0
    result = {"wins_ratio": None, "threshold": limit, "n_valid_oob": int(ok.sum()), "accepted": False}
    if ok.sum() < max(32, n // 4):
        return result | {"reason": "insufficient_oob"}
    ours = ((total[ok] / seen[ok, None] - t[ok]) ** 2).mean(axis=1)
    base = ((t.mean(axis=0) - t[ok]) ** 2).mean(axis=1)
    at = rng.integers(len(ours), size=(bootstraps, len(ours)))
    wins = float((ours[at].mean(axis=1) < base[at].mean(axis=1)).mean())
    return result | {"wins_ratio": wins, "accepted": wins >= limit, "reason": "accepted" if wins >= limit else "below_threshold"}


VERDICT = "dataset_index long, n_rows long, n_valid_oob long, wins_ratio double, threshold double, accepted boolean, reason string"


def filter_datasets(rows: DataFrame, task: str, seed: int, **options) -> DataFrame:
    """One verdict for each dataset of packed rows; each is judged in a group of its own, seeded by its index."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        index = key[0].as_py()
        x, y = np.array(table.column("x").to_pylist(), dtype=np.float64), table.column("y").to_numpy()
        order = np.lexsort((*x.T[::-1], y))  # whatever order the rows come in
        v = judge(x[order], y[order], task, (SeedPath(seed) / "filter" / index).generator(), **options)
        return pa.table({k: pa.array([z], t) for k, z, t in (("dataset_index", index, pa.int64()), ("n_rows", len(x), pa.int64()), ("n_valid_oob", v["n_valid_oob"], pa.int64()), ("wins_ratio", v["wins_ratio"], pa.float64()), ("threshold", v["threshold"], pa.float64()), ("accepted", bool(v["accepted"]), pa.bool_()), ("reason", v["reason"], pa.string()))})

    return rows.groupBy("dataset_index").applyInArrow(one, VERDICT)


def curate(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of accepted datasets."""
    return rows.join(verdicts.where("accepted").select("dataset_index"), "dataset_index", "left_semi")
