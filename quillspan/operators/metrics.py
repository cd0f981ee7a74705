"""Profiles of datasets: class structure, correlations, proxies, and the whole metric row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import SeedPath
from .extra_trees import judge
from .ordering import sums_before


def class_structure(df: DataFrame, label: str, group: list[str]) -> DataFrame:
    """(group, n_classes, entropy in nats, imbalance): counts first, then their summary."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    p = F.col("n") / F.sum("n").over(w)
    out = counts.withColumn("t", -p * F.ln(p)).groupBy(*group)
    return out.agg(F.count("*").alias("n_classes"), F.sum("t").alias("entropy"), (F.max("n") / F.min("n")).alias("imbalance"), F.sum("n").alias("n_rows"))


def label_range(df: DataFrame, label: str, group: list[str]) -> DataFrame:
    """(group, n, n_classes, lo, hi, contiguous): whether whole-number labels run from the least to the greatest without a gap."""
    k = F.count_distinct(label)
    return df.groupBy(*group).agg(F.count("*").alias("n"), k.alias("n_classes"), F.min(label).alias("lo"), F.max(label).alias("hi"), (F.max(label) - F.min(label) + 1 == k).alias("contiguous"))


def categorical_cardinality(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, feature, cardinality): distinct non-null values of each column."""
    return df.groupBy(*group).agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot(group, columns, "feature", "cardinality")


def corr(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson's r from moments; null for a constant column."""
    root = F.sqrt(F.greatest(F.lit(0.0), n * xx - x * x)) * F.sqrt(F.greatest(F.lit(0.0), n * yy - y * y))
    return F.try_divide(n * xy - x * y, F.when(root > 1e-9, root))


def pearson_pairs(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, a, b, r) for each two columns; one aggregation gathers all moments at once."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    c = {v: F.col(v).cast("double") for v in columns}
    aggs = [F.count("*").cast("double").alias("n"), *[F.sum(c[v]).alias(f"s#{v}") for v in columns], *[F.sum(c[v] * c[v]).alias(f"q#{v}") for v in columns], *[F.sum(c[a] * c[b]).alias(f"p#{a}#{b}") for a, b in pairs]]
    wide = df.groupBy(*group).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(F.col("n"), F.col(f"s#{a}"), F.col(f"s#{b}"), F.col(f"q#{a}"), F.col(f"q#{b}"), F.col(f"p#{a}#{b}")).alias("r")) for a, b in pairs))
    return wide.select(*group, F.explode(rows).alias("x")).select(*group, "x.a", "x.b", "x.r")


def abs_summary(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(group, mean_abs, max_abs) of correlations, undefined ones left out."""
    return pairs.groupBy(*group).agg(F.avg(F.abs("r")).alias("mean_abs"), F.max(F.abs("r")).alias("max_abs"))


def average_ranks(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, column values replaced by their average ranks).

    Ranks are made on the table of distinct values with their counts, range by range, so that no task sorts a
    whole group, and joined back.
    """
    out = df
    for v in columns:
        counts = df.groupBy(*group, v).agg(F.count("*").alias("n"))
        ranks = sums_before(counts, v, "n", group, "before").withColumn("r", F.col("before") + (F.col("n") + 1) / 2)
        right = ranks.select(*[F.col(g).alias(f"g#{g}") for g in group], F.col(v).alias("g#v"), F.col("r").alias(f"r#{v}"))
        out = out.join(right, [out[v].eqNullSafe(right["g#v"]), *[out[g].eqNullSafe(right[f"g#{g}"]) for g in group]], "left").drop("g#v", *[f"g#{g}" for g in group])
    return out.withColumns({v: F.col(f"r#{v}") for v in columns}).drop(*[f"r#{v}" for v in columns])


def ridge(x: np.ndarray, y: np.ndarray, to: np.ndarray, lam: float = 1e-6) -> np.ndarray:
    """Predictions at ``to`` of a ridge fit with a free intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = lam * np.eye(a.shape[1])
    penalty[-1, -1] = 0
    try:
        w = np.linalg.solve(a.T @ a + penalty, a.T @ y)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(a.T @ a + penalty) @ (a.T @ y)
    return np.hstack([to, np.ones((len(to), 1))]) @ w


def _targets(y: np.ndarray, task: str) -> np.ndarray:
    return np.eye(int(y.max()) + 1)[y.astype(int)] if task == "classification" else y[:, None]


def linearity_proxy(x_tr: np.ndarray, y_tr: np.ndarray, x_te: np.ndarray, y_te: np.ndarray, rng: np.random.Generator, n: int = 200) -> float:
    """Share of bootstraps of the test rows in which the ridge fit beats the mean."""
    ours = ((ridge(x_tr, y_tr, x_te) - y_te) ** 2).mean(axis=1)
    base = ((y_tr.mean(axis=0) - y_te) ** 2).mean(axis=1)
    at = rng.integers(len(y_te), size=(n, len(y_te)))
    return float((ours[at].mean(axis=1) < base[at].mean(axis=1)).mean())


def snr_proxy_db(x_tr: np.ndarray, y_tr: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    pred = ridge(x_tr, y_tr, x)
    return float(10 * np.log10(max(pred.var(), 1e-12) / max((y - pred).var(), 1e-12)))


PROFILE = "dataset_index long, metric string, value double"
#: The metrics of a profile.
METRICS = (
    "n_rows", "n_features", "linearity_proxy", "snr_proxy_db", "pearson_abs_mean", "pearson_abs_max", "spearman_abs_mean", "spearman_abs_max", "wins_ratio_proxy", "nonlinearity_proxy",
    "n_categorical_features", "categorical_ratio", "cat_cardinality_min", "cat_cardinality_mean", "cat_cardinality_max", "n_classes", "class_entropy", "majority_minority_ratio",
)


def _pair_summary(x: np.ndarray) -> tuple[float, float] | None:
    """Mean and largest absolute correlation over pairs of columns; constant columns take no part."""
    with np.errstate(all="ignore"):
        r = np.abs(np.corrcoef(x.T)[np.triu_indices(x.shape[1], 1)])
    r = r[np.isfinite(r)]
    return (float(r.mean()), float(r.max())) if len(r) else None


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    """Each column's ranks from 1, ties at their mean."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        _, at, n = np.unique(x[:, k], return_inverse=True, return_counts=True)
        out[:, k] = (np.cumsum(n) - (n - 1) / 2)[at]
    return out


def profile_datasets(rows: DataFrame, task: str, seed: int, *, kinds: tuple[str, ...] | None = None, spearman: bool = False, forest: bool = False, only: frozenset[str] | None = None) -> DataFrame:
    """(dataset_index, metric, value) of packed rows: sizes, linearity and signal proxies, correlations, class measures.

    kinds adds counts and cardinalities of the categorical features, spearman rank correlations, and
    forest the extra trees' wins ratio and what of it the linear fit leaves (both costly).  ``only`` names the metrics asked for:
    nothing else is computed that they do not need.  Splits of different widths, or rows without a label, are errors.
    """
    if only is not None and (unknown := set(only) - set(METRICS)):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    wanted = lambda *names: only is None or bool(only & set(names))
    spearman = (spearman if only is None else wanted("spearman_abs_mean", "spearman_abs_max"))
    forest = (forest if only is None else wanted("wins_ratio_proxy", "nonlinearity_proxy"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        index = key[0].as_py()
        order = np.lexsort((table.column("row_index").to_numpy(), np.array(table.column("split").to_pylist())))
        table = table.take(order)
        width = pa.compute.list_value_length(table.column("x"))
        if table.column("y").null_count or len(pa.compute.unique(width)) > 1 or width.null_count:
            raise ValueError(f"dataset {index}: rows of different widths, or without features or a label")
        column = table.column("x").combine_chunks()
        raw = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
        x = np.nan_to_num(raw)
        y, train = table.column("y").to_numpy(), np.array(table.column("split").to_pylist()) == "train"
        t = _targets(y, task)
        rng = (SeedPath(seed) / "profile" / index).generator()
        out = {"n_rows": float(len(x)), "n_features": float(x.shape[1])}
        if train.any() and not train.all():
            if wanted("linearity_proxy", "nonlinearity_proxy"):
                out["linearity_proxy"] = linearity_proxy(x[train], t[train], x[~train], t[~train], rng)
            if wanted("snr_proxy_db"):
                out["snr_proxy_db"] = snr_proxy_db(x[train], t[train], x, t)
        for name, v in (*([("pearson", x)] if wanted("pearson_abs_mean", "pearson_abs_max") else []), *([("spearman", _mean_ranks(x))] if spearman else [])):
            if x.shape[1] > 1 and (pair := _pair_summary(v)):
                out |= {f"{name}_abs_mean": pair[0], f"{name}_abs_max": pair[1]}
        if forest:
            wins = judge(x, y, task, (SeedPath(seed) / "wins" / index).generator())["wins_ratio"]
            if wins is not None:
                out["wins_ratio_proxy"] = wins
                if "linearity_proxy" in out:
                    out["nonlinearity_proxy"] = max(0.0, wins - out["linearity_proxy"])
        if kinds is not None:
            held = [len(np.unique(raw[np.isfinite(raw[:, k]), k])) for k, kind in enumerate(kinds) if kind == "cat"]
            out |= {"n_categorical_features": float(len(held)), "categorical_ratio": len(held) / max(1, len(kinds))}
            if held:
                out |= {"cat_cardinality_min": float(min(held)), "cat_cardinality_mean": float(np.mean(held)), "cat_cardinality_max": float(max(held))}
        if task == "classification":
            n = np.bincount(y.astype(int))
            p = n[n > 0] / n.sum()
            out |= {"n_classes": float(len(p)), "class_entropy": float(-(p * np.log(p)).sum()), "majority_minority_ratio": float(p.max() / p.min())}
        out = {k: v for k, v in out.items() if wanted(k)}
        return pa.table({"dataset_index": pa.array([index] * len(out), pa.int64()), "metric": list(out), "value": pa.array(list(out.values()), pa.float64())})

    return rows.groupBy("dataset_index").applyInArrow(one, PROFILE)


def infer_task(df: DataFrame, y: str, group: list[str]) -> DataFrame:
    """(group, task): classification where all labels are near whole numbers and few enough for the rows."""
    per = df.groupBy(*group).agg(F.max(F.abs(F.col(y) - F.rint(F.col(y)))).alias("off"), F.count_distinct(y).alias("k"), F.count("*").alias("n"))
    few = F.col("k") <= F.greatest(F.lit(10), F.floor(F.sqrt("n")) + 1)
    return per.select(*group, F.when((F.col("off") <= 1e-8) & few, "classification").otherwise("regression").alias("task"))
