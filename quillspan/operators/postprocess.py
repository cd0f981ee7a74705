"""Transforms of tables by group: clipping, standardising, labels, missing values, splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import log_uniform, uniform
from .ordering import exact_percentiles, join_groups, places


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns to rows of (ids, name, value)."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, name, value)


def _grouped(df: DataFrame, group: list[str], aggs: list[Column]) -> DataFrame:
    """Row-wise df with aggregates of its group; a small table of groups joins back, and Spark picks how."""
    return join_groups(df, df.groupBy(*group).agg(*aggs), group)


def clip_bounds(df: DataFrame, group: list[str], values: list[str], low: float = 0.01, high: float = 0.99, exact: bool = True) -> DataFrame:
    """(group, q#v: two quantiles of each value), interpolated linearly, or by sketches where exact is False."""
    if exact:
        return exact_percentiles(df, {f"q#{v}": F.col(v) for v in values}, (low, high), group)
    return df.groupBy(*group).agg(*[F.percentile_approx(F.col(v), [low, high], 10_000).alias(f"q#{v}") for v in values])


def clip_standardize(df: DataFrame, values: list[str], group: list[str] | None = None, *, exact: bool = True, floor: float = 1e-6) -> DataFrame:
    """df with each value clipped to its group's 1st and 99th percentiles, and then z-scored by population statistics.

    Bounds first, exact in bounded memory (see ordering.exact_percentiles), then mean and deviation of the clipped values.
    exact=False saves the second look at the values for the bounds.
    """
    group = group or []
    bounded = join_groups(df, clip_bounds(df, group, values, exact=exact), group)
    clipped = bounded.withColumns({v: F.least(F.greatest(F.col(v), F.col(f"q#{v}")[0]), F.col(f"q#{v}")[1]) for v in values}).drop(*[f"q#{v}" for v in values])
    stats = [x for v in values for x in (F.avg(v).alias(f"m#{v}"), F.greatest(F.stddev_pop(v), F.lit(floor)).alias(f"s#{v}"))]
    full = _grouped(clipped, group, stats)
    return full.withColumns({v: (F.col(v) - F.col(f"m#{v}")) / F.col(f"s#{v}") for v in values}).drop(*[f"{p}#{v}" for v in values for p in "ms"])


def sanitize_standardize(df: DataFrame, values: list[str], group: list[str] | None = None, *, floor: float = 1e-6) -> DataFrame:
    """df with NaN and infinities cleaned, clamped to +-1e6, and z-scored by sample statistics."""
    from ..functions.activations import sanitize

    clean = df.withColumns({v: sanitize(F.col(v)) for v in values})
    stats = [x for v in values for x in (F.avg(v).alias(f"m#{v}"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(floor)).alias(f"s#{v}"))]
    full = _grouped(clean, group or [], stats)
    return full.withColumns({v: (F.col(v) - F.col(f"m#{v}")) / F.col(f"s#{v}") for v in values}).drop(*[f"{p}#{v}" for v in values for p in "ms"])


def random_activation(df: DataFrame, value: str, apply: Callable[[Column], Column], seed: int, *key: str, group: list[str] | None = None) -> DataFrame:
    """df with its value standardised, shifted by a drawn row's, stretched by a factor drawn between 1 and 10, passed through an activation, cleaned and standardised again, by group.

    The drawn row is the one of least hashed key, so that no row is numbered.
    """
    from ..functions.activations import sanitize

    group = group or []
    v, drawn = F.col(value), F.struct(uniform(seed, "shift", *key), *key)
    stats = [F.avg(v).alias("m#"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias("s#"), F.min_by(v, drawn).alias("b#")]
    full = _grouped(df, group, stats)
    stretch = log_uniform(uniform(seed, "stretch", *[F.col(g) for g in group]), 1.0, 10.0)
    full = full.withColumn(value, sanitize(apply(stretch * (v - F.col("b#")) / F.col("s#")))).drop("m#", "s#", "b#")
    again = _grouped(full, group, [F.avg(v).alias("m#"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias("s#")])
    return again.withColumn(value, (v - F.col("m#")) / F.col("s#")).drop("m#", "s#")


def constant_columns(df: DataFrame, values: list[str], group: list[str], floor: float = 1e-12) -> DataFrame:
    """(group, feature, sd, keep): whether a column's population deviation exceeds floor in each group."""
    long = unpivot(df, group, values)
    return long.groupBy(*group, "feature").agg(F.stddev_pop("value").alias("sd")).withColumn("keep", F.col("sd") > floor)


def drop_constant_columns(df: DataFrame, values: list[str], floor: float = 1e-12) -> DataFrame:
    """df without the columns that do not vary; an error if none is left."""
    row = df.agg(*[F.stddev_pop(v).alias(v) for v in values]).first()
    gone = [v for v in values if not (row[v] or 0) > floor]
    if len(gone) == len(values):
        raise ValueError("every column is constant")
    return df.drop(*gone)


def permute_columns(df: DataFrame, values: list[str], seed: int) -> tuple[DataFrame, list[int]]:
    """df with the value columns in a seeded order, and the map from new to old places."""
    order = np.random.Generator(np.random.Philox(key=seed)).permutation(len(values)).tolist()
    rest = [c for c in df.columns if c not in values]
    return df.select(*rest, *[values[i] for i in order]), order


def densify_labels(df: DataFrame, label: str, group: list[str] | None = None, *, seed: int | None = None, out: str = "code") -> DataFrame:
    """df with labels as 0..k-1 in order of value, or in a seeded order of the labels; the table of labels is what is ranked."""
    group = group or []
    labels = df.select(*group, label).where(F.col(label).isNotNull()).distinct()
    order = F.col(label) if seed is None else uniform(seed, "labels", *group, label)
    w = Window.partitionBy(*group).orderBy(order, label) if group else Window.orderBy(order, label)
    table = labels.withColumn(out, F.row_number().over(w) - 1)
    right = table.select(*[F.col(g).alias(f"g#{g}") for g in group], F.col(label).alias("g#label"), out)
    cond = [df[label] == right["g#label"], *[df[g].eqNullSafe(right[f"g#{g}"]) for g in group]]
    return df.join(right, cond, "left").drop("g#label", *[f"g#{g}" for g in group])


def mcar(df: DataFrame, values: list[str], rate: float, seed: int, *key: str) -> DataFrame:
    """df with each value NaN with probability ``rate``, by a draw of the row's key."""
    return df.withColumns({v: F.when(uniform(seed, f"mcar/{v}", *key) < rate, float("nan")).otherwise(F.col(v).cast("double")) for v in values})


def calibrate_intercept(logits: np.ndarray, rate: float, steps: int = 48) -> float:
    """b with mean(sigmoid(logits + b)) = rate, by bisection on [-30, 30]."""
    lo, hi = -30.0, 30.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if (1 / (1 + np.exp(-np.clip(logits + mid, -60, 60)))).mean() < rate:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def missing_mask(x: np.ndarray, mechanism: str, rate: float, rng: np.random.Generator, *, observed: float = 0.5, scale: float = 1.0) -> np.ndarray:
    """Cells to hide, of one split: at random, by other columns (mar), or by their own value (mnar)."""
    n, d = x.shape
    if rate >= 1:
        return np.ones((n, d), dtype=bool)
    if rate <= 0 or mechanism == "none":
        return np.zeros((n, d), dtype=bool)
    if mechanism == "mcar":
        return rng.random((n, d)) < rate
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    if mechanism == "mar":
        w = rng.standard_normal((d, d)) * (rng.random((d, d)) < observed)
        np.fill_diagonal(w, 0)
        logits = scale * (z @ w) / np.sqrt(np.maximum((w != 0).sum(axis=0), 1))
    elif mechanism == "mnar":
        logits = scale * z * rng.standard_normal(d)
    else:
        raise ValueError(f"unknown mechanism {mechanism!r}")
    p = 1 / (1 + np.exp(-np.clip(logits + calibrate_intercept(logits, rate), -60, 60)))
    return rng.random((n, d)) < p


def mnar_logits(df: DataFrame, value: str, scale: float, group: list[str] | None = None) -> DataFrame:
    """df with logit (scale times the value standardised in its group) and p, its sigmoid: how a value's own size hides it."""
    full = _grouped(df, group or [], [F.avg(value).alias("m#"), F.greatest(F.stddev_pop(value), F.lit(1e-6)).alias("s#")])
    out = full.withColumn("logit", F.lit(float(scale)) * (F.col(value) - F.col("m#")) / F.col("s#")).drop("m#", "s#")
    return out.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


def inject_missing(rows: DataFrame, mechanism: str, rate: float, seed: int, *, observed: float = 0.5, scale: float = 1.0) -> DataFrame:
    """Packed rows (dataset_index, split, row_index, x, y) with NaN where values are hidden; each split on its own."""
    from ..functions.rng import SeedPath

    schema = rows.schema

    def one(key: tuple, table: pa.Table) -> pa.Table:
        index, split = (k.as_py() for k in key)
        table = table.sort_by("row_index").combine_chunks()
        x = _matrix_of(table).astype(np.float64)
        hide = missing_mask(x, mechanism, rate, (SeedPath(seed) / "missing" / index / split).generator(), observed=observed, scale=scale)
        x[hide] = np.nan
        return _with_matrix(table, x)

    return rows.groupBy("dataset_index", "split").applyInArrow(one, schema)


def stratified_split(df: DataFrame, label: str, share: float, seed: int, *key: str, group: list[str] | None = None) -> DataFrame:
    """df with is_train: floor(n * share) rows of each class, by seeded rank, and the deficit of the group by largest remainder.

    Shares are decided on the table of classes; rows are ranked inside their class by a draw of their key.
    """
    group = group or []
    n = F.col("n")
    classes = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    base = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * share)))).otherwise(F.floor(n * share)).cast("long")
    total = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    classes = classes.withColumn("base", base).withColumn("rest", n * share - F.floor(n * share))
    classes = classes.withColumn("deficit", F.floor(F.sum("n").over(total) * share) - F.sum("base").over(total))
    place = F.row_number().over(total.orderBy(F.desc("rest"), label))
    classes = classes.withColumn("place", place)
    take = F.col("base") + F.when((F.col("place") <= F.col("deficit")) & (F.col("base") < F.greatest(n - 1, F.lit(1))), 1).otherwise(0)
    right = classes.select(*[F.col(g).alias(f"g#{g}") for g in group], F.col(label).alias("g#label"), take.alias("g#take"))
    joined = df.join(right, [df[label].eqNullSafe(right["g#label"]), *[df[g].eqNullSafe(right[f"g#{g}"]) for g in group]])
    placed = places(joined, uniform(seed, "split", *key), list(key), [*group, label], "place#")
    return placed.withColumn("is_train", F.col("place#") < F.col("g#take")).drop("place#", "g#label", "g#take", *[f"g#{g}" for g in group])


def split_classes_match(df: DataFrame, label: str, is_train: str, group: list[str]) -> DataFrame:
    """(group, valid): whether both splits hold the same classes, two or more."""
    per = df.groupBy(*group, label).agg(F.max(F.col(is_train).cast("int")).alias("a"), F.max((~F.col(is_train)).cast("int")).alias("b"))
    return per.groupBy(*group).agg(((F.count("*") > 1) & (F.min("a") == 1) & (F.min("b") == 1)).alias("valid"))


def keyed_permutation(df: DataFrame, seed: int, *key: str, group: list[str]) -> DataFrame:
    """df with position: the row's place, from 0, in a seeded order of its group."""
    return places(df, uniform(seed, "permutation", *key), list(key), group)


def bottom_k_sample(df: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """k rows at random, the same for any partitioning: those of least draw."""
    return df.withColumn("u", uniform(seed, "reservoir", *key)).orderBy("u", *key).limit(k)


def clipped(v: np.ndarray) -> np.ndarray:
    """Columns clipped to their 1st and 99th percentiles and standardised."""
    lo, hi = np.quantile(v, [0.01, 0.99], axis=0)
    v = np.clip(v, lo, hi)
    return (v - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-6)


def finish_dataset(x: np.ndarray, y: np.ndarray, n_train: int, kinds: tuple[str, ...], task: str, *, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A dataset (train rows first) with numeric features clipped and standardised over both splits, and so a regression target.

    With rng, columns that do not vary go (all stay if none does), the rest are put in a drawn order, and class labels
    are numbered anew in a drawn order; where a split holds fewer than two classes labels are numbered in their own order.
    """
    numeric = np.array([k == "num" for k in kinds])
    x = x.astype(np.float64)
    x[:, numeric] = clipped(x[:, numeric])
    if task == "regression":
        y = clipped(y)
    if rng is not None:
        keep = np.flatnonzero(x.std(axis=0) > 1e-12)
        x = x[:, rng.permutation(keep if len(keep) else x.shape[1])]
        if task == "classification":
            labels, code = np.unique(y, return_inverse=True)
            drawn = rng.permutation(len(labels)) if min(len(np.unique(y[:n_train])), len(np.unique(y[n_train:]))) > 1 else np.arange(len(labels))
            y = drawn[code].astype(np.float64)
    return x.astype(np.float32), y


def hide_cells(x: np.ndarray, n_train: int, index: int, mechanism: str, rate: float, seed: int, *, observed: float = 0.5, scale: float = 1.0) -> np.ndarray:
    """x (train rows first) with NaN where values are hidden, each split on its own; as inject_missing does it."""
    from ..functions.rng import SeedPath

    out = x.astype(np.float64)
    for split, part in (("train", slice(0, n_train)), ("test", slice(n_train, len(x)))):
        rng = (SeedPath(seed) / "missing" / index / split).generator()
        if len(out[part]):
            out[part][missing_mask(out[part], mechanism, rate, rng, observed=observed, scale=scale)] = np.nan
    return out.astype(np.float32)


def _matrix_of(table: pa.Table) -> np.ndarray:
    """The list column x of rows of one length."""
    column = table.column("x").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _with_matrix(table: pa.Table, x: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=np.float32).ravel()))
    return table.set_column(table.schema.get_field_index("x"), "x", lists)


def postprocess_corpus(rows: DataFrame, kinds: tuple[str, ...], task: str, *, seed: int | None = None) -> DataFrame:
    """Packed rows of a written corpus, each dataset as finish_dataset leaves it; with a seed also its columns and labels are drawn anew."""
    from ..functions.rng import SeedPath

    schema = T.StructType(rows.schema.fields)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        index = key[0].as_py()
        train = pa.compute.equal(table.column("split"), "train")
        table = table.append_column("held#", pa.compute.cast(pa.compute.invert(train), pa.int8())).sort_by([("held#", "ascending"), ("row_index", "ascending")]).drop_columns("held#")
        n_train = int(pa.compute.sum(pa.compute.cast(train, pa.int64())).as_py())
        rng = None if seed is None else (SeedPath(seed) / "finish" / index).generator()
        x, y = finish_dataset(_matrix_of(table), table.column("y").to_numpy(), n_train, kinds, task, rng=rng)
        return _with_matrix(table, x).set_column(table.schema.get_field_index("y"), "y", pa.array(y.astype(np.float64)))

    return rows.groupBy("dataset_index").applyInArrow(one, schema)
