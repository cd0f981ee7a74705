"""Corpus generation: ranges of datasets, each made whole in one task."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.rng import SeedPath, derive_seed, sample_noise
from ..plans.config import Config
from ..plans.sampling import dataset_id, longest_path, sample_layout, sample_plan, shift_params, stable_hash

ROWS = "dataset_index long, split string, row_index long, x array<float>, y double, attempt int"


def make_dataset(config: Config, layout, plan: dict, seed: int, n: int, labels_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
    """Features [n, d] and target of one dataset: nodes in order of the graph, then converters."""
    seeds, sigma = SeedPath(seed), plan["sigma_multiplier"]
    noise = {"family": config.noise.family, "df": config.noise.student_t_df, "weights": config.noise.mixture_weights}
    if noise["family"] == "mixture":  # one family for each dataset
        share = noise["weights"] or {"gaussian": 1, "laplace": 1, "student_t": 1}
        pick = (seeds / "noise").generator()
        noise = noise | {"family": list(share)[int(pick.choice(len(share), p=np.array(list(share.values())) / sum(share.values())))]}
    latent: dict[int, np.ndarray] = {}
    x, y = np.zeros((n, layout.n_features), dtype=np.float32), np.zeros(n)
    for node in plan["nodes"]:
        rng = (seeds / "node" / node["node"]).generator()
        width = node["width"]
        f = node["functions"]
        if node["source"] == "root":
            h = K.root_points(rng, n, width, node["base"])
            h = K.apply_family(rng, f[0]["family"], h, width, noise, f[0], sigma)
        elif node["source"] == "concat":
            h = K.apply_family(rng, f[0]["family"], np.hstack([latent[p] for p in node["parents"]]), width, noise, f[0], sigma)
        else:
            h = K.combine([K.standardize(K.apply_family(rng, g["family"], latent[p], width, noise, g, sigma)) for g, p in zip(f, node["parents"], strict=True)], node["aggregation"])
        h = h + 0.01 * sigma * config.noise.scale * sample_noise(rng, h.shape, **noise)
        h = K.standardize(h) * K.random_weights(rng, width, sigma)
        h = h / max(float(np.linalg.norm(h, axis=1).mean()), 1e-12)
        at = 0
        for c in node["converters"]:
            part = h[:, at : at + c["width"]]
            if c["cardinality"]:
                value, part = K.categorical_converter(rng, part, c["cardinality"], c["plan"], noise)
            else:
                value, part = K.numeric_converter(rng, part, c["plan"]["warp"])
            h[:, at : at + c["width"]] = part
            at += c["width"]
            if c["feature"] < 0:
                y = value.astype(np.float64)
            elif not labels_only:
                x[:, c["feature"]] = value
        latent[node["node"]] = h * K.log_u(rng, 0.1, 10.0)
    return None if labels_only else x, y


def split_is_valid(train: np.ndarray, test: np.ndarray) -> bool:
    a, b = set(train.tolist()), set(test.tolist())
    return len(a) > 1 and a == b


def stratified_order(y: np.ndarray, n_train: int, rng: np.random.Generator) -> np.ndarray:
    """True for train rows: shares of each class by floor, the rest by largest remainder, then label."""
    labels, inverse, counts = np.unique(y, return_inverse=True, return_counts=True)
    want = counts * (n_train / len(y))
    take = np.clip(np.floor(want).astype(int), np.where(counts > 1, 1, 0), np.where(counts > 1, counts - 1, 1))
    order = np.lexsort((labels, -(want - np.floor(want))))
    step = 1 if take.sum() < n_train else -1
    stuck = 0
    while take.sum() != n_train and stuck < len(labels):
        stuck = 0
        for k in order:
            if take.sum() == n_train:
                break
            lo, hi = (1, counts[k] - 1) if counts[k] > 1 else (0, 1)
            if lo <= take[k] + step <= hi:
                take[k] += step
            else:
                stuck += 1
    out = np.zeros(len(y), dtype=bool)
    for k in range(len(labels)):
        out[rng.permutation(np.flatnonzero(inverse == k))[: take[k]]] = True
    return out


def split_sizes(config: Config) -> tuple[int, int]:
    """Rows of train and test, resolved once for a run."""
    d = config.dataset
    if d.rows is None:
        return d.n_train, d.n_test
    total = d.rows.resolve((SeedPath(config.seed) / "rows").generator())
    n_test = total * d.n_test // (d.n_train + d.n_test)
    return total - n_test, n_test


def one_dataset(config: Config, layout, plan: dict, index: int, attempts: int, labels_only: bool = False) -> tuple[np.ndarray | None, np.ndarray, int, int]:
    """(x, y, rows of train, attempt): the rows of train first.  attempt is the one kept, or -1 where the last one is invalid too."""
    n_train, n_test = split_sizes(config)
    n, sorting = n_train + n_test, config.dataset.task == "classification"
    for attempt in range(attempts):
        seed = attempt_seed(config, index, attempt)
        x, y = make_dataset(config, layout, plan, seed, n, labels_only)
        rng = SeedPath(seed, "split").generator()
        train = stratified_order(y, n_train, rng) if sorting else np.isin(np.arange(n), rng.permutation(n)[:n_train])
        if not sorting or split_is_valid(y[train], y[~train]):
            break
    else:
        attempt = -1
    order = np.concatenate([np.flatnonzero(train), np.flatnonzero(~train)])
    if sorting:
        y = np.unique(y, return_inverse=True)[1].astype(np.float64)
    return None if x is None else x[order], y[order], int(train.sum()), attempt


def attempt_seed(config: Config, index: int, attempt: int) -> int:
    return derive_seed(config.seed, "dataset", index, attempt)


def packed_batch(index: int, x: np.ndarray | None, y: np.ndarray, n_train: int, attempt: int) -> pa.RecordBatch:
    n = len(y)
    if x is None:
        lists = pa.nulls(n, pa.list_(pa.float32()))
    else:
        flat = np.ascontiguousarray(x, dtype=np.float32).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(flat))
    split = pa.DictionaryArray.from_arrays(pa.array((np.arange(n) >= n_train).astype(np.int32)), ["train", "test"]).cast(pa.string())
    row = np.arange(n) - np.where(np.arange(n) >= n_train, n_train, 0)
    cols = [pa.array(np.full(n, index)), split, pa.array(row), lists, pa.array(y.astype(np.float64)), pa.array(np.full(n, attempt, dtype=np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["dataset_index", "split", "row_index", "x", "y", "attempt"])


def generate_corpus(
    spark: SparkSession, config: Config, n_datasets: int, *, attempts: int = 8, labels_only: bool = False, finish: Callable[[int, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata) of a corpus whose datasets share one layout and plan.

    Each dataset is seeded by its index and made whole in one task, so results do not depend on
    partitions; a partition makes a range of indices, one dataset after another in order, and nothing is shuffled.
    A classification dataset whose splits lack classes is made again from another seed, up to ``attempts`` times;
    rows tell the attempt that was kept, -1 if the last one is invalid too.  finish(index, x, y, rows of train) may
    change a dataset before it leaves the task.  metadata is what describe() reads off the rows.
    """
    seeds = SeedPath(config.seed)
    layout = sample_layout(config, seeds)
    plan = sample_plan(config, layout, seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in batch.column(0).to_pylist():
                x, y, n_train, attempt = one_dataset(config, layout, plan, index, attempts, labels_only)
                if finish is not None:
                    x, y = finish(index, x, y, n_train)
                yield packed_batch(index, x, y, n_train, attempt)

    # A range for each core, as datasets of one plan take about the same time, and no more than a shard's worth of datasets in one.
    ranges = min(max(n_datasets, 1), max(spark.sparkContext.defaultParallelism, -(-n_datasets // 128)))
    rows = spark.range(0, n_datasets, 1, ranges).withColumnRenamed("id", "dataset_index").mapInArrow(run, ROWS)
    return rows, describe(rows, config, attempts)


def describe(rows: DataFrame, config: Config, attempts: int = 8) -> DataFrame:
    """One row a dataset of the rows: dataset_index, attempts, valid, seed and dataset_id of the attempt kept, and what the plan fixes for all."""
    seeds = SeedPath(config.seed)
    layout = sample_layout(config, seeds)
    n_train, n_test = split_sizes(config)
    run_id = stable_hash({"config": config.to_dict()})
    group = layout.signature()
    facts = {"kinds": layout.kinds, "n_features": layout.n_features, "n_classes": layout.n_classes, "n_nodes": layout.n_nodes, "edges": layout.edges, "depth": longest_path(list(layout.edges), layout.n_nodes), "shift": vars(shift_params(config)), "noise": config.noise.family, "layout": group, "run": run_id}
    text = json.dumps(facts, sort_keys=True)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, kept = (batch.column(c).to_pylist() for c in (0, 1))
            made = [attempt_seed(config, i, attempts - 1 if a < 0 else a) for i, a in zip(index, kept, strict=True)]
            names = [dataset_id(run_id, group, i, s) for i, s in zip(index, made, strict=True)]
            tries = [attempts if a < 0 else a + 1 for a in kept]
            cols = [batch.column(0), pa.array(tries, pa.int32()), pa.array([a >= 0 for a in kept]), pa.array(made, pa.int64()), pa.array(names), pa.array([text] * len(index))]
            yield pa.RecordBatch.from_arrays(cols, ["dataset_index", "attempts", "valid", "seed", "dataset_id", "metadata"])

    first = rows.where("split = 'train' AND row_index = 0").select("dataset_index", "attempt")
    meta = first.mapInArrow(described, "dataset_index long, attempts int, valid boolean, seed long, dataset_id string, metadata string")
    return meta.withColumn("n_train", F.lit(n_train)).withColumn("n_test", F.lit(n_test))
