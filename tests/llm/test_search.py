"""Exact search: repeated queries, huge components, trees of shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import topk
from quillspan.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>"


def floors(v):
    return [max(topk.LEAST, min(topk.MOST, int(np.floor(256 * float(np.float32(x)))))) for x in v]


def brute(rows, k=5):
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in rows if i % 50 == 0}):
        q = floors(v)
        scores = [(-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(q, floors(w), strict=True)))), j) for j, w in rows if j != i and len(w) == len(v)]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [16384, 30])
def test_repeated_queries_have_ranks_of_their_own(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(101)]
    rows += [(50, rows[50][1])] * 2 + [(0, [3.0, -1.0, 2.0]), (100, [1.0, 1.0]), (7, [2.0, 0.5]), (7, rows[7][1])]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("shard", [16384, 3])
def test_huge_components_are_held_at_the_range(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rows = [(0, [3e30, 1.0]), (1, [3e30, -3e30]), (2, [-3e30, 0.0]), (3, [1e15, 5.0]), (4, [0.5, -1e17]), (50, [1.0, 2.0]), (6, [2e9, 2e9]), (100, [-1e15, 1e12])]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_each_tree_is_built_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    made = []
    keep = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df: made.append(keep(df)) or made[-1])
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(200)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    trees = [df for df in made if "tree" in df.columns]
    assert len(trees) == 1 and trees[0].count() == trees[0].select("shard").distinct().count() == 10
