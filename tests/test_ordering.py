"""Exact order statistics and places, range by range, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import metrics, ordering, postprocess


@pytest.fixture(scope="module")
def awkward():
    """Groups of all sizes: ties, nulls, one value, none, and a long tail."""
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "mostly_one": np.where(rng.random(2500) < 0.97, 7.0, rng.normal(size=2500)), "tail": np.exp(6 * rng.normal(size=2200)),
        "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "flat": np.full(400, -2.0), "few": rng.normal(size=37), None: rng.normal(size=300).round(1),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)] * 3 + [("normal", None)] * 20
    return groups, rows


@pytest.mark.parametrize("accuracy", [10_000, 200])
def test_exact_percentiles(spark, monkeypatch, awkward, accuracy):
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)  # groups beyond it are bracketed by sketches
    groups, rows = awkward
    df = spark.createDataFrame(rows, "g string, v double").repartition(7).withColumn("w", -F.col("v"))
    q = (0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0)
    got = {r["g"]: r for r in ordering.exact_percentiles(df, {"v": F.col("v"), "w": F.col("w")}, q, ["g"]).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["v"] == [None] * 7
    for g, v in groups.items():
        np.testing.assert_allclose(got[g]["v"], np.quantile(v, q), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(got[g]["w"], np.quantile(-v, q), rtol=1e-12, atol=1e-12)
    whole = ordering.exact_percentiles(df, {"v": F.col("v")}, q, []).first()["v"]
    np.testing.assert_allclose(whole, np.quantile(np.concatenate(list(groups.values())), q), rtol=1e-12)
    assert ordering.exact_percentiles(df.limit(0), {"v": F.col("v")}, q, ["g"]).count() == 0


def test_places_and_ranks(spark, awkward):
    groups, rows = awkward
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "i long, g string, v double").repartition(5)
    got = postprocess.keyed_permutation(df, 3, "i", group=["g"]).select("i", "g", "position", postprocess.uniform(3, "permutation", "i").alias("u")).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r)
    for rs in by.values():
        assert [r["position"] for r in sorted(rs, key=lambda r: (r["u"], r["i"]))] == list(range(len(rs)))
    ranks = {(r["g"], r["i"]): r["v"] for r in metrics.average_ranks(df.where("v IS NOT NULL"), ["v"], ["g"]).collect()}
    at = 0
    for g, vs in groups.items():
        order = np.argsort(vs, kind="stable")
        want = np.empty(len(vs))
        want[order] = np.arange(1, len(vs) + 1)
        for x in np.unique(vs):
            want[vs == x] = want[vs == x].mean()
        assert [ranks[g, at + k] for k in range(len(vs))] == want.tolist()
        at += len(vs)


def test_no_task_sees_a_whole_group(spark):
    """The windows that remain are over ranges of a group, or over one row a range."""
    df = spark.range(100).withColumn("g", F.lit(1))
    plan = postprocess.keyed_permutation(df, 1, "id", group=["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("part#" in line for line in windows)
