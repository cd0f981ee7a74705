"""Draws that share latent parameters, noise metadata, and reshapes on awkward rows."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions.rng import SeedPath, student_t
from quillspan.operators import gates, postprocess, reshape
from quillspan.plans.sampling import CorrelatedSampler


def test_correlated_draws_repeat_and_stay_within_bounds():
    def draws():
        s = CorrelatedSampler(SeedPath(3))
        return [s.number("a", 1, 100, log=True) for _ in range(50)], [s.category("k", 4) for _ in range(50)]

    numbers, codes = draws()
    assert (numbers, codes) == draws()
    assert all(1 <= x <= 100 for x in numbers) and len(set(numbers)) > 1
    assert set(codes) <= {0, 1, 2, 3}
    assert isinstance(CorrelatedSampler(SeedPath(3)).number("b", 2, 9, whole=True), int)


def test_names_do_not_disturb_each_other():
    a, b = CorrelatedSampler(SeedPath(3)), CorrelatedSampler(SeedPath(3))
    b.number("other", 0, 1)
    assert a.number("x", 0, 1) == b.number("x", 0, 1)


def test_student_t_needs_a_finite_variance():
    with pytest.raises(ValueError):
        student_t(1, "t", 2, "id")


def test_noise_reasons(spark):
    schema = "family_requested string, family_sampled string, sampling_strategy string, base_scale double, student_t_df double, mixture_weights map<string,double>"
    good = ("gaussian", "Gaussian ", "dataset_level", 1.0, 5.0, None)
    rows = [good, (None, *good[1:]), ("laplace", *good[1:]), (*good[:3], float("nan"), *good[4:]), (*good[:2], "cell", *good[3:]), ("gaussian", "laplace", *good[2:]), (*good[:5], {"gaussian": 1.0})]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(gates.noise_reason("gaussian")).collect()]
    assert got == [None, "family_requested_type", "family_requested_mismatch", "base_scale_value", "sampling_strategy_value", "family_sampled_mismatch", "mixture_weights_unexpected"]


def test_runs_and_one_hot_take_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (2, 1, None)], "p int, i int, v string")
    got = reshape.group_starts(rows, ["p"], ["i"], "v").orderBy("p", "i").collect()
    assert [(r.starts, r.run) for r in got] == [(True, 1), (False, 1), (True, 2), (False, 2), (True, 1)]
    assert [list(r[0]) for r in rows.orderBy("p", "i").select(reshape.one_hot(F.col("v"), ["a", "b"])).limit(3).collect()] == [[1, 0], [1, 0], [0, 0]]


def test_random_activation_of_a_constant_and_of_nothing(spark):
    rows = spark.createDataFrame([(i, 5.0) for i in range(4)], "id int, y double")
    out = postprocess.random_activation(rows, "y", F.tanh, 1, "id")
    assert [r.y for r in out.collect()] == [0.0] * 4
    assert postprocess.random_activation(rows.where("id < 0"), "y", F.tanh, 1, "id").count() == 0


def test_depths_of_several_graphs(spark):
    from quillspan.operators import graphs

    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(3)], "g int, n int")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2)], "g int, src int, dst int")
    got = graphs.depths(edges, nodes, "n", ["g"]).orderBy("g", "node").collect()
    assert [r.depth for r in got] == [1, 2, 3, 1, 1, 1]
