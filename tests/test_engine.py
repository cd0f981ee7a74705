"""Known answers and invariants of the engine's own parts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import kernels as K
from quillspan.functions.rng import SeedPath, derive_seed, normalize_weights, sample_noise, uniform
from quillspan.operators import coverage, extra_trees, gates, generate, graphs, metrics, postprocess
from quillspan.plans.config import Config, ConfigError, RowsSpec, resolve
from quillspan.plans.sampling import edge_density, family_probabilities, longest_path, sample_dag, sample_layout, shift_params
from quillspan.sources import packed
from quillspan.streaming.coverage import run_to_parquet, windowed_coverage


def small(task="classification", **more):
    return Config.from_dict({"seed": 3, "dataset": {"task": task, "n_train": 96, "n_test": 48, "n_features_min": 5, "n_features_max": 8, "n_classes_max": 4} | more, "graph": {"n_nodes_max": 6}})


def test_seeds_follow_the_hash_and_siblings_are_apart():
    want = int.from_bytes(hashlib.blake2s(b"7|a|1", digest_size=8).digest(), "little") % (2**32 - 1)
    assert derive_seed(7, "a", 1) == want
    p = SeedPath(7)
    assert (p / "a").seed != (p / "b").seed
    assert (p / "a").generator().random() == (p / "a").generator().random()


def test_uniform_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    got = [sorted(df.repartition(n).select("id", uniform(1, "x", "id")).collect()) for n in (1, 4, 40)]
    assert got[0] == got[1] == got[2]
    u = [r[1] for r in got[0]]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05


def test_weights_and_noise():
    assert normalize_weights({"a": 3, "b": 1, "c": 0}) == {"a": 0.75, "b": 0.25}
    with pytest.raises(ValueError):
        normalize_weights({"a": 0})
    rng = np.random.default_rng(0)
    for f in ("gaussian", "laplace", "student_t", "mixture"):
        assert abs(np.median(sample_noise(rng, (4000,), f))) < 0.1
    with pytest.raises(ValueError):
        sample_noise(rng, (3,), "student_t", df=2)


def test_matrices_have_unit_rows():
    rng = np.random.default_rng(1)
    for kind in K.MATRICES:
        np.testing.assert_allclose(np.linalg.norm(K.random_matrix(rng, 5, 7, kind), axis=1), 1, atol=1e-9)


@pytest.mark.parametrize("family", K.FAMILIES)
def test_families_are_finite_and_seeded(family):
    x = np.random.default_rng(2).standard_normal((64, 6))
    a, b = (K.apply_family(np.random.default_rng(5), family, x, 3) for _ in range(2))
    assert a.shape == (64, 3) and np.isfinite(a).all()
    np.testing.assert_array_equal(a, b)


def test_lp_blocks_equal_dense():
    rng = np.random.default_rng(3)
    x, c = rng.standard_normal((20, 4)), rng.standard_normal((70, 4))
    np.testing.assert_allclose(K.lp_distances(x, c, 1.3), (np.abs(x[:, None] - c[None]) ** 1.3).sum(axis=2))


def test_rows_spec():
    assert RowsSpec.parse("1024").mode == "fixed"
    assert RowsSpec.parse("500..900").values == (500, 900)
    assert RowsSpec.parse("500,900").mode == "choices"
    assert RowsSpec.parse({"min": 500, "max": 900}).mode == "range"
    assert 500 <= RowsSpec.parse("500..900").resolve(np.random.default_rng(0)) <= 900
    for bad in ("10", "900..500", "abc", {"x": 1}):
        with pytest.raises(ConfigError):
            RowsSpec.parse(bad)


def test_config_bounds_and_trace(tmp_path):
    for bad in ({"dataset": {"missing_rate": 2}}, {"dataset": {"task": "x"}}, {"nope": {}}, {"noise": {"student_t_df": 2}}, {"shift": {"graph_scale": 3}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad)
    out, trace = resolve(Config(), ("cli", {"seed": 9, "dataset.n_train": 500}), ("cap", {"dataset.n_train": 500}))
    assert out.seed == 9 and [t["path"] for t in trace] == ["seed", "dataset.n_train"]
    (tmp_path / "c.yaml").write_text("seed: 4\ndataset:\n  task: regression\n")
    assert Config.from_yaml(str(tmp_path / "c.yaml")).dataset.task == "regression"


def test_shift_and_families():
    assert shift_params(Config()).sigma_multiplier == 1
    c = Config.from_dict({"shift": {"mode": "noise_drift", "variance_scale": 1.0}})
    assert shift_params(c).sigma_multiplier == pytest.approx(2**0.5)
    p = family_probabilities()
    assert "piecewise" not in p and len(set(round(x, 12) for x in p.values())) == 1
    assert family_probabilities(1.0)["nn"] > family_probabilities(1.0)["linear"]


def test_graphs(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert longest_path(edges, 4) == 4 and edge_density(4, 4) == pytest.approx(4 / 6)
    assert all(s < t for s, t in sample_dag(np.random.default_rng(0), 12))
    e = spark.createDataFrame(edges, "src int, dst int")
    assert graphs.depths(e, spark.range(4), "id").agg(F.max("depth")).first()[0] == 4
    a = np.zeros((4, 4), bool)
    for s, t in [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]:
        a[s, t] = True
    blob = graphs.pack_upper(a)
    assert len(blob) == 1
    np.testing.assert_array_equal(graphs.unpack_upper(blob, 4), a)
    with pytest.raises(ValueError):
        graphs.unpack_upper(blob + b"x", 4)


def test_generation_round_trip(spark, tmp_path):
    config = small()
    rows, meta = generate.generate_corpus(spark, config, 4)
    rows = rows.cache()
    per = {r["dataset_index"]: r for r in rows.groupBy("dataset_index").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).collect()}
    assert len(per) == 4 and all(r["n"] == 144 and r["lo"] == r["hi"] for r in per.values())
    again = generate.generate_corpus(spark.newSession(), config, 4)[0].repartition(7)
    digest = lambda df: sorted(map(tuple, gates.digest(df, ["split", "row_index", "x", "y"], ["dataset_index"]).collect()))
    assert digest(rows) == digest(again)
    packed.write_packed(rows, meta, str(tmp_path / "c"), shard_size=2)
    back = packed.read_packed(spark, str(tmp_path / "c"))
    assert digest(back) == digest(rows)
    assert back.select("shard").distinct().count() == 2
    assert packed.contiguity(back, ["dataset_index", "split"], "row_index").where("NOT contiguous").count() == 0
    assert packed.ragged(back).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        packed.write_packed(rows, meta, str(tmp_path / "c"))
    got = packed.read_records(spark, str(tmp_path / "c/metadata"), "dataset_index long, dataset_id string, n_train int")
    assert got.count() == 4
    m = packed.manifest(rows, run="r", config=config.to_dict(), elapsed=2.0)
    assert m["datasets"] == 4 and m["rows"] == 576
    rows.unpersist()


def test_regression_corpus_postprocess(spark):
    config = small("regression")
    rows, _ = generate.generate_corpus(spark, config, 2)
    kinds = sample_layout(config, SeedPath(config.seed)).kinds
    out = postprocess.postprocess_corpus(rows, kinds, "regression").groupBy("dataset_index").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).collect()
    for r in out:
        assert abs(r["m"]) < 1e-6 and (abs(r["s"] - 1) < 1e-6 or r["s"] < 1e-6)


def test_stratified_order_is_exact():
    rng = np.random.default_rng(0)
    y = np.array([0] * 50 + [1] * 30 + [2] * 3 + [3])
    for n in (20, 42, 60):
        take = generate.stratified_order(y, n, rng)
        assert take.sum() == n
        assert all(0 < take[y == k].sum() < (y == k).sum() for k in (0, 1, 2))


@pytest.mark.parametrize("mechanism", ["mcar", "mar", "mnar"])
def test_missingness_rates(mechanism):
    x = np.random.default_rng(0).standard_normal((2000, 6))
    make = lambda s: postprocess.missing_mask(x, mechanism, 0.25, np.random.default_rng(s))
    assert abs(make(1).mean() - 0.25) < 0.03
    np.testing.assert_array_equal(make(1), make(1))
    assert postprocess.missing_mask(x, mechanism, 1.0, np.random.default_rng(0)).all()


def test_constant_columns_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert postprocess.drop_constant_columns(df, ["a", "b"]).columns == ["a"]
    with pytest.raises(ValueError):
        postprocess.drop_constant_columns(df, ["b"])
    out, order = postprocess.permute_columns(df, ["a", "b"], 1)
    assert [["a", "b"][i] for i in order] == out.columns


def test_coverage_known_answers(spark):
    m = spark.createDataFrame([(i, "p", v) for i, v in enumerate([0.1, 0.3, 0.7, 0.9, None])], "ds long, metric string, value double")
    s = coverage.coverage_summary(m).first()
    assert (s["count"], s["missing"], s["min"], s["max"]) == (4, 1, 0.1, 0.9)
    h = coverage.histogram(m, 4, {"p": (0.0, 1.0)}).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 1, 1]
    flat = spark.createDataFrame([(0, "p", 2.0)], "ds long, metric string, value double")
    assert sum(r["count"] for r in coverage.histogram(flat, 3).collect()) == 1


def test_gates(spark):
    cur = spark.createDataFrame([("a", "datasets_per_minute", 85.0), ("b", "datasets_per_minute", 70.0), ("c", "datasets_per_minute", 1.0)], "preset string, metric string, value double")
    base = spark.createDataFrame([("a", "datasets_per_minute", 100.0), ("b", "datasets_per_minute", 100.0)], "preset string, metric string, value double")
    out = gates.regression_gate(cur, base).collect()
    assert [(r["preset"], r["severity"]) for r in out] == [("b", "fail"), ("a", "warn")]
    assert gates.gate_status(gates.regression_gate(cur, base)).first()["status"] == "fail"
    assert [extra_trees.threshold_for(0.95, k) for k in (8, 16, 24, 32)] == pytest.approx([0.95, 0.9, 0.85, 0.8])
    assert extra_trees.threshold_for(0.5, 32) == 0.5


def test_extra_trees_tell_signal_from_noise():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    good = extra_trees.judge(x, (x[:, 0] > 0).astype(float), "classification", np.random.default_rng(1))
    noise = extra_trees.judge(x, rng.standard_normal(400), "regression", np.random.default_rng(1))
    assert good["accepted"] and not noise["accepted"]
    assert extra_trees.judge(x[:20], x[:20, 0], "regression", np.random.default_rng(1))["reason"] == "insufficient_oob"
    assert good == extra_trees.judge(x, (x[:, 0] > 0).astype(float), "classification", np.random.default_rng(1))


def test_curation_and_match(spark):
    rows = spark.range(4).withColumnRenamed("id", "dataset_index")
    verdicts = spark.createDataFrame([(0, True), (1, False), (2, True)], "dataset_index long, accepted boolean")
    assert sorted(r[0] for r in extra_trees.curate(rows, verdicts).collect()) == [0, 2]
    with pytest.raises(ValueError):
        packed.require_match(rows, verdicts, "dataset_index")
    packed.require_match(rows, rows, "dataset_index")


def test_json_is_put_in_place(tmp_path):
    path = str(tmp_path / "m.json")
    packed.write_json({"a": 1}, path)
    with pytest.raises(FileExistsError):
        packed.write_json({"a": 2}, path)
    assert [p.name for p in tmp_path.iterdir()] == ["m.json"]


def test_ridge_and_proxies():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3))
    y = (x @ [1.0, -2.0, 0.5] + 3)[:, None]
    np.testing.assert_allclose(metrics.ridge(x, y, x), y, atol=1e-5)
    assert metrics.linearity_proxy(x[:200], y[:200], x[200:], y[200:], rng) == 1.0
    assert metrics.snr_proxy_db(x, y, x, y) > 50


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    run_to_parquet(windowed_coverage(stream, "ts", "event_type", "value", window="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    done = spark.read.parquet(str(tmp_path / "out"))
    whole = windowed_coverage(batch, "ts", "event_type", "value", window="1 day").select("window_start", "metric", "count")
    got = {(r[0], r[1]): r[2] for r in done.select("window_start", "metric", "count").collect()}
    want = {(r[0], r[1]): r[2] for r in whole.collect()}
    assert got and all(want[k] == n for k, n in got.items())
