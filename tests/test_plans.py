"""Typed plans: what datasets of a layout share, attempts in metadata, finishing, digests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import draws
from quillspan.functions import kernels as K
from quillspan.functions.rng import SeedPath
from quillspan.operators import generate, postprocess
from quillspan.plans.config import Config
from quillspan.plans.sampling import family_probabilities, gp_variant_counts, plan_family_counts, plan_rows, sample_layout, sample_plan
from quillspan.sources import packed


def small(**more):
    return Config.from_dict({"seed": 3, "dataset": {"n_train": 96, "n_test": 48, "n_features_min": 6, "n_features_max": 8, "n_classes_max": 4} | more, "graph": {"n_nodes_max": 6}})


def plan_of(config):
    return sample_plan(config, sample_layout(config, SeedPath(config.seed)), SeedPath(config.seed))


def test_plans_are_json_and_repeat():
    config = small()
    plan = plan_of(config)
    assert json.loads(json.dumps(plan)) == plan == plan_of(config)
    assert all(len(n["functions"]) == (len(n["parents"]) if n["source"] == "stacked" else 1) and (n["base"] in draws.ROOTS) == (n["source"] == "root") for n in plan["nodes"])
    for n in plan["nodes"]:
        for c in n["converters"]:
            pair = (c["plan"].get("method"), c["plan"].get("variant"))
            assert pair in draws.CONVERTERS if c["cardinality"] else set(c["plan"]) == {"warp"}


def test_every_family_follows_its_plan(monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 5))
    for family in draws.FAMILIES:
        for seed in range(12):
            plan = draws.function_plan(np.random.default_rng(seed), family, 3)
            got = [K.apply_family(np.random.default_rng(k), family, x, 3, plan=json.loads(json.dumps(plan))) for k in (1, 1, 2)]
            assert got[0].shape == (60, 3) and np.isfinite(got[0]).all()
            np.testing.assert_array_equal(got[0], got[1])
            assert not np.array_equal(got[0], got[2]) or family in ("em",)
    # Two datasets of one plan use matrices of the same kinds, in the same order, and trees of the same depths.
    seen = []
    real = K.random_matrix
    monkeypatch.setattr(K, "random_matrix", lambda rng, rows, cols, plan=None: seen[-1].append((rows, cols, json.dumps(plan))) or real(rng, rows, cols, plan))
    config = small()
    layout, plan = sample_layout(config, SeedPath(3)), plan_of(config)
    for index in (0, 1):
        seen.append([])
        generate.one_dataset(config, layout, plan, index, 1)
    assert seen[0] == seen[1] and seen[0]


def test_families_nest_only_where_they_may():
    rng = np.random.default_rng(0)
    odds = family_probabilities(0.0, {"product": 1, "piecewise": 1})
    nodes = [{"functions": [draws.function_plan(rng, draws.draw_family(rng, odds), 2) for _ in range(60)], "converters": [{"plan": draws.converter_plan(rng, 5, 2, odds)} for _ in range(60)]}]
    rows = plan_rows({"nodes": nodes})
    assert {f for f, _, d in rows if d == 0} == {"product", "piecewise"} and {f for f, _, d in rows if d > 1} <= set(draws.INNER)
    counts = plan_family_counts({"nodes": nodes})
    assert sum(counts.values()) == len(rows) and counts["gp"] == sum(gp_variant_counts({"nodes": nodes}).values())
    assert set(gp_variant_counts({"nodes": nodes})) == set(draws.GP_VARIANTS)
    assert {(c["plan"]["method"], c["plan"]["variant"]) for c in nodes[0]["converters"]} == set(draws.CONVERTERS)


@pytest.mark.parametrize("method,variant", draws.CONVERTERS)
def test_categorical_converters(method, variant):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    plan = {"method": method, "variant": variant, "function": draws.function_plan(rng, "linear", 4)}
    label, latent = K.categorical_converter(rng, x, 5, plan)
    assert label.min() >= 0 and label.max() < 5 and latent.shape == x.shape
    if variant == "input":
        np.testing.assert_array_equal(latent, x)
    else:  # the latent is a function of the label
        assert all(len(np.unique(latent[label == k].round(9), axis=0)) == 1 for k in np.unique(label))
    if variant == "index_repeat":
        np.testing.assert_array_equal(latent, np.repeat(label[:, None], 4, axis=1))
    with pytest.raises(ValueError):
        draws.converter_plan(rng, 5, 2, {"linear": 1.0}, method="other")


def test_metadata_names_the_attempt_that_was_kept(spark, monkeypatch):
    config = small()
    layout, plan = sample_layout(config, SeedPath(3)), plan_of(config)
    rows, meta = generate.generate_corpus(spark, config, 3)
    kept = {r["dataset_index"]: r for r in meta.collect()}
    for i in range(3):
        *_, attempt = generate.one_dataset(config, layout, plan, i, 8)
        assert kept[i]["valid"] == (attempt >= 0) and kept[i]["attempts"] == (8 if attempt < 0 else attempt + 1)
        assert kept[i]["seed"] == generate.attempt_seed(config, i, kept[i]["attempts"] - 1)
    # Attempts that fail: the third is the first that is valid; with two allowed the dataset is marked.
    tries = []
    monkeypatch.setattr(generate, "split_is_valid", lambda a, b: tries.append(1) or len(tries) == 3)
    assert generate.one_dataset(config, layout, plan, 0, 8)[3] == 2
    tries.clear()
    assert generate.one_dataset(config, layout, plan, 0, 2)[3] == -1
    made = generate.describe(spark.createDataFrame([(0, "train", 0, [1.0], 0.0, 2), (1, "train", 0, [1.0], 0.0, -1)], generate.ROWS), config).orderBy("dataset_index").collect()
    assert [(r["attempts"], r["valid"], r["seed"]) for r in made] == [(3, True, generate.attempt_seed(config, 0, 2)), (8, False, generate.attempt_seed(config, 1, 7))]
    assert len({r["dataset_id"] for r in made}) == 2


def test_finishing_in_the_task_equals_finishing_after(spark):
    config = small(missing_rate=0.3, missing_mechanism="mar")
    from quillspan import workflows as w

    one, _ = w.corpus_rows(spark, config, 2)
    raw, _ = generate.generate_corpus(spark, config, 2)
    kinds = sample_layout(config, SeedPath(3)).kinds
    two = postprocess.inject_missing(postprocess.postprocess_corpus(raw, kinds, "classification"), "mar", 0.3, 3, observed=config.dataset.mar_observed_fraction, scale=config.dataset.mar_logit_scale)
    key = lambda df: sorted((r["dataset_index"], r["split"], r["row_index"], np.array(r["x"]).tobytes(), r["y"]) for r in df.collect())
    assert key(one) == key(two)


def test_finish_draws_columns_and_labels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4)).astype(np.float32)
    x[:, 2] = 3
    y = np.array([0, 1, 2, 3, 4] * 10, dtype=float)
    got, code = postprocess.finish_dataset(x, y, 30, ("num", "num", "cat", "num"), "classification", rng=np.random.default_rng(1))
    assert got.shape == (50, 3) and sorted(np.unique(code)) == [0, 1, 2, 3, 4] and len(set(zip(y, code))) == 5
    assert (code != y).any()
    _, code = postprocess.finish_dataset(x, np.r_[np.zeros(30), np.arange(20) % 3], 30, ("num",) * 4, "classification", rng=np.random.default_rng(1))
    assert code.tolist() == np.r_[np.zeros(30), np.arange(20) % 3].tolist()  # train holds one class
    same, _ = postprocess.finish_dataset(np.ones((5, 2), np.float32), np.zeros(5), 3, ("cat", "cat"), "regression", rng=np.random.default_rng(1))
    assert same.shape == (5, 2)  # all are constant, all stay


def test_digest_sees_features_and_files_are_ordered(spark, tmp_path):
    config = small()
    rows, meta = generate.generate_corpus(spark, config, 40)
    rows = rows.persist()
    other = rows.withColumn("x", F.transform("x", lambda v: -v))
    of = lambda df: packed.manifest(df, run="r", config={}, elapsed=1.0)["digest"]
    assert of(rows) == of(rows.repartition(5)) != of(other)
    for name, in_ranges in (("a", True), ("b", False)):
        packed.write_packed(rows, meta, str(tmp_path / name), shard_size=32, in_ranges=in_ranges)
        back = packed.read_packed(spark, str(tmp_path / name))
        assert of(back) == of(rows)
        files = back.select("shard", "split", "dataset_index", "row_index", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
        by = {}
        for r in files:
            by.setdefault(r["f"], []).append((r["shard"], r["split"], r["dataset_index"], r["row_index"]))
        held = [d for rs in by.values() for d in {(r[1], r[2]) for r in rs}]
        assert len(held) == len(set(held)) == 80 and all(rs == sorted(rs) and len({r[:2] for r in rs}) == 1 for rs in by.values()) and len(by) >= 4
    rows.unpersist()
