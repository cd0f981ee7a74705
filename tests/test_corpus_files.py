"""Lineage files, shard and schema checks, hand-off records, forest options, suites and policies."""

import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import workflows as w
from quillspan.operators import extra_trees, generate, metrics
from quillspan.plans import config as c
from quillspan.plans.config import Config, ConfigError, Hardware
from quillspan.plans.sampling import sample_layout
from quillspan.functions.rng import SeedPath
from quillspan.sources import lineage, packed

SMALL = {"seed": 3, "dataset": {"n_train": 96, "n_test": 48, "n_features_min": 6, "n_features_max": 8, "n_classes_max": 4}, "graph": {"n_nodes_max": 6}}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    config = Config.from_dict(SMALL | {"output": {"shard_size": 4}})
    w.run_generate(spark, config, 10, str(root / "corpus"), reports=str(root / "reports"))
    return root, config


def test_lineage_files_read_back(spark, corpus):
    root, config = corpus
    path, layout = str(root / "corpus"), sample_layout(config, SeedPath(3))
    held = lineage.read_payloads(spark, path).collect()
    assert len(held) == 10 and all(r["intact"] for r in held)
    edges = {}
    for r in lineage.read_edges(spark, path).collect():
        edges.setdefault(r["dataset_index"], set()).add((r["src"], r["dst"]))
    assert edges == {i: set(layout.edges) for i in range(10)} or not layout.edges
    records = lineage.compact_records(spark, path, list(layout.feature_nodes), layout.target_node)
    assert records.where(lineage.problem(F.col("record")).isNotNull()).count() == 0
    damaged = spark.read.parquet(f"{path}/lineage/blobs").withColumn("blob", F.reverse(F.hex("blob")).cast("binary"))
    damaged.write.parquet(str(root / "bad/lineage/blobs"))
    spark.read.schema(lineage.INDEX).json(f"{path}/lineage/index").write.json(str(root / "bad/lineage/index"))
    with pytest.raises(Exception, match="damaged"):
        lineage.read_edges(spark, str(root / "bad")).collect()


def test_dense_records(spark):
    good = {"schema_name": lineage.SCHEMA_NAME, "schema_version": lineage.DENSE, "graph": {"n_nodes": 3, "adjacency": [[0, 1, 1], [0, 0, 0], [0, 0, 0]], "edge_count": None, "adjacency_ref": None}, "assignments": {"feature_to_node": [0, 2], "target_to_node": 1}}

    def bad(path, value):
        out = copy.deepcopy(good)
        *head, last = path
        at = out
        for k in head:
            at = at[k]
        at[last] = value
        return out

    cases = [
        (good, None), (bad(["schema_name"], None), "schema_name"), (bad(["schema_version"], "9"), "schema_version"), (bad(["graph"], None), "graph"), (bad(["graph", "n_nodes"], 1), "graph.n_nodes"), (bad(["graph", "adjacency"], [[0, 1], [0, 0]]), "graph.adjacency"),
        (bad(["graph", "adjacency"], [[0, 1, 1], [0, 0], [0, 0, 0]]), "graph.adjacency"), (bad(["graph", "adjacency", 0], [0, 2, 1]), "graph.adjacency.value"), (bad(["graph", "adjacency", 1], [1, 0, 0]), "graph.adjacency.triangle"), (bad(["graph", "adjacency", 1], [0, 1, 0]), "graph.adjacency.triangle"),
        (bad(["assignments"], None), "assignments"), (bad(["assignments", "feature_to_node"], [0, 3]), "assignments.feature_to_node"), (bad(["assignments", "target_to_node"], None), "assignments.target_to_node"), (bad(["schema_version"], lineage.COMPACT), "graph.adjacency"),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], f"i int, record struct<{lineage.RECORD.replace(' string', ':string', 2).replace('graph struct', 'graph:struct').replace('assignments struct', 'assignments:struct')}>")
    got = {r["i"]: r["p"] for r in df.select("i", lineage.problem(F.col("record")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [p for _, p in cases]


def test_shards_are_found_and_checked(spark, corpus, tmp_path):
    root, _ = corpus
    path = str(root / "corpus")
    assert packed.find_shards(spark, path) == [0, 1, 2] and packed.check_packed(spark, path).count() == 1440
    with pytest.raises(ValueError, match="no shards"):
        packed.find_shards(spark, str(tmp_path / "none"))
    rows = packed.read_packed(spark, path)
    rows.where("split = 'train'").write.partitionBy("shard", "split").parquet(str(tmp_path / "half/rows"))
    with pytest.raises(ValueError, match="shard 0 holds"):
        packed.find_shards(spark, str(tmp_path / "half"))
    rows.where("NOT (dataset_index = 5 AND row_index = 7)").write.partitionBy("shard", "split").parquet(str(tmp_path / "gap/rows"))
    with pytest.raises(ValueError, match="contiguous.*5"):
        packed.check_packed(spark, str(tmp_path / "gap"))
    rows.withColumn("other", F.lit(1)).write.partitionBy("shard", "split").parquet(str(tmp_path / "odd/rows"))
    (tmp_path / "odd/rows/else=1").mkdir()
    with pytest.raises(ValueError, match="no shard"):
        packed.find_shards(spark, str(tmp_path / "odd"))
    need = {"dataset_index": "bigint", "x": "array<float>", "y": "int", "lost": "string"}
    assert packed.schema_problems(rows.select("dataset_index", "x", "y", "split"), need, {}) == ["lost: missing", "y: double, not int", "split: unknown"]


def test_handoff_holds_until_something_changes(spark, corpus):
    root, config = corpus
    payload = json.loads((root / "reports/handoff_manifest.json").read_text())
    assert set(payload["artifacts"]) == {"rows", "metadata", "lineage/blobs", "lineage/index"} and payload["corpus"]["datasets"] == 10
    assert all(a["files"] > 0 and a["bytes"] > 0 and not a["path"].startswith("/") for a in payload["artifacts"].values())
    assert packed.check_handoff(spark, str(root / "corpus"), payload) == []
    wrong = copy.deepcopy(payload)
    wrong["artifacts"]["rows"]["checksum"] = "0" * 32
    assert packed.check_handoff(spark, str(root / "corpus"), wrong) == ["artifacts.rows.checksum"]
    del wrong["identity"]
    assert packed.check_handoff(spark, str(root / "corpus"), wrong) == ["identity"]


def test_forest_options():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 1))

    def leaves(tree, at):
        if not isinstance(tree, list):
            return [len(at)]
        left = x[at, tree[0]] <= tree[1]
        return leaves(tree[2], at[left]) + leaves(tree[3], at[~left])

    for most in (2, 5, 9):
        got = leaves(extra_trees.grow(x, y, np.random.default_rng(1), 10, 4, 1, most), np.arange(200))
        assert len(got) == most and sum(got) == 200
    for leaf in (1, 10, 40):
        assert min(leaves(extra_trees.grow(x, y, np.random.default_rng(1), 10, 4, leaf), np.arange(200))) >= leaf
        assert min(leaves(extra_trees.grow(x, y, np.random.default_rng(1), 10, 4, leaf, 6), np.arange(200))) >= leaf
    assert [extra_trees.features_tried(s, 16, True) for s in ("auto", "sqrt", "log2", 3, 0.5, 99)] == [4, 4, 4, 3, 8, 16] and extra_trees.features_tried("auto", 16, False) == 16
    with pytest.raises(ValueError):
        extra_trees.features_tried("most", 4, True)
    z = rng.standard_normal((400, 5))
    assert extra_trees.judge(z, (z[:, 0] > 0).astype(float), "classification", np.random.default_rng(1), leaf=3, leaves=20, max_features=0.8)["accepted"]


def test_metrics_by_name(spark, corpus):
    rows = packed.read_packed(spark, str(corpus[0] / "corpus")).where("dataset_index < 2")
    only = frozenset({"snr_proxy_db", "n_classes", "spearman_abs_max"})
    some = metrics.profile_datasets(rows, "classification", 1, only=only).collect()
    whole = {(r["dataset_index"], r["metric"]): r["value"] for r in metrics.profile_datasets(rows, "classification", 1, spearman=True).collect()}
    assert {r["metric"] for r in some} == only and all(whole[r["dataset_index"], r["metric"]] == r["value"] for r in some)
    with pytest.raises(ValueError):
        metrics.profile_datasets(rows, "classification", 1, only=frozenset({"charm"}))
    with pytest.raises(Exception, match="widths"):
        metrics.profile_datasets(rows.withColumn("x", F.when(F.col("row_index") == 3, F.slice("x", 1, 2)).otherwise(F.col("x"))), "classification", 1).collect()


def test_categorical_share_lies_between_its_bounds():
    for seed in range(30):
        config = Config.from_dict({"seed": seed, "dataset": {"n_features_min": 40, "n_features_max": 40, "categorical_ratio_min": 0.2, "categorical_ratio_max": 0.4}, "graph": {"n_nodes_max": 4}})
        assert 8 <= sample_layout(config, SeedPath(seed)).kinds.count("cat") <= 16
    fixed = Config.from_dict({"dataset": {"n_features_min": 40, "n_features_max": 40, "categorical_ratio": 0.5}})
    assert sample_layout(fixed, SeedPath(1)).kinds.count("cat") == 20
    for wrong in ({"categorical_ratio_min": 0.5, "categorical_ratio_max": 0.4}, {"missing_rate": 0.1}):
        with pytest.raises(ConfigError):
            Config.from_dict({"dataset": wrong})
    for wrong in ({"benchmark": {"suite": "long"}}, {"benchmark": {"warn_threshold_pct": 30}}, {"filter": {"max_leaf_nodes": 1}}, {"filter": {"max_features": "many"}}, {"output": {"shard_size": 0}}):
        with pytest.raises(ConfigError):
            Config.from_dict(wrong)


def test_suites_and_policies(spark, tmp_path):
    config = Config.from_dict(SMALL | {"benchmark": {"presets": {"a": {"rows": 1000, "num_datasets": 3}, "b": {"rows": 300}}}})
    plain, smoke = c.suite_presets(config), c.suite_presets(config, "smoke")
    assert (plain["a"].dataset.n_train, plain["a"].dataset.n_test) == (667, 333) and plain["b"].benchmark.num_datasets == 2000
    assert (smoke["a"].dataset.n_train, smoke["a"].dataset.n_test, smoke["b"].benchmark.num_datasets) == (256, 128, 25) and config.dataset.n_train == 96
    with pytest.raises(ConfigError):
        c.suite_presets(Config.from_dict({"benchmark": {"presets": {"a": {"speed": 1}}}}))
    hardware = Hardware(8, 1 << 30)
    assert c.apply_policy("fill_slots", Config.from_dict({"benchmark": {"num_datasets": 4}}), hardware).benchmark.num_datasets == 8
    tight = c.apply_policy(" Fit_Memory", Config.from_dict({"dataset": {"n_train": 60_000, "n_test": 20_000}}), Hardware(8, 1 << 28))
    assert tight.dataset.n_train < 1000 and Hardware.of(spark).slots == spark.sparkContext.defaultParallelism
    with pytest.raises(ConfigError):
        c.register_policy("none", lambda config, hardware: config)
    c.register_policy("mine", lambda config, hardware: None, overwrite=True)
    with pytest.raises(TypeError):
        c.apply_policy("mine", config)
    seen = w.run_suite(spark, Config.from_dict(SMALL | {"benchmark": {"num_datasets": 2, "presets": {"a": {"num_datasets": 2}}}}), str(tmp_path / "out"), suite="smoke", reports=str(tmp_path / "reports"), after=lambda config: config)
    held = json.loads((tmp_path / "reports/baseline.json").read_text())
    assert set(held) == {"a"} and held["a"] == seen["rates"]["a"] and seen["status"] == "pass"


def test_each_finished_dataset_is_shown(spark):
    config = Config.from_dict(SMALL)
    rows, _ = w.corpus_rows(spark, config, 2, on_dataset=lambda index, x, y, n_train: (x * 0 + index, y) if index else None)
    got = rows.groupBy("dataset_index").agg(F.max(F.array_max("x")).alias("hi"), F.min(F.array_min("x")).alias("lo")).collect()
    assert {r["dataset_index"]: (r["lo"], r["hi"]) for r in got}[1] == (1, 1) and all(r["hi"] > r["lo"] for r in got if r["dataset_index"] == 0)
    assert generate.ROWS.endswith("attempt int")
