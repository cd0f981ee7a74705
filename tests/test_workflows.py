"""Whole runs from configuration to files."""

import json

import pytest

from quillspan import workflows as w
from quillspan.__main__ import main
from quillspan.operators import gates
from quillspan.plans.config import Config
from quillspan.sources import packed

SMALL = {"seed": 3, "dataset": {"n_train": 96, "n_test": 48, "n_features_min": 6, "n_features_max": 8, "n_classes_max": 4}, "graph": {"n_nodes_max": 6}}


@pytest.fixture
def config_file(tmp_path):
    path = tmp_path / "base.json"
    path.write_text(json.dumps(SMALL))
    return str(path)


def test_generate_writes_what_it_made(spark, tmp_path, config_file):
    out, reports = str(tmp_path / "corpus"), tmp_path / "reports"
    args = ["generate", "--config", config_file, "--out", out, "--num-datasets", "4", "--reports", str(reports), "--set", "dataset.missing_rate=0.2", "--set", "dataset.missing_mechanism=mcar"]
    assert main(args, spark) == 0
    rows = packed.read_packed(spark, out)
    assert rows.count() == 4 * 144
    assert all(r["contiguous"] for r in packed.contiguity(rows, ["dataset_index", "split"], "row_index").collect())
    cells = rows.selectExpr("explode(x) AS v").selectExpr("avg(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS gone").first()["gone"]
    assert abs(cells - 0.2) < 0.03
    record = json.loads((reports / "manifest.json").read_text())
    assert record["datasets"] == 4 and record["config"]["dataset"]["missing_rate"] == 0.2
    assert len(json.loads((reports / "effective_config_trace.json").read_text())["overrides"]) == 2
    found = {r["metric"]: r for r in json.loads((reports / "coverage.json").read_text())["summary"]}
    assert {"spearman_abs_mean", "graph_edge_density", "shift_enabled", "majority_minority_ratio", "n_categorical_features"} <= set(found)
    assert found["shift_enabled"]["max"] == 0 and found["n_rows"]["count"] == 4
    with pytest.raises(Exception, match="exist"):
        main(args, spark)


def test_filter_and_calibration_agree(spark, tmp_path):
    config = Config.from_dict(SMALL)
    corpus = str(tmp_path / "corpus")
    w.run_generate(spark, config, 5, corpus)
    got = w.run_filter(spark, config, corpus, str(tmp_path / "filtered"))
    assert got["datasets"] == 5 and sum(got["reasons"].values()) == 5
    assert spark.read.parquet(str(tmp_path / "filtered/curated/rows")).select("dataset_index").distinct().count() == got["accepted"]
    sweep = w.run_calibration(spark, config, corpus, str(tmp_path / "sweep"), reports=str(tmp_path / "reports"))
    at = {r["threshold"]: r["accepted"] for r in sweep}
    assert at[config.filter.threshold] == got["accepted"]
    assert [at[t] for t in sorted(at)] == sorted(at.values(), reverse=True)


def test_calibration_keeps_the_relaxation_of_many_classes(spark):
    rows = [(0, 0.86, 0.95), (1, 0.86, 0.85), (2, None, 0.95), (3, 0.80, 0.85)]
    verdicts = spark.createDataFrame(rows, "dataset_index long, wins_ratio double, threshold double")
    got = {r["threshold"]: (r["n"], r["accepted"]) for r in gates.calibrate_filter(verdicts, (0.95, 0.85, 0.99), 0.95).collect()}
    assert got == {0.85: (4, 3), 0.95: (4, 1), 0.99: (4, 0)}


def test_audit_and_benchmark_statuses(spark, tmp_path, config_file):
    moved = tmp_path / "moved.json"
    moved.write_text(json.dumps(SMALL | {"dataset": SMALL["dataset"] | {"n_train": 480, "n_features_min": 20, "n_features_max": 20}}))
    base = ["--config", config_file, "--num-datasets", "3"]
    same = tmp_path / "same.json"
    same.write_text(json.dumps(SMALL | {"seed": 9}))
    assert main(["diversity-audit", *base, "--variant", str(same), "--out", str(tmp_path / "a"), "--fail-on-regression"], spark) == 0
    got = w.run_audit(spark, Config.from_dict(SMALL), {"moved": Config.from_dict(json.loads(moved.read_text()))}, 3, str(tmp_path / "b"), warn=0.1, fail=0.2)
    assert got["status"] == "fail"
    held = tmp_path / "held.json"
    held.write_text(json.dumps({"base": {"generation_datasets_per_minute": 1e9}, "other": {"generation_datasets_per_minute": 1.0}}))
    assert main(["benchmark", *base, "--out", str(tmp_path / "c"), "--baseline", str(held), "--fail-on-regression"], spark) == 1
    assert main(["benchmark", *base, "--out", str(tmp_path / "d")], spark) == 0


def test_bad_input_is_refused(spark, tmp_path, config_file):
    assert main(["generate", "--config", str(tmp_path / "none.json"), "--out", "x"], spark) == 2
    assert main(["generate", "--config", config_file, "--out", "x", "--set", "dataset.task=sorting"], spark) == 2
    with pytest.raises(SystemExit):
        main(["generate", "--config", config_file, "--out", "x", "--num-datasets", "0"], spark)
