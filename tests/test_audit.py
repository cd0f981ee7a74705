import hashlib
import json

from pyspark.sql import functions as F

from quillspan.operators import audit, generate, graphs, metrics
from quillspan.plans.config import Config
from quillspan.plans.sampling import longest_path
from quillspan.sources import reports


def test_audit_and_report(spark, tmp_path):
    base = spark.range(20).select(F.col("id").alias("ds"), F.lit("m").alias("metric"), (F.col("id") + 1.0).alias("value"))
    shifts, status = audit.diversity_audit(base, {"same": base, "far": base.withColumn("value", F.col("value") * 3)}, 5, 50)
    got = {r["variant"]: (r["composite"], r["status"]) for r in status.collect()}
    assert got["same"] == (0.0, "pass") and got["far"][1] == "fail"
    reports.write_report("Audit", {"shifts": (shifts, ["variant", "metric"]), "status": (status, ["variant"])}, str(tmp_path / "audit"))
    assert len(json.loads((tmp_path / "audit.json").read_text())["shifts"]) == 2
    assert "far" in (tmp_path / "audit.md").read_text()


def test_lineage_round_trip(spark):
    config = Config.from_dict({"seed": 3, "dataset": {"n_train": 96, "n_test": 48, "n_classes_max": 4}, "graph": {"n_nodes_max": 9}})
    _, meta = generate.generate_corpus(spark, config, 5)
    rows = audit.lineage(meta, 2).orderBy("dataset_index").collect()
    facts = json.loads(meta.first()["metadata"])
    end = {}
    for r in rows:
        a = graphs.unpack_upper(bytes(r["payload"]), r["n_nodes"])
        assert sorted(map(list, zip(*a.nonzero(), strict=True))) == sorted(facts["edges"])
        assert r["sha256"] == hashlib.sha256(bytes(r["payload"])).hexdigest()
        assert r["offset"] == end.get(r["shard"], 0)
        end[r["shard"]] = r["offset"] + r["size"]
    assert longest_path([tuple(e) for e in facts["edges"]], facts["n_nodes"]) == facts["depth"]


def test_profile_feeds_the_audit(spark):
    config = Config.from_dict({"seed": 3, "dataset": {"n_train": 96, "n_test": 48, "n_classes_max": 4}, "graph": {"n_nodes_max": 6}})
    rows, _ = generate.generate_corpus(spark, config, 6)
    profile = metrics.profile_datasets(rows, "classification", 1)
    shifts, _ = audit.diversity_audit(profile, {"self": profile}, 5, 50)
    assert all(r["shift_pct"] == 0 for r in shifts.collect())
