"""Whole runs over a corpus: generate, filter, calibrate a filter, audit variants, and benchmark presets.

Tables go to ``out``, a path that all executors share; reports are small and go to a folder of the driver.
Each stage reads what the one before has written, so that nothing is generated twice.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import SeedPath
from .operators import audit, coverage, extra_trees, gates, metrics, postprocess
from .operators.generate import describe, generate_corpus
from .plans.config import Config, Hardware, apply_policy, resolve, suite_presets
from .plans.sampling import edge_density, sample_layout, shift_facts, stable_hash
from .sources import lineage, packed
from .sources.reports import rows_of, write_report

#: Thresholds tried by calibration beside the configured one.
THRESHOLDS = (0.80, 0.85, 0.90, 0.95, 0.99)


def corpus_rows(spark: SparkSession, config: Config, n_datasets: int, on_dataset: Callable | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows of a corpus after clipping, scaling and hiding of values, all in the task that makes a dataset; and what makes metadata of them once written.

    on_dataset(index, x, y, rows of train) is called with each finished dataset in its task, and may return it changed as (x, y).
    """
    d = config.dataset
    kinds = sample_layout(config, SeedPath(config.seed)).kinds
    scale = d.mnar_logit_scale if d.missing_mechanism == "mnar" else d.mar_logit_scale
    hides = d.missing_mechanism != "none" and d.missing_rate > 0
    seed, task, attempts = config.seed, d.task, config.filter.max_attempts

    def finish(index, x, y, n_train):
        x, y = postprocess.finish_dataset(x, y, n_train, kinds, task)
        if hides:
            x = postprocess.hide_cells(x, n_train, index, d.missing_mechanism, d.missing_rate, seed, observed=d.mar_observed_fraction, scale=scale)
        return (on_dataset and on_dataset(index, x, y, n_train)) or (x, y)

    rows, _ = generate_corpus(spark, config, n_datasets, attempts=attempts, finish=finish)
    return rows, lambda written: describe(written, config, attempts)


def corpus_metrics(rows: DataFrame, config: Config, *, spearman: bool = True, forest: bool = False) -> DataFrame:
    """(dataset_index, metric, value): the profile of each dataset and what the plan fixes for all of them."""
    layout = sample_layout(config, SeedPath(config.seed))
    own = metrics.profile_datasets(rows, config.dataset.task, config.seed, kinds=layout.kinds, spearman=spearman, forest=forest)
    shared = shift_facts(config) | {"graph_edge_density": edge_density(len(layout.edges), layout.n_nodes)}
    pairs = F.explode(F.create_map(*(F.lit(x) for pair in shared.items() for x in pair))).alias("metric", "value")
    return own.unionByName(rows.select("dataset_index").distinct().select("dataset_index", pairs))


def run_generate(spark: SparkSession, config: Config, n_datasets: int, out: str, *, reports: str | None = None, overrides: dict | None = None) -> dict:
    """Writes a corpus under out; with reports also its configuration, the trace of overrides, coverage and a manifest."""
    config, trace = resolve(config, ("arguments", overrides or {}))
    began = time.perf_counter()
    rows, meta = corpus_rows(spark, config, n_datasets)
    packed.write_packed(rows, meta, out, shard_size=config.output.shard_size, compression=config.output.compression, in_ranges=True)
    elapsed = time.perf_counter() - began
    written = packed.read_packed(spark, out)
    run = sample_layout(config, SeedPath(config.seed)).signature()
    record = packed.manifest(written, run=run, config=config.to_dict(), elapsed=elapsed)
    if reports:
        g = config.diagnostics
        profile = corpus_metrics(written, config).cache()
        sections = {"summary": (coverage.coverage_summary(profile, g.quantiles), ["metric"]), "histogram": (coverage.histogram(profile, g.histogram_bins, g.target_bands), ["metric", "bin"])}
        if g.target_bands:
            sections["underrepresented"] = (coverage.underrepresented_bins(profile, g.histogram_bins, g.target_bands, g.underrepresented_threshold), ["metric", "bin"])
        os.makedirs(reports, exist_ok=True)
        write_report("Coverage", sections, f"{reports}/coverage")
        profile.unpersist()
        packed.write_json(config.to_dict(), f"{reports}/effective_config.json")
        packed.write_json({"overrides": trace}, f"{reports}/effective_config_trace.json")
        packed.write_json(record, f"{reports}/manifest.json")
        lineage.write_blobs(meta(written), out, shard_size=config.output.shard_size)
        groups = {"run": stable_hash({"config": config.to_dict()}), "layout": run, "request": stable_hash({"config": config.to_dict(), "datasets": n_datasets})}
        payload = packed.handoff(spark, out, record, groups=groups, hardware=asdict(Hardware.of(spark)), sections=("rows", "metadata", "lineage/blobs", "lineage/index"))
        packed.write_json(payload, f"{reports}/handoff_manifest.json")
    return record


def judge_corpus(rows: DataFrame, config: Config) -> DataFrame:
    f = config.filter
    return extra_trees.filter_datasets(rows, config.dataset.task, config.seed, trees=f.n_estimators, depth=f.max_depth, bootstraps=f.n_bootstrap, threshold=f.threshold, leaf=f.min_samples_leaf, leaves=f.max_leaf_nodes, max_features=f.max_features)


def run_filter(spark: SparkSession, config: Config, corpus: str, out: str) -> dict:
    """Judges each dataset of a written corpus; verdicts and the rows of those accepted go under out.  Returns counts by reason."""
    rows = packed.read_packed(spark, corpus)
    packed.write_records(judge_corpus(rows, config), f"{out}/verdicts")
    verdicts = packed.read_records(spark, f"{out}/verdicts", extra_trees.VERDICT)
    kept = extra_trees.curate(rows, verdicts).repartition("shard", "split").sortWithinPartitions("shard", "split", "dataset_index", "row_index")
    kept.write.mode("errorifexists").option("compression", config.output.compression).partitionBy("shard", "split").parquet(f"{out}/curated/rows")
    counts = {r["reason"]: r["count"] for r in verdicts.groupBy("reason").count().collect()}
    total, accepted = sum(counts.values()), counts.get("accepted", 0)
    return {"datasets": total, "accepted": accepted, "acceptance_rate": accepted / total if total else None, "reasons": dict(sorted(counts.items()))}


def run_calibration(spark: SparkSession, config: Config, corpus: str, out: str, *, thresholds: tuple[float, ...] = THRESHOLDS, reports: str | None = None) -> list[dict]:
    """Judges a written corpus once and sweeps thresholds over its verdicts."""
    began = time.perf_counter()
    packed.write_records(judge_corpus(packed.read_packed(spark, corpus), config), f"{out}/verdicts")
    verdicts = packed.read_records(spark, f"{out}/verdicts", extra_trees.VERDICT)
    sweep = gates.calibrate_filter(verdicts, (*thresholds, config.filter.threshold), config.filter.threshold, time.perf_counter() - began)
    if reports:
        os.makedirs(reports, exist_ok=True)
        return write_report("Filter calibration", {"sweep": (sweep, ["threshold"])}, f"{reports}/calibration")["sweep"]
    return rows_of(sweep, ["threshold"])


def run_audit(spark: SparkSession, baseline: Config, variants: dict[str, Config], n_datasets: int, out: str, *, warn: float = 10, fail: float = 25, reports: str | None = None) -> dict:
    """Corpora of the baseline and of each variant, made from the baseline's seed, and how far the variants moved; status is the worst."""
    profiles = {}
    for name, config in {"baseline": baseline, **variants}.items():
        config, _ = resolve(config, ("audit", {"seed": baseline.seed}))
        rows, meta = corpus_rows(spark, config, n_datasets)
        packed.write_packed(rows, meta, f"{out}/{name}", shard_size=config.output.shard_size, compression=config.output.compression, in_ranges=True)
        rows = packed.read_packed(spark, f"{out}/{name}")
        if config.filter.enabled:
            rows = extra_trees.curate(rows, judge_corpus(rows, config))
        corpus_metrics(rows, config).write.parquet(f"{out}/{name}/profile")
        profiles[name] = spark.read.parquet(f"{out}/{name}/profile")
    shifts, status = audit.diversity_audit(profiles.pop("baseline"), profiles, warn, fail)
    if reports:
        os.makedirs(reports, exist_ok=True)
        got = write_report("Diversity audit", {"shifts": (shifts, ["variant", "metric"]), "status": (status, ["variant"])}, f"{reports}/audit")
    else:
        got = {"status": rows_of(status, ["variant"])}
    found = {r["status"] for r in got["status"]}
    return {"variants": got["status"], "status": next((s for s in ("fail", "insufficient_metrics", "warn") if s in found), "pass")}


def baseline_of(found: list[tuple[str, str, float]]) -> dict:
    """What a later benchmark is gated against: {preset: {metric: value}}, as run_benchmark reads it."""
    out: dict[str, dict[str, float]] = {}
    for preset, metric, value in sorted(found):
        out.setdefault(preset, {})[metric] = float(value)
    return out


def run_suite(spark: SparkSession, config: Config, out: str, *, suite: str | None = None, policy: str = "none", after: Callable[[Config], Config] | None = None, **options) -> dict:
    """run_benchmark over the presets of a suite, each changed by a hardware policy, and then by ``after``; thresholds are the configuration's."""
    presets = {n: apply_policy(policy, c, Hardware.of(spark)) for n, c in suite_presets(config, suite).items()}
    presets = {n: after(c).validated() for n, c in presets.items()} if after else presets
    n = max(c.benchmark.num_datasets for c in presets.values())
    return run_benchmark(spark, presets, n, out, warn=config.benchmark.warn_threshold_pct, fail=config.benchmark.fail_threshold_pct, **options)


def run_benchmark(spark: SparkSession, presets: dict[str, Config], n_datasets: int, out: str, *, baseline: dict[str, dict[str, float]] | None = None, warn: float = 10, fail: float = 20, reports: str | None = None) -> dict:
    """Times generation, writing and filtering of each preset and gates the rates against baseline ({preset: {metric: value}})."""
    found = []
    for name, config in presets.items():
        clock = [time.perf_counter()]
        rows, meta = corpus_rows(spark, config, n_datasets)
        rows.write.format("noop").mode("overwrite").save()
        clock.append(time.perf_counter())
        packed.write_packed(rows, meta, f"{out}/{name}", shard_size=config.output.shard_size, compression=config.output.compression, in_ranges=True)
        clock.append(time.perf_counter())
        judge_corpus(packed.read_packed(spark, f"{out}/{name}"), config).write.format("noop").mode("overwrite").save()
        clock.append(time.perf_counter())
        # The write makes its rows anew, so its own share is what it takes beyond making them.
        made, wrote, judged = (b - a for a, b in zip(clock, clock[1:], strict=False))
        for metric, seconds in (("generation_datasets_per_minute", made), ("generate_and_write_datasets_per_minute", wrote), ("filter_datasets_per_minute", judged)):
            found.append((name, metric, 60 * n_datasets / seconds))
    current = spark.createDataFrame(found, "preset string, metric string, value double")
    held = [(p, m, float(v)) for p, values in (baseline or {}).items() for m, v in values.items()]
    issues = gates.regression_gate(current, spark.createDataFrame(held, "preset string, metric string, value double"), warn, fail)
    if reports:
        os.makedirs(reports, exist_ok=True)
        write_report("Benchmark", {"rates": (current, ["preset", "metric"]), "gate": (issues, ["preset", "metric"])}, f"{reports}/benchmark")
    if reports:
        packed.write_json(baseline_of(found), f"{reports}/baseline.json")
    rates: dict[str, dict[str, float]] = reduce(lambda a, r: a | {r[0]: a.get(r[0], {}) | {r[1]: r[2]}}, found, {})
    return {"rates": rates, "status": gates.gate_status(issues).first()["status"]}
