"""python -m quillspan generate | filter | calibrate | diversity-audit | benchmark"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import workflows
from .plans.config import Config, ConfigError


def load(path: str) -> Config:
    """A configuration from YAML or JSON."""
    return Config.from_dict(json.loads(Path(path).read_text())) if path.endswith(".json") else Config.from_yaml(path)


def override(text: str) -> tuple[str, object]:
    """section.key=value, the value as JSON where it is such, else as text."""
    path, sign, value = text.partition("=")
    if not sign:
        raise argparse.ArgumentTypeError(f"{text!r} is not section.key=value")
    try:
        return path, json.loads(value)
    except ValueError:
        return path, value


def count(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspan")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("generate", "filter", "calibrate", "diversity-audit", "benchmark"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True, action="append" if name == "benchmark" else "store")
        p.add_argument("--out", required=True)
        p.add_argument("--set", type=override, action="append", default=[], metavar="SECTION.KEY=VALUE")
        if name not in ("filter", "calibrate"):
            p.add_argument("--num-datasets", type=count, default=10)
        else:
            p.add_argument("--corpus", required=True)
        if name != "filter":
            p.add_argument("--reports")
        if name in ("diversity-audit", "benchmark"):
            p.add_argument("--warn", type=float, default=10)
            p.add_argument("--fail", type=float, default=25 if name == "diversity-audit" else 20)
            p.add_argument("--fail-on-regression", action="store_true")
        if name == "diversity-audit":
            p.add_argument("--variant", required=True, action="append")
        if name == "benchmark":
            p.add_argument("--baseline")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        changes = ("arguments", dict(a.set))
        configs = {Path(p).stem: workflows.resolve(load(p), changes)[0] for p in (a.config if a.command == "benchmark" else [a.config])}
        variants = {Path(p).stem: load(p) for p in getattr(a, "variant", [])}
    except (ConfigError, OSError) as e:
        print(f"quillspan: {e}", file=sys.stderr)
        return 2
    config = next(iter(configs.values()))
    spark = spark or SparkSession.builder.appName("quillspan").getOrCreate()
    if a.command == "generate":
        got = workflows.run_generate(spark, load(a.config), a.num_datasets, a.out, reports=a.reports, overrides=dict(a.set))
    elif a.command == "filter":
        got = workflows.run_filter(spark, config, a.corpus, a.out)
    elif a.command == "calibrate":
        got = workflows.run_calibration(spark, config, a.corpus, a.out, reports=a.reports)
    elif a.command == "diversity-audit":
        got = workflows.run_audit(spark, config, variants, a.num_datasets, a.out, warn=a.warn, fail=a.fail, reports=a.reports)
    else:
        held = json.loads(Path(a.baseline).read_text()) if a.baseline else None
        got = workflows.run_benchmark(spark, configs, a.num_datasets, a.out, baseline=held, warn=a.warn, fail=a.fail, reports=a.reports)
    print(json.dumps(got, indent=2, default=str))
    return int(getattr(a, "fail_on_regression", False) and got["status"] == "fail")


if __name__ == "__main__":
    sys.exit(main())
