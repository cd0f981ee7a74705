"""Configuration of a corpus: sections with their legal bounds, row specifications, and layered overrides."""

from __future__ import annotations

import copy
import dataclasses
import math
from dataclasses import dataclass, field

import numpy as np

TASKS = ("classification", "regression")
MECHANISMS = ("none", "mcar", "mar", "mnar")
NOISES = ("gaussian", "laplace", "student_t", "mixture")
SUITES = ("smoke", "standard")
SHIFT_MODES = ("off", "graph_drift", "mechanism_drift", "noise_drift", "mixed", "custom")


class ConfigError(ValueError):
    """A value outside its legal range, or an unknown key."""


def closed(value: str, allowed: tuple[str, ...], name: str) -> str:
    clean = str(value).strip().lower()
    if clean not in allowed:
        raise ConfigError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return clean


def within(value: float, low: float, high: float, name: str) -> float:
    if isinstance(value, bool) or not math.isfinite(float(value)) or not low <= float(value) <= high:
        raise ConfigError(f"{name} must lie in [{low}, {high}], not {value!r}")
    return value


@dataclass(frozen=True)
class RowsSpec:
    """Total rows of a dataset: fixed, a range, or a choice; resolved once for a run."""

    mode: str
    values: tuple[int, ...]
    LEAST, MOST = 400, 60_000

    @classmethod
    def parse(cls, value: object) -> RowsSpec | None:
        if value is None:
            return None
        if isinstance(value, RowsSpec):
            return value
        if isinstance(value, dict):
            if set(value) == {"min", "max"}:
                return cls._checked("range", (value["min"], value["max"]))
            if set(value) == {"choices"}:
                return cls._checked("choices", tuple(value["choices"]))
            raise ConfigError(f"rows: unknown keys {sorted(value)}")
        if isinstance(value, (list, tuple)):
            return cls._checked("choices", tuple(value))
        text = str(value).strip()
        if ".." in text:
            return cls._checked("range", tuple(text.split("..", 1)))
        if "," in text:
            return cls._checked("choices", tuple(x for x in text.split(",") if x.strip()))
        return cls._checked("fixed", (text,))

    @classmethod
    def _checked(cls, mode: str, values: tuple) -> RowsSpec:
        try:
            numbers = tuple(int(str(v).strip()) for v in values)
        except ValueError as e:
            raise ConfigError(f"rows: {values!r} are not whole numbers") from e
        for n in numbers:
            within(n, cls.LEAST, cls.MOST, "rows")
        if not numbers or mode == "range" and numbers[0] > numbers[1]:
            raise ConfigError("rows: empty or reversed")
        return cls(mode, numbers)

    def resolve(self, rng: np.random.Generator) -> int:
        if self.mode == "range":
            return int(rng.integers(self.values[0], self.values[1] + 1))
        return int(self.values[rng.integers(len(self.values))])


@dataclass
class Dataset:
    task: str = "classification"
    n_train: int = 768
    n_test: int = 256
    rows: object = None
    n_features_min: int = 16
    n_features_max: int = 64
    categorical_ratio: float | None = None
    categorical_ratio_min: float = 0.0
    categorical_ratio_max: float = 1.0
    max_cardinality: int = 9
    n_classes_min: int = 2
    n_classes_max: int = 10
    missing_rate: float = 0.0
    missing_mechanism: str = "none"
    mar_observed_fraction: float = 0.5
    mar_logit_scale: float = 1.0
    mnar_logit_scale: float = 1.0


@dataclass
class Graph:
    n_nodes_min: int = 2
    n_nodes_max: int = 32


@dataclass
class Mechanism:
    function_family_mix: dict[str, float] | None = None


@dataclass
class Shift:
    mode: str = "off"
    graph_scale: float | None = None
    mechanism_scale: float | None = None
    variance_scale: float | None = None


@dataclass
class Noise:
    family: str = "gaussian"
    scale: float = 1.0
    student_t_df: float = 5.0
    mixture_weights: dict[str, float] | None = None


@dataclass
class Diagnostics:
    histogram_bins: int = 10
    quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)
    target_bands: dict[str, tuple[float, float]] = field(default_factory=dict)
    underrepresented_threshold: float = 0.5


@dataclass
class Filter:
    enabled: bool = False
    n_estimators: int = 25
    max_depth: int = 6
    min_samples_leaf: int = 1
    max_leaf_nodes: int | None = None
    max_features: str | int | float = "auto"
    n_bootstrap: int = 200
    threshold: float = 0.95
    max_attempts: int = 3


@dataclass
class Benchmark:
    suite: str = "standard"
    num_datasets: int = 2000
    warmup_datasets: int = 25
    warn_threshold_pct: float = 10.0
    fail_threshold_pct: float = 20.0
    latency_num_samples: int = 20
    presets: dict[str, dict] = field(default_factory=lambda: {"rows1024": {"rows": 1024}, "rows4096": {"rows": 4096}, "rows8192": {"rows": 8192}})


@dataclass
class Output:
    shard_size: int = 128
    compression: str = "zstd"


@dataclass
class Config:
    seed: int = 1
    dataset: Dataset = field(default_factory=Dataset)
    graph: Graph = field(default_factory=Graph)
    mechanism: Mechanism = field(default_factory=Mechanism)
    shift: Shift = field(default_factory=Shift)
    noise: Noise = field(default_factory=Noise)
    diagnostics: Diagnostics = field(default_factory=Diagnostics)
    filter: Filter = field(default_factory=Filter)
    benchmark: Benchmark = field(default_factory=Benchmark)
    output: Output = field(default_factory=Output)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        if not isinstance(data, dict):
            raise ConfigError("a configuration is a mapping")
        out = cls()
        for key, value in data.items():
            if key not in {f.name for f in dataclasses.fields(cls)}:
                raise ConfigError(f"unknown section {key!r}")
            if key == "seed":
                out.seed = int(value)
                continue
            section = getattr(out, key)
            names = {f.name for f in dataclasses.fields(section)}
            for k, v in (value or {}).items():
                if k not in names:
                    raise ConfigError(f"unknown key {key}.{k}")
                setattr(section, k, v)
        return out.validated()

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def validated(self) -> Config:
        d = self.dataset
        d.task = closed(d.task, TASKS, "dataset.task")
        d.missing_mechanism = closed(d.missing_mechanism, MECHANISMS, "dataset.missing_mechanism")
        d.rows = RowsSpec.parse(d.rows)
        for name in ("categorical_ratio", "categorical_ratio_min", "categorical_ratio_max", "missing_rate", "mar_observed_fraction"):
            if getattr(d, name) is not None:
                within(getattr(d, name), 0, 1, f"dataset.{name}")
        within(d.categorical_ratio_max, d.categorical_ratio_min, 1, "dataset.categorical_ratio_max")
        if d.missing_rate > 0 and d.missing_mechanism == "none":
            raise ConfigError("dataset.missing_rate asks for a mechanism")
        within(d.n_classes_min, 2, 32, "dataset.n_classes_min")
        within(d.n_classes_max, d.n_classes_min, 32, "dataset.n_classes_max")
        within(d.max_cardinality, 2, 10**6, "dataset.max_cardinality")
        within(d.n_features_max, d.n_features_min, 10**6, "dataset.n_features_max")
        within(self.graph.n_nodes_max, max(2, self.graph.n_nodes_min), 10**6, "graph.n_nodes_max")
        if d.task == "classification" and d.rows is None and min(d.n_train, d.n_test) < d.n_classes_max:
            raise ConfigError("each split needs a row for each class")
        self.noise.family = closed(self.noise.family, NOISES, "noise.family")
        if self.noise.student_t_df <= 2:
            raise ConfigError("noise.student_t_df must be over 2")
        self.shift.mode = closed(self.shift.mode, SHIFT_MODES, "shift.mode")
        for name in ("graph_scale", "mechanism_scale", "variance_scale"):
            if getattr(self.shift, name) is not None:
                within(getattr(self.shift, name), 0, 1, f"shift.{name}")
        b, f = self.benchmark, self.filter
        b.suite = closed(b.suite, SUITES, "benchmark.suite")
        within(b.num_datasets, 1, 10**9, "benchmark.num_datasets")
        within(b.warmup_datasets, 0, 10**9, "benchmark.warmup_datasets")
        within(b.warn_threshold_pct, 0, 1e6, "benchmark.warn_threshold_pct")
        within(b.fail_threshold_pct, b.warn_threshold_pct, 1e6, "benchmark.fail_threshold_pct")
        for name in ("n_estimators", "max_depth", "min_samples_leaf", "n_bootstrap", "max_attempts"):
            within(getattr(f, name), 1, 10**6, f"filter.{name}")
        if f.max_leaf_nodes is not None:
            within(f.max_leaf_nodes, 2, 10**6, "filter.max_leaf_nodes")
        within(f.threshold, 0, 1, "filter.threshold")
        if isinstance(f.max_features, str):
            f.max_features = closed(f.max_features, ("auto", "sqrt", "log2"), "filter.max_features")
        within(self.output.shard_size, 1, 10**9, "output.shard_size")
        within(self.diagnostics.histogram_bins, 1, 10**6, "diagnostics.histogram_bins")
        self.diagnostics.quantiles = tuple(sorted({float(q) for q in self.diagnostics.quantiles if 0 <= q <= 1}))
        for k, (lo, hi) in self.diagnostics.target_bands.items():
            if not (math.isfinite(lo) and math.isfinite(hi)):
                raise ConfigError(f"diagnostics.target_bands.{k} must be finite")
            self.diagnostics.target_bands[k] = (min(lo, hi), max(lo, hi))
        return self


def resolve(base: Config, *layers: tuple[str, dict]) -> tuple[Config, list[dict]]:
    """base with layers of dotted overrides, and one event for each value that changed."""
    data, trace = base.to_dict(), []
    data["dataset"]["rows"] = base.dataset.rows
    for source, changes in layers:
        for path, value in changes.items():
            *head, last = path.split(".")
            at = data
            for h in head:
                if h not in at:
                    raise ConfigError(f"unknown key {path}")
                at = at[h]
            if last not in at:
                raise ConfigError(f"unknown key {path}")
            if at[last] != value:
                trace.append({"path": path, "old": at[last], "new": value, "source": source})
                at[last] = value
    return Config.from_dict(data), trace


@dataclass(frozen=True)
class Hardware:
    """What a session offers: task slots, and bytes of memory of an executor."""

    slots: int
    executor_bytes: int

    @classmethod
    def of(cls, spark) -> Hardware:
        conf = spark.sparkContext.getConf()
        text = conf.get("spark.executor.memory", conf.get("spark.driver.memory", "1g")).strip().lower().removesuffix("b")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 1)
        return cls(spark.sparkContext.defaultParallelism, int(float(text.rstrip("kmgt")) * unit))


def fill_slots(config: Config, hardware: Hardware) -> Config:
    """At least as many benchmark datasets as there are task slots, and a shard for each slot where datasets are few."""
    b, o = config.benchmark, config.output
    b.num_datasets = max(b.num_datasets, hardware.slots)
    o.shard_size = max(1, min(o.shard_size, -(-b.num_datasets // max(1, hardware.slots))))
    return config


def fit_memory(config: Config, hardware: Hardware) -> Config:
    """Rows such that a dataset's values, some sixty copies of them in doubles, take no more than a quarter of an executor's memory for each slot."""
    d = config.dataset
    most = max(64, hardware.executor_bytes // 4 // max(1, hardware.slots) // (8 * 60 * max(1, d.n_features_max)))
    total = d.n_train + d.n_test
    if total > most:
        d.n_train, d.n_test = max(1, most * d.n_train // total), max(1, most * d.n_test // total)
    return config


#: Named changes of a configuration by the hardware at hand.
POLICIES: dict = {"none": lambda config, hardware: config, "fill_slots": fill_slots, "fit_memory": fit_memory}


def register_policy(name: str, change, *, overwrite: bool = False) -> None:
    """Adds a policy, a function of a configuration and a Hardware."""
    clean = str(name).strip().lower()
    if not clean or clean in POLICIES and not overwrite:
        raise ConfigError(f"policy {name!r} exists or has no name")
    POLICIES[clean] = change


def apply_policy(name: str, config: Config, hardware: Hardware | None = None) -> Config:
    """The configuration as a policy leaves a copy of it, validated again."""
    clean = str(name).strip().lower()
    if clean not in POLICIES:
        raise ConfigError(f"unknown policy {name!r}")
    made = POLICIES[clean](copy.deepcopy(config), hardware or Hardware(1, 1 << 30))
    if not isinstance(made, Config):
        raise TypeError(f"policy {name!r} made no configuration")
    return made.validated()


#: What the smoke suite caps.
SMOKE = {"num_datasets": 25, "warmup_datasets": 5, "n_train": 256, "n_test": 128, "n_features_max": 24, "n_nodes_max": 16}


def suite_presets(config: Config, suite: str | None = None) -> dict[str, Config]:
    """The configurations of a benchmark suite by preset: its rows, split as the configuration's, capped for smoke."""
    out = {}
    for name, change in sorted(config.benchmark.presets.items()):
        own = copy.deepcopy(config)
        own.benchmark.suite = suite or own.benchmark.suite
        d, b = own.dataset, own.benchmark
        unknown = set(change) - {"rows", "num_datasets", "warmup_datasets"}
        if unknown:
            raise ConfigError(f"benchmark.presets.{name}: unknown keys {sorted(unknown)}")
        b.num_datasets, b.warmup_datasets = change.get("num_datasets", b.num_datasets), change.get("warmup_datasets", b.warmup_datasets)
        if "rows" in change:
            share = d.n_train / (d.n_train + d.n_test)
            d.n_train, d.rows = max(1, round(change["rows"] * share)), None
            d.n_test = change["rows"] - d.n_train
        if b.suite == "smoke":
            b.num_datasets, b.warmup_datasets = min(b.num_datasets, SMOKE["num_datasets"]), min(b.warmup_datasets, SMOKE["warmup_datasets"])
            d.n_train, d.n_test, d.rows = min(d.n_train, SMOKE["n_train"]), min(d.n_test, SMOKE["n_test"]), None
            d.n_features_max = max(d.n_features_min, min(d.n_features_max, SMOKE["n_features_max"]))
            own.graph.n_nodes_max = max(own.graph.n_nodes_min, min(own.graph.n_nodes_max, SMOKE["n_nodes_max"]))
        out[name] = own.validated()
    return out
