"""Gates: learnability thresholds, regressions against a baseline, guardrails, latencies, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exact_percentiles

#: Metrics of which less is better; of all others more is better.
LOWER_IS_BETTER = ("elapsed_seconds", "latency_p95_ms", "peak_rss_mb")


def effective_threshold(requested: Column, n_classes: Column) -> Column:
    """A learnability threshold relaxed for many classes, never under 0.8 unless asked, never over what was asked."""
    relax = F.when(n_classes <= 8, 0.0).when(n_classes <= 16, 0.05).when(n_classes <= 24, 0.10).otherwise(0.15)
    return F.least(requested, F.greatest(requested - relax, F.lit(0.80)))


def degradation(metric: Column, current: Column, baseline: Column) -> Column:
    """Percent by which a metric got worse than its baseline, by the metric's direction; null without a baseline."""
    change = F.when(metric.isin(*LOWER_IS_BETTER), current - baseline).otherwise(baseline - current)
    return F.greatest(F.lit(0.0), F.try_divide(100 * change, F.when(F.abs(baseline) > 0, F.abs(baseline))))


def severity(percent: Column, warn: float, fail: float) -> Column:
    return F.when(percent >= fail, "fail").when(percent >= warn, "warn").otherwise("pass")


def regression_gate(current: DataFrame, baseline: DataFrame, warn: float = 10, fail: float = 20) -> DataFrame:
    """(preset, metric, current, baseline, degradation_pct, severity), the worst first; rows without a baseline are left out."""
    b = baseline.select("preset", "metric", F.col("value").alias("baseline"))
    out = current.select("preset", "metric", F.col("value").alias("current")).join(b, ["preset", "metric"])
    out = out.withColumn("degradation_pct", degradation(F.col("metric"), F.col("current"), F.col("baseline")))
    out = out.withColumn("severity", severity(F.col("degradation_pct"), warn, fail))
    order = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return out.orderBy(order, F.desc("degradation_pct"), "preset", "metric")


def gate_status(issues: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    return issues.agg(F.coalesce(rank, F.lit(0)).alias("r"), F.count("*").alias("n_compared")).select("n_compared", F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), (F.col("r") + 1).cast("int")).alias("status"))


def missingness_guardrail(cells: DataFrame, target: float, group: list[str], warn: float = 0.03, fail: float = 0.05) -> DataFrame:
    """(group, n_cells, n_missing, realized, gap, status) of long-form values, NaN being missing."""
    gone = F.sum(F.when(F.isnan("value"), 1).otherwise(0)).alias("n_missing")
    out = cells.groupBy(*group).agg(F.count("*").alias("n_cells"), gone).withColumn("realized", F.col("n_missing") / F.col("n_cells"))
    return out.withColumn("gap", F.abs(F.col("realized") - target)).withColumn("status", severity(F.col("gap"), warn, fail))


def shift_guardrail(means: DataFrame, axes: list[str], least: int = 5) -> DataFrame:
    """(axis, control, shifted, n, status) of rows (variant 'control' or 'shifted', one column for each axis): every axis must rise."""
    long = means.unpivot(["variant"], axes, "axis", "value")
    side = lambda v: F.avg(F.when(F.col("variant") == v, F.col("value")))
    out = long.groupBy("axis").agg(side("control").alias("control"), side("shifted").alias("shifted"), F.count(F.when(F.col("variant") == "shifted", F.col("value"))).alias("n"))
    return out.withColumn("status", F.when(F.col("n") < least, "insufficient").when(F.col("shifted") > F.col("control"), "pass").otherwise("fail"))


def reason_counts(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): the first check that holds for each row, 'accepted' where none does."""
    reason = F.lit("accepted")
    for name, holds in reversed(checks):
        reason = F.when(holds, name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def attempt_pressure(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group, datasets, attempts, retries, retry_rate) of rows with their number of attempts."""
    out = runs.groupBy(*group).agg(F.count("*").alias("datasets"), F.sum("attempts").alias("attempts"))
    return out.withColumn("retries", F.col("attempts") - F.col("datasets")).withColumn("retry_rate", F.col("retries") / F.col("attempts"))


def latency_summary(df: DataFrame, seconds: str, group: list[str]) -> DataFrame:
    """(group, mean_ms, p95_ms, min_ms, max_ms); the percentile is exact, in bounded memory."""
    ms = F.col(seconds) * 1000
    out = exact_percentiles(df, {"q": ms}, (0.95,), group, {"mean_ms": F.avg(ms), "min_ms": F.min(ms), "max_ms": F.max(ms)})
    return out.select(*group, "mean_ms", F.col("q")[0].alias("p95_ms"), "min_ms", "max_ms")


def best_candidate(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group, best): the name with the greatest value, the lesser name on a tie, a missing value being worst."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value), name)
    return df.withColumn("place", F.row_number().over(w)).where("place = 1").select(*group, F.col(name).alias("best"), value)


def digest(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, n, digest): a digest of a group's rows that does not depend on their order.

    Row hashes are added up in two halves of their md5, so that nothing is collected or sorted.  What order rows have is
    told by a column that numbers them, which is to be among the columns.
    """
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    part = lambda i: F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.md5(F.concat_ws("|", part(1).cast("string"), part(9).cast("string"))).alias("digest"))


#: Families of noise that a mixture draws from.
NOISE_PARTS = ("gaussian", "laplace", "student_t")


def noise_reason(expected: str) -> Column:
    """Why a dataset's noise metadata is not valid: the first rule it breaks, null if none.

    Columns: family_requested, family_sampled, sampling_strategy (strings), base_scale, student_t_df (doubles),
    mixture_weights (map of doubles).  Null stands for a value of the wrong type.
    """
    low = lambda c: F.lower(F.trim(c))
    number = lambda c, bound: c.isNull() | F.isnan(c) | (c == float("inf")) | (c <= bound)
    asked, got, weights = low(F.col("family_requested")), low(F.col("family_sampled")), F.col("mixture_weights")
    parts = F.map_values(weights)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    # The names of the reasons are fixed values.
    rules = [
        ("family_requested_type", asked.isNull()),
        ("family_requested_mismatch", asked != expected),
        ("family_sampled_type", got.isNull()),
        ("sampling_strategy_type", F.col("sampling_strategy").isNull()),
        ("sampling_strategy_value", low(F.col("sampling_strategy")) != "dataset_level"),
        ("base_scale_value", number(F.col("base_scale"), 0.0)),
        ("student_t_df_value", number(F.col("student_t_df"), 2.0)),
    ]
    if expected == "mixture":
        rules += [
            ("family_sampled_invalid_for_mixture", ~got.isin(*NOISE_PARTS)),
            ("mixture_weights_type", weights.isNull()),
            ("mixture_weights_key_value", F.exists(F.map_keys(weights), lambda k: ~low(k).isin(*NOISE_PARTS))),
            ("mixture_weights_value", F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))),
            ("mixture_weights_total_nonpositive", total <= 0),
            ("mixture_weights_total_not_one", F.abs(total - 1) > 1e-6),
        ]
    else:
        rules += [("family_sampled_mismatch", got != expected), ("mixture_weights_unexpected", weights.isNotNull())]
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def noise_guardrail(meta: DataFrame, expected: str, group: list[str]) -> DataFrame:
    """(group, n, n_present, n_valid, coverage, validity, status) of rows as noise_reason takes them, with present (boolean)."""
    ok = F.col("present") & noise_reason(expected).isNull()
    out = meta.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("present").alias("n_present"), F.count_if(ok).alias("n_valid"))
    out = out.withColumn("coverage", F.col("n_present") / F.col("n")).withColumn("validity", F.col("n_valid") / F.col("n"))
    return out.withColumn("status", F.when(F.col("n_valid") == F.col("n"), "pass").otherwise("fail"))


def lineage_guardrail(trials: DataFrame, group: list[str], least: int, warn: float = 10, fail: float = 20) -> DataFrame:
    """(group, sample, coverage, baseline, current, degradation_pct, status) of paired trials.

    Rows: kind ('baseline' or 'lineage'), per_minute, has_lineage (boolean).  Medians of finite throughputs are compared; under
    ``least`` rows only missing lineage fails.
    """
    ours = F.col("kind") == "lineage"
    finite = F.when(~F.isnan("per_minute") & (F.abs("per_minute") < float("inf")), F.col("per_minute"))
    share = F.count_if(ours & F.col("has_lineage")) / F.nullif(F.count_if(ours), F.lit(0))
    out = trials.groupBy(*group).agg(F.count_if(ours).alias("sample"), share.alias("coverage"), F.coalesce(F.median(F.when(~ours, finite)), F.lit(0.0)).alias("baseline"), F.coalesce(F.median(F.when(ours, finite)), F.lit(0.0)).alias("current"))
    out = out.withColumn("degradation_pct", degradation(F.lit("datasets_per_minute"), F.col("current"), F.col("baseline")))
    slow = F.when(F.col("sample") >= least, severity(F.col("degradation_pct"), warn, fail)).otherwise("pass")
    return out.withColumn("status", F.when(F.col("coverage") < 1, "fail").otherwise(slow))


def sweep_best(df: DataFrame, group: list[str], cells: str, rate: str) -> DataFrame:
    """(group, best, rate): the setting of the greatest rate, the smaller one on a tie; missing rates are worst. One aggregation."""
    score = F.struct(F.coalesce(rate, F.lit(float("-inf"))), -F.col(cells))
    return df.groupBy(*group).agg(F.max_by(cells, score).alias("best"), F.max(rate).alias(rate))


def issue_ranks(issues: DataFrame) -> DataFrame:
    """Issues with place: from the most severe, then the most degraded; the issues of one run are few."""
    order = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return issues.withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("degradation_pct"), "preset", "metric")))


def filter_yield(verdicts: DataFrame, group: list[str], means: list[str]) -> DataFrame:
    """(group, attempts, accepted, rejected, accepted_fraction, a mean of each measure over its finite values)."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    out = verdicts.groupBy(*group).agg(F.count("*").alias("attempts"), F.count_if("accepted").alias("accepted"), *[F.avg(finite(c)).alias(f"{c}_mean") for c in means])
    return out.withColumn("rejected", F.col("attempts") - F.col("accepted")).withColumn("accepted_fraction", F.col("accepted") / F.col("attempts"))


def calibrate_filter(verdicts: DataFrame, requested: tuple[float, ...], judged_at: float, elapsed: float | None = None) -> DataFrame:
    """(threshold, n, accepted, acceptance_rate, accepted_per_minute) of verdicts judged once, at each requested threshold.

    A dataset's own relaxation (``judged_at``, the threshold configured, less its own) is kept in a sweep; a verdict
    without a wins ratio is never accepted.  accepted_per_minute is null without elapsed seconds.
    """
    t = F.explode(F.array(*map(F.lit, sorted(set(requested))))).alias("t")
    each = verdicts.select("wins_ratio", (F.lit(judged_at) - F.col("threshold")).alias("relax"), t)
    limit = F.least("t", F.greatest(F.round(F.col("t") - F.col("relax"), 9), F.lit(0.80)))
    ok = F.coalesce(F.col("wins_ratio") >= limit, F.lit(False))
    out = each.groupBy(F.col("t").alias("threshold")).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("accepted"))
    rate = F.col("accepted") * 60 / F.lit(elapsed) if elapsed else F.lit(None).cast("double")
    return out.withColumn("acceptance_rate", F.col("accepted") / F.col("n")).withColumn("accepted_per_minute", rate)
