"""Coverage of a corpus: summaries, histograms and target bands of metric rows (dataset, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activations import finite_or_null
from .ordering import exact_percentiles


def coverage_summary(metrics: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), *, exact: bool = True) -> DataFrame:
    """(metric, count, missing, mean, std, min, max, q...): non-finite values count as missing; std is the population's."""
    m = metrics.withColumn("value", finite_or_null(F.col("value")))
    v = F.col("value")
    plain = {"count": F.count(v), "missing": F.count(F.when(v.isNull(), 1)), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    if exact:
        out = exact_percentiles(m, {"q": v}, quantiles, ["metric"], plain)
    else:
        out = m.groupBy("metric").agg(*[a.alias(n) for n, a in plain.items()], F.percentile_approx("value", list(quantiles), 10_000).alias("q"))
    names = [f"p{round(100 * x):02d}" for x in quantiles]
    return out.select("metric", "count", "missing", "mean", "std", "min", "max", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def histogram(metrics: DataFrame, bins: int, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(metric, bin, lo, hi, count): equal-width bins over the band of a metric, or its range; the last edge belongs to the last bin.

    A range of one value is widened by a half to each side.  Values outside a band count nowhere; empty bins are rows.
    """
    m = metrics.withColumn("value", finite_or_null(F.col("value"))).where(F.col("value").isNotNull())
    edges = m.groupBy("metric").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    lo, hi = F.col("a"), F.col("b")
    for name, (x, y) in (bands or {}).items():
        lo, hi = F.when(F.col("metric") == name, F.lit(float(x))).otherwise(lo), F.when(F.col("metric") == name, F.lit(float(y))).otherwise(hi)
    flat = lo == hi
    edges = edges.select("metric", F.when(flat, lo - 0.5).otherwise(lo).alias("lo"), F.when(flat, hi + 0.5).otherwise(hi).alias("hi"))
    placed = m.join(edges, "metric").where(F.col("value").between(F.col("lo"), F.col("hi")))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy("metric", at.alias("bin")).agg(F.count("*").alias("count"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["metric", "bin"], "left").select("metric", "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def underrepresented_bins(metrics: DataFrame, bins: int, bands: dict[str, tuple[float, float]], threshold: float) -> DataFrame:
    """(metric, bin, count, in_band, expected, under): bins of a band that hold less than ``threshold`` of an even share."""
    h = histogram(metrics.where(F.col("metric").isin(*bands)), bins, bands)
    total = h.groupBy("metric").agg(F.sum("count").alias("in_band"))
    expected = F.col("in_band") / bins
    return h.join(total, "metric").select("metric", "bin", "count", "in_band", expected.alias("expected"), (F.col("count") < threshold * expected).alias("under"))


def diversity_shift(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """(metric, shift_pct): how far a variant's summary moved, by mean and median on the baseline's scale."""
    b, v = (x.where(F.col("mean").isNotNull() & F.col("p25").isNotNull() & F.col("p50").isNotNull() & F.col("p75").isNotNull()) for x in (baseline, variant))
    b = b.select("metric", F.col("mean").alias("bm"), F.col("p50").alias("b50"), F.greatest(F.abs("mean"), F.col("p75") - F.col("p25"), F.lit(1e-6)).alias("scale"))
    v = v.select("metric", F.col("mean").alias("vm"), F.col("p50").alias("v50"))
    shift = 100 * (0.6 * F.abs(F.col("vm") - F.col("bm")) / F.col("scale") + 0.4 * F.abs(F.col("v50") - F.col("b50")) / F.col("scale"))
    return b.join(v, "metric").select("metric", shift.alias("shift_pct"))


def diversity_status(shifts: DataFrame, warn: float, fail: float) -> DataFrame:
    """(composite, status): the median shift and its place on the ladder."""
    c = F.col("composite")
    return shifts.agg(F.median("shift_pct").alias("composite")).withColumn("status", F.when(c.isNull(), "insufficient_metrics").when(c >= fail, "fail").when(c >= warn, "warn").otherwise("pass"))
