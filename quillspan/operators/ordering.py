"""Order statistics, places and running sums of groups of any size, without a task that sees a whole group.

A group is cut into ranges of its values; ranges are summed up first, which leaves a few rows a group, and
each range is then worked on by itself from where those before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketches is one by this; groups of up to so many values are gathered as they are.
ACCURACY = 10_000
#: Ranges that a group is cut into.
RANGES = 64


def join_groups(df: DataFrame, stats: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """df with the columns of a table of its groups; nulls are a group. Spark picks how; without a group stats is one row."""
    if not group:
        return df.crossJoin(F.broadcast(stats))  # one row
    right = stats.select(*[F.col(g).alias(f"g#{g}") for g in group], *[c for c in stats.columns if c not in group])
    return df.join(right, [df[g].eqNullSafe(right[f"g#{g}"]) for g in group], how).drop(*[f"g#{g}" for g in group])


def exact_percentiles(df: DataFrame, values: dict[str, Column], quantiles: tuple[float, ...], group: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """(group, name: array of quantiles) of each named value: exact, interpolated linearly, nulls left out.

    ``more`` are further aggregates by name, made in the same look at the rows.  Two aggregations of bounded memory.  Sketches bracket each quantile between two values of the group; then
    values under the bracket are counted, and only those strictly inside, some thousandths of a percent of the group,
    are gathered and sorted.
    """
    margin = 3 / ACCURACY
    near = [min(1.0, max(0.0, q + side * margin)) for q in quantiles for side in (-1, 1)]
    more = more or {}
    named = df.select(*group, *[v.alias(name) for name, v in values.items()])
    bounds = df.groupBy(*group).agg(*[a.alias(f"m#{c}") for c, a in more.items()], *[x for name, v in values.items() for x in (F.count(v).alias(f"n#{name}"), F.min(v).alias(f"a#{name}"), F.max(v).alias(f"b#{name}"), F.percentile_approx(v, near, ACCURACY).alias(f"s#{name}"))])
    values = {name: F.col(name) for name in values}
    ends: dict[tuple[str, int], tuple[Column, Column]] = {}
    for name in values:
        few = F.col(f"n#{name}") <= ACCURACY
        for i in range(len(quantiles)):
            ends[name, i] = tuple(F.when(few, F.col(f"{end}#{name}")).otherwise(F.col(f"s#{name}")[2 * i + k]) for k, end in ((0, "a"), (1, "b")))
    joined = join_groups(named, bounds, group)
    aggs = []
    for (name, i), (lo, hi) in ends.items():
        v = values[name]
        aggs += [F.count_if(v < lo).alias(f"lt#{name}#{i}"), F.count_if(v == lo).alias(f"eq#{name}#{i}"), F.array_sort(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"in#{name}#{i}"), F.first(lo).alias(f"lo#{name}#{i}"), F.first(hi).alias(f"hi#{name}#{i}")]
    aggs += [F.first(f"n#{name}").alias(f"n#{name}") for name in values] + [F.first(f"m#{c}").alias(f"m#{c}") for c in more]
    found = joined.groupBy(*group).agg(*aggs)

    def at(name: str, i: int, k: Column) -> Column:
        before = F.col(f"lt#{name}#{i}") + F.col(f"eq#{name}#{i}")
        inside = F.col(f"in#{name}#{i}")
        return F.when(k < before, F.col(f"lo#{name}#{i}")).when(k < before + F.size(inside), F.get(inside, (k - before).cast("int"))).otherwise(F.col(f"hi#{name}#{i}")).cast("double")

    out = []
    for name in values:
        each = []
        for i, q in enumerate(quantiles):
            place = F.lit(float(q)) * (F.col(f"n#{name}") - 1)
            low = F.floor(place)
            a, b = at(name, i, low), at(name, i, F.ceil(place))
            each.append(F.when(F.col(f"n#{name}") > 0, a + (place - low) * (b - a)))
        out.append(F.array(*each).alias(name))
    return found.select(*group, *[F.col(f"m#{c}").alias(c) for c in more], *out)


def _offsets(sizes: DataFrame, group: list[str], part: str, n: str, out: str) -> DataFrame:
    """(group, part, out): the sum of n over the parts before; a group has RANGES parts or so."""
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, part, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(out))


def places(df: DataFrame, draw: Column, ties: list[str], group: list[str], out: str = "position") -> DataFrame:
    """df with each row's place, from 0, in its group in order of a draw from [0, 1), and then of ``ties``."""
    df = df.withColumn("u#", draw).withColumn("part#", F.floor(F.col("u#") * RANGES).cast("int"))
    sizes = df.groupBy(*group, "part#").agg(F.count("*").alias("n#"))
    joined = join_groups(df, _offsets(sizes, group, "part#", "n#", "before#"), [*group, "part#"])
    w = Window.partitionBy(*group, "part#").orderBy("u#", *ties)
    return joined.withColumn(out, F.col("before#") + F.row_number().over(w) - 1).drop("u#", "part#", "before#")


def sums_before(counts: DataFrame, value: str, n: str, group: list[str], out: str) -> DataFrame:
    """counts (group, value, n; a number's rows are distinct) with the sum of n over the lesser values of the group; null is least."""
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts#"))
    parted = join_groups(counts, cuts, group).withColumn("part#", F.coalesce(F.size(F.filter("cuts#", lambda c: c < F.col(value))), F.lit(0))).drop("cuts#")
    parted = parted.withColumn("part#", F.greatest("part#", F.lit(0)))
    sizes = parted.groupBy(*group, "part#").agg(F.sum(n).alias("n#"))
    joined = join_groups(parted, _offsets(sizes, group, "part#", "n#", "before#"), [*group, "part#"])
    w = Window.partitionBy(*group, "part#").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("before#") + F.coalesce(F.sum(n).over(w), F.lit(0))).drop("part#", "before#")
