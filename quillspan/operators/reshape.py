"""Set operations, reshapes and joins between parts of a corpus: splits, parents, vectors and columns, groups in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits' rows, told apart by a column split; columns are matched by name."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def gather(rows: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """The rows that an assignment (key, further columns) names, with its columns; a row named twice comes twice."""
    return rows.join(assignment, key)


def concat_parents(parents: list[DataFrame], key: str, vector: str) -> DataFrame:
    """(key, vector): the parents' vectors of each key, one after another; keys that a parent lacks are left out."""
    named = [p.select(key, F.col(vector).alias(f"_{i}")) for i, p in enumerate(parents)]
    joined = reduce(lambda a, b: a.join(b, key), named)
    return joined.select(key, F.concat(*[F.col(f"_{i}") for i in range(len(parents))]).alias(vector))


def key_differences(keys: Column, required: list[str], optional: list[str]) -> tuple[Column, Column]:
    """(missing, unknown), both in order, of a record's keys against a schema's."""
    need, known = F.array(*map(F.lit, required)), F.array(*map(F.lit, required + optional))
    return F.array_sort(F.array_except(need, keys)), F.array_sort(F.array_except(keys, known))


def stack(df: DataFrame, keys: list[str], values: list[str], out: str = "x") -> DataFrame:
    """Columns to one vector."""
    return df.select(*keys, F.array(*[F.col(v).cast("double") for v in values]).alias(out))


def unstack(df: DataFrame, keys: list[str], vector: str, names: list[str]) -> DataFrame:
    """A vector to columns; entries beyond its end are null."""
    return df.select(*keys, *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)])


def one_hot(label: Column, classes: list) -> Column:
    """1 at the label's place among the classes, 0 elsewhere; all 0 for null and for other labels."""
    return F.array(*[F.coalesce(label == F.lit(c), F.lit(False)).cast("double") for c in classes])


def group_starts(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """df with starts (the value differs from the row before) and run (the number of the run, from 1), along each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    first = F.row_number().over(w) == 1
    starts = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def project_features(vector: str, mapping: list[int]) -> Column:
    """The vector's entries at the mapped places, as after a permutation of columns."""
    return F.array(*[F.get(vector, F.lit(i)) for i in mapping])


def first_datasets(df: DataFrame, k: int, key: str = "dataset_index") -> DataFrame:
    """The rows of the k least keys; only k keys leave the sort."""
    return df.join(df.select(key).distinct().orderBy(key).limit(k), key, "left_semi")


def aggregate_parents(rows: DataFrame, group: list[str], vector: str, *, scale: float = 1.0) -> DataFrame:
    """(group, i, total, product, top, lse): entry by entry, the sum, the product of 1 + x / scale, the greatest and the log of summed exponentials of a group's vectors.

    Two partial aggregations: the greatest first, by which exponentials are then shifted.
    """
    cells = rows.select(*group, F.posexplode(vector).alias("i", "v"))
    keys = [*group, "i"]
    top = cells.groupBy(*keys).agg(F.max("v").alias("m"))
    shifted = cells.join(top, keys)
    v, m = F.col("v"), F.col("m")
    return shifted.groupBy(*keys).agg(F.sum(v).alias("total"), F.product(1 + v / F.lit(scale)).alias("product"), F.max(v).alias("top"), (F.max(m) + F.ln(F.sum(F.exp(v - m)))).alias("lse"))


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each once; each part is thinned before rows are moved."""
    return reduce(lambda a, b: a.unionByName(b), [p.distinct() for p in parts]).distinct()
