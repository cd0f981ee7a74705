"""Packed corpora on disk: Parquet rows by shard, JSON metadata lines, lineage blobs and manifests."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "dataset_index long, split string, row_index long, x array<float>, y double, attempt int"
#: Datasets of a file, at most.
FILE_DATASETS = 16


def shard_of(index: Column, size: int) -> Column:
    return F.floor(index / F.lit(max(1, size))).cast("long")


def write_packed(rows: DataFrame, meta: DataFrame | Callable[[DataFrame], DataFrame], path: str, *, shard_size: int = 128, compression: str = "zstd", in_ranges: bool = False) -> None:
    """rows under path/rows/shard=N/split=S as Parquet and meta under path/metadata as JSON lines; a path in use is refused.

    A shard's split lies in one or several files, each in order and of datasets that no other file holds.  Rows are dealt
    by hash of shard, split and file: dealing by range would sample them first, and so generate them twice.
    With ``in_ranges`` rows lie by ranges of datasets already, as generate_corpus makes them, and are written where they are.
    meta may be a function of the rows as written.
    """
    shard = shard_of(F.col("dataset_index"), shard_size)
    out = rows.withColumn("shard", shard)
    if not in_ranges:
        file = F.floor(F.pmod(F.col("dataset_index"), F.lit(max(1, shard_size))) / FILE_DATASETS)
        out = out.repartition("shard", "split", file)
    out = out.sortWithinPartitions("shard", "split", "dataset_index", "row_index")
    # Floats rarely repeat: a dictionary of them is only tried and thrown away.
    writer = out.write.mode("errorifexists").option("compression", compression).option("parquet.enable.dictionary#x.list.element", "false")
    writer.partitionBy("shard", "split").parquet(f"{path}/rows")
    meta = meta(read_packed(rows.sparkSession, path)) if callable(meta) else meta
    write_records(meta.withColumn("shard", shard), f"{path}/metadata")


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what lies in a folder of any store; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(where)) if fs.exists(where) else []


def find_shards(spark: SparkSession, path: str) -> list[int]:
    """The shards of a corpus, in order.  A corpus without any, a folder of another name, or a shard without both splits is an error."""
    out = []
    for name, folder, _ in _listing(spark, f"{path}/rows"):
        if not folder:
            continue  # markers of the writer
        head, _, number = name.partition("=")
        if head != "shard" or not number.isdigit():
            raise ValueError(f"{path}/rows/{name} is no shard")
        splits = {n for n, is_folder, _ in _listing(spark, f"{path}/rows/{name}") if is_folder}
        if splits != {"split=train", "split=test"}:
            raise ValueError(f"shard {number} holds {sorted(splits) or 'no split'}")
        out.append(int(number))
    if not out:
        raise ValueError(f"no shards in {path}")
    return sorted(out)


def schema_problems(df: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> list[str]:
    """What a table's columns lack against a schema of names and types: missing ones, wrong types, and unknown ones, in order."""
    have, known = dict(df.dtypes), required | (optional or {})
    lost = [f"{c}: missing" for c in required if c not in have]
    wrong = [f"{c}: {have[c]}, not {t}" for c, t in known.items() if c in have and have[c] != t]
    return lost + wrong + [f"{c}: unknown" for c in have if c not in known]


def check_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a corpus that find_shards accepts, with an error on the first dataset whose rows do not run from 0 or differ in width.

    One aggregation looks at row numbers and widths; rows are then read as they are.
    """
    find_shards(spark, path)
    rows = read_packed(spark, path)
    i, width = F.col("row_index"), F.size("x")
    ok = (F.min(i) == 0) & (F.max(i) == F.count("*") - 1) & (F.count_distinct(i) == F.count("*")) & (F.min(width) == F.max(width))
    bad = rows.groupBy("dataset_index", "split").agg(ok.alias("ok")).where("NOT coalesce(ok, false)").orderBy("dataset_index", "split").limit(5).collect()
    if bad:
        raise ValueError(f"rows are not contiguous or differ in width: {[(r['dataset_index'], r['split']) for r in bad]}")
    return rows


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS + ", shard long").parquet(f"{path}/rows")


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, numbers that JSON lacks as null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in floats})
    clean.select(*sorted(clean.columns)).write.mode("errorifexists").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; anything else is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unpack_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v): the entries of the rows' vectors."""
    return rows.select(*keys, F.posexplode("x").alias("i", "v"))


def pack_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): entries put together in order; a row's entries are few."""
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))


def contiguity(rows: DataFrame, group: list[str], index: str) -> DataFrame:
    """(group, n, contiguous): whether row numbers run from 0 without gap or repeat; one aggregation."""
    ok = (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), ok.alias("contiguous"))


def ragged(rows: DataFrame) -> DataFrame:
    """Datasets whose rows differ in length."""
    return rows.groupBy("dataset_index").agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).where("lo <> hi")


def merge_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right): a full join that shows what either side lacks."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("l", F.lit(False)).alias("in_left"), F.coalesce("r", F.lit(False)).alias("in_right"))


def require_match(left: DataFrame, right: DataFrame, key: str) -> None:
    bad = merge_coverage(left, right, key).where("NOT (in_left AND in_right)").limit(5).collect()
    if bad:
        raise ValueError(f"{key} without a partner: {[r[key] for r in bad]}")


def byte_offsets(df: DataFrame, size: str, group: list[str], order: list[str]) -> DataFrame:
    """df with offset: the sizes that come before in the group, as in a blob that rows are appended to."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def write_json(payload: dict, path: str, *, replace: bool = False) -> str:
    """A JSON file written aside and moved into place; a path in use is refused."""
    if os.path.exists(path) and not replace:
        raise FileExistsError(path)
    aside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        with open(aside, "w") as f:
            json.dump(payload, f, indent=2, sort_keys=True, allow_nan=False)
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.unlink(aside)
    return path


def manifest(rows: DataFrame, *, run: str, config: dict, elapsed: float) -> dict:
    """A record of a corpus: identity, sizes, digest and throughput."""
    from ..operators.gates import digest

    per = digest(rows, ["dataset_index", "split", "row_index", "x", "y"], ["dataset_index"])
    # The digests of datasets are added up in turn, so that none are gathered.
    total = digest(per, ["dataset_index", "n", "digest"], []).join(per.agg(F.sum("n").alias("rows")), how="cross").first()  # one row each
    return {"schema_version": "1.1.0", "run": run, "config": config, "datasets": total["n"], "rows": total["rows"] or 0, "digest": total["digest"], "datasets_per_minute": 60 * total["n"] / elapsed if elapsed else None}


def handoff(spark: SparkSession, root: str, record: dict, *, groups: dict[str, str], hardware: dict, sections: tuple[str, ...] = ("rows", "metadata")) -> dict:
    """What a consumer of a corpus needs: its record, identity groups, hardware, and for each section its relative path, files, bytes and a checksum.

    A section's checksum is made of its files' lengths and SHA-256 sums, added up by name on the executors; a file
    is read whole by one task, as files of a corpus are small (FILE_DATASETS).
    """
    from ..operators.gates import digest

    out = {}
    for section in sections:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{root}/{section}")
        # Part names hold a job's number; the folders and the contents do not.
        folder = F.regexp_extract("path", f"/{section}/(.*)/[^/]*$", 1)
        named = files.select(folder.alias("folder"), "length", F.sha2("content", 256).alias("sum"))
        got = digest(named, ["folder", "length", "sum"], []).join(named.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")), how="cross").first()  # one row each
        out[section] = {"path": section, "files": got["n"], "bytes": got["bytes"], "checksum": got["digest"]}
    return {"schema_name": "quillspan.handoff", "schema_version": 1, "corpus": record, "identity": groups, "hardware": hardware, "artifacts": out}


def check_handoff(spark: SparkSession, root: str, payload: dict) -> list[str]:
    """What of a hand-off record does not hold (names of fields, in order); empty for a sound corpus."""
    lacking = [k for k in ("schema_name", "schema_version", "corpus", "identity", "hardware", "artifacts") if k not in payload]
    if lacking:
        return lacking
    now = handoff(spark, root, payload["corpus"], groups=payload["identity"], hardware=payload["hardware"], sections=tuple(payload["artifacts"]))
    return [f"artifacts.{name}.{k}" for name, held in sorted(payload["artifacts"].items()) for k in sorted(held) if held[k] != now["artifacts"][name].get(k)]
