"""Lineage of graphs on disk: one blob of packed adjacency for each shard, an index of it, and the schema of a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import lineage
from ..operators.graphs import unpack_upper

SCHEMA_NAME = "quillspan.graph_lineage"
#: The versions of a record (adjacency in full, or by reference to a blob), and how a blob encodes it.
DENSE, COMPACT, ENCODING = "1.0.0", "1.1.0", "upper_triangle_bitpack_v1"
REF = "struct<encoding:string,blob_path:string,index_path:string,dataset_index:bigint,bit_offset:bigint,bit_length:bigint,sha256:string>"
RECORD = f"schema_name string, schema_version string, graph struct<n_nodes:int,adjacency:array<array<int>>,edge_count:bigint,adjacency_ref:{REF}>, assignments struct<feature_to_node:array<int>,target_to_node:int>"
INDEX = "dataset_index long, n_nodes int, edge_count int, bit_offset long, bit_length long, sha256 string, shard long"


def write_blobs(meta: DataFrame, path: str, *, shard_size: int = 128) -> None:
    """path/lineage/blobs: (shard, blob) of each shard's packed graphs one after another; path/lineage/index: JSON lines that point into them.

    A shard holds at most ``shard_size`` graphs, so a blob is put together in one group of bounded size.
    """
    packed = lineage(meta, shard_size)
    blobs = packed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("dataset_index", "payload"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["payload"]))
    blobs.select("shard", joined.alias("blob")).write.mode("errorifexists").parquet(f"{path}/lineage/blobs")
    n = F.col("n_nodes").cast("long")
    index = packed.select("dataset_index", "n_nodes", F.col("n_edges").alias("edge_count"), (8 * F.col("offset")).alias("bit_offset"), F.floor(n * (n - 1) / 2).alias("bit_length"), "sha256", "shard")
    index.write.mode("errorifexists").json(f"{path}/lineage/index")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The index with payload, cut out of the shards' blobs, and intact: whether its checksum holds."""
    index = spark.read.schema(INDEX).option("mode", "FAILFAST").json(f"{path}/lineage/index")
    blobs = spark.read.schema("shard long, blob binary").parquet(f"{path}/lineage/blobs")
    start, size = (F.col("bit_offset") / 8 + 1).cast("int"), F.ceil(F.col("bit_length") / 8).cast("int")
    payload = F.substring(F.col("blob"), start, size)
    return index.join(blobs, "shard").withColumn("payload", payload).drop("blob").withColumn("intact", F.sha2("payload", 256) == F.col("sha256"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_index, src, dst) of all graphs of a corpus; a payload that is not intact is an error."""
    held = read_payloads(spark, path)
    sound = held.withColumn("payload", F.when(F.col("intact"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("lineage payload is damaged: dataset "), F.col("dataset_index").cast("string")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                src, dst = np.nonzero(unpack_upper(payload, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), i)), pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32))], ["dataset_index", "src", "dst"])

    return sound.select("dataset_index", "n_nodes", "payload").mapInArrow(run, "dataset_index long, src int, dst int")


def compact_records(spark: SparkSession, path: str, feature_nodes: list[int], target_node: int) -> DataFrame:
    """(dataset_index, record): a record of each graph by reference to its blob."""
    index = spark.read.schema(INDEX).option("mode", "FAILFAST").json(f"{path}/lineage/index")
    name = lambda kind: F.concat(F.lit(f"lineage/{kind}/shard="), F.col("shard").cast("string"))
    ref = F.struct(F.lit(ENCODING).alias("encoding"), name("blobs").alias("blob_path"), name("index").alias("index_path"), "dataset_index", "bit_offset", "bit_length", "sha256")
    graph = F.struct("n_nodes", F.lit(None).cast("array<array<int>>").alias("adjacency"), F.col("edge_count").cast("long").alias("edge_count"), ref.alias("adjacency_ref"))
    nodes = F.struct(F.array(*map(F.lit, feature_nodes)).cast("array<int>").alias("feature_to_node"), F.lit(target_node).alias("target_to_node"))
    return index.select("dataset_index", F.struct(F.lit(SCHEMA_NAME).alias("schema_name"), F.lit(COMPACT).alias("schema_version"), graph.alias("graph"), nodes.alias("assignments")).alias("record"))


def problem(record: Column) -> Column:
    """The path of the first field of a record (RECORD) that breaks the schema; null for a sound one.

    A dense record holds its adjacency in full: square, zeros and ones, nothing on or below the diagonal.  A compact one points
    to a byte-aligned run of bits of the right length, with a checksum in hexadecimal digits.  Assignments name nodes of the graph.
    """
    graph, nodes, version = record["graph"], record["assignments"], record["schema_version"]
    n, a, ref = graph["n_nodes"], graph["adjacency"], graph["adjacency_ref"]
    bits = (n.cast("long") * (n.cast("long") - 1) / 2).cast("long")
    dense, compact = version == DENSE, version == COMPACT
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    outside = lambda c: c.isNull() | (c < 0) | (c >= n)
    cell = F.exists(a, lambda row: F.exists(row, lambda v: v.isNull() | ~v.isin(0, 1)))
    low = F.exists(F.transform(a, lambda row, i: F.exists(F.slice(row, F.lit(1), i + 1), lambda v: v != 0)), lambda x: x)
    # The paths are fixed values.
    rules = [
        ("schema_name", record["schema_name"].isNull() | (record["schema_name"] != SCHEMA_NAME)),
        ("schema_version", version.isNull() | ~(dense | compact)),
        ("graph", graph.isNull()),
        ("graph.n_nodes", n.isNull() | (n < 2)),
        ("graph.adjacency", (dense & (a.isNull() | (F.size(a) != n) | F.exists(a, lambda row: row.isNull() | (F.size(row) != n)))) | (compact & a.isNotNull())),
        ("graph.adjacency.value", dense & cell),
        ("graph.adjacency.triangle", dense & low),
        ("graph.edge_count", compact & (graph["edge_count"].isNull() | (graph["edge_count"] < 0) | (graph["edge_count"] > bits))),
        ("graph.adjacency_ref", (compact & ref.isNull()) | (dense & ref.isNotNull())),
        ("graph.adjacency_ref.encoding", compact & (ref["encoding"].isNull() | (ref["encoding"] != ENCODING))),
        ("graph.adjacency_ref.blob_path", compact & blank(ref["blob_path"])),
        ("graph.adjacency_ref.index_path", compact & blank(ref["index_path"])),
        ("graph.adjacency_ref.dataset_index", compact & (ref["dataset_index"].isNull() | (ref["dataset_index"] < 0))),
        ("graph.adjacency_ref.bit_offset", compact & (ref["bit_offset"].isNull() | (ref["bit_offset"] < 0) | (ref["bit_offset"] % 8 != 0))),
        ("graph.adjacency_ref.bit_length", compact & (ref["bit_length"].isNull() | (ref["bit_length"] != bits))),
        ("graph.adjacency_ref.sha256", compact & (ref["sha256"].isNull() | ~F.rlike(ref["sha256"], F.lit("^[0-9a-fA-F]{64}$")))),
        ("assignments", nodes.isNull()),
        ("assignments.feature_to_node", nodes["feature_to_node"].isNull() | F.exists(nodes["feature_to_node"], outside)),
        ("assignments.target_to_node", outside(nodes["target_to_node"])),
    ]
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])
