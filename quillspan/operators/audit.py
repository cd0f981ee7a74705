"""Comparing corpora: a diversity audit of variants against a baseline, and the lineage of graphs in packed form."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packed import byte_offsets, shard_of
from .coverage import coverage_summary, diversity_shift, diversity_status
from .graphs import pack_upper


def diversity_audit(baseline: DataFrame, variants: dict[str, DataFrame], warn: float, fail: float) -> tuple[DataFrame, DataFrame]:
    """(shifts by variant and metric, status by variant) of metric rows (dataset, metric, value)."""
    base = coverage_summary(baseline)
    shifts = {name: diversity_shift(base, coverage_summary(v)) for name, v in variants.items()}
    named = lambda parts: reduce(DataFrame.unionByName, [df.withColumn("variant", F.lit(n)) for n, df in parts.items()])
    return named(shifts), named({n: diversity_status(s, warn, fail) for n, s in shifts.items()})


LINEAGE = "dataset_index long, n_nodes int, n_edges int, payload binary, sha256 string"


def lineage(meta: DataFrame, shard_size: int = 128) -> DataFrame:
    """(dataset_index, n_nodes, n_edges, payload, sha256, shard, size, offset) from metadata whose JSON holds n_nodes and edges.

    offset is the payload's place in its shard's blob, were payloads appended in order.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = json.loads(text)
                a = np.zeros((facts["n_nodes"], facts["n_nodes"]), dtype=bool)
                for s, t in facts["edges"]:
                    a[s, t] = True
                payload = pack_upper(a)
                rows.append((i, facts["n_nodes"], len(facts["edges"]), payload, hashlib.sha256(payload).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["dataset_index", "n_nodes", "n_edges", "payload", "sha256"])

    packed = meta.select("dataset_index", "metadata").mapInArrow(run, LINEAGE)
    packed = packed.withColumn("shard", shard_of(F.col("dataset_index"), shard_size)).withColumn("size", F.length("payload"))
    return byte_offsets(packed, "size", ["shard"], ["dataset_index"])
