"""What the operators ask of the session: the shared folder, materialised tables, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one where driver and executors are one process.

    On a cluster a session without spark.checkpoint.dir is refused: a folder of this machine is not seen by others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths of the tables made in each settled() under way.
_scratch: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage is cut, each row computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by materialize()."""
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("table-"):
            _delete(df.sparkSession, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a table of their own; the tables that materialize() made on the way are deleted."""
    _scratch.append([])
    try:
        out = materialize(make())
        path = _scratch[-1].pop()  # the last one made is what stays
        if len(_scratch) > 1:
            _scratch[-2].append(path)
        return out
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spare_name(df: DataFrame, name: str) -> str:
    """A column name like name that df does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name
