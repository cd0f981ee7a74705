"""The shared folder and the tables in it."""

import os

import pytest

from quillspan.llm import session


def tables(spark):
    folder = session.shared_dir(spark).removeprefix("file:").replace("//", "/", 1) if session.shared_dir(spark).startswith("file:") else session.shared_dir(spark)
    return {n for n in os.listdir(folder) if n.startswith("table-")}


def test_tables_on_the_way_are_deleted(spark):
    session.materialize(spark.range(1))  # the folder exists
    before = tables(spark)

    def make():
        one = session.materialize(spark.range(10))
        two = session.settled(spark, lambda: session.materialize(one.where("id > 2")))
        return two.where("id > 4")

    out = session.settled(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [5, 6, 7, 8, 9] and len(tables(spark) - before) == 1
    with pytest.raises(ZeroDivisionError):
        session.settled(spark, lambda: session.materialize(spark.range(3)).limit(1 // 0))
    assert len(tables(spark) - before) == 1
    session.forget(out)
    assert tables(spark) == before
    empty = session.settled(spark, lambda: session.materialize(spark.range(5)).where("id > 9"))
    assert empty.count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
