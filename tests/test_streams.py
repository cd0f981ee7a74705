"""Windows of a stream, the open ones too, and keys with nulls."""

import shutil

from pyspark.sql import functions as F

from quillspan.functions.rng import uniform, uniform_sql
from quillspan.streaming.coverage import latest_windows, run_to_batches, windowed_coverage


def test_all_windows_equal_the_batch(spark, tmp_path):
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ts = events.approxQuantile("event_id", [0.5], 0.0)[0]
    key = lambda df: sorted((r["window_start"], r["metric"], r["count"], round(r["mean"], 9), r["min"], r["max"]) for r in df.collect())
    # A generous watermark, so that no event of the second half is late.
    stream = lambda: windowed_coverage(spark.readStream.schema(events.schema).parquet(source), "ts", "event_type", "value", window="1 day", late="3650 days")
    for part, seen in ((F.col("event_id") <= ts, events.where(F.col("event_id") <= ts)), (F.col("event_id") > ts, events)):
        events.where(part).write.mode("append").parquet(source)
        run_to_batches(stream(), out, point)
        assert key(latest_windows(spark, out)) == key(windowed_coverage(seen, "ts", "event_type", "value", window="1 day"))
    shutil.rmtree(out)


def test_null_keys_are_keys_of_their_own(spark, duck):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None), ("a", "")], "p string, q string")
    got = [r[0] for r in df.select(uniform(1, "x", "p", "q")).collect()]
    assert len(set(got)) == 5
    sql = f"SELECT {uniform_sql(1, 'x', 'p', 'q')} FROM (VALUES ('a', NULL), (NULL, 'a'), ('a', 'a'), (NULL, NULL), ('a', '')) AS t(p, q)"
    assert got == [r[0] for r in duck.execute(sql).fetchall()]
