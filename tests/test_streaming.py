"""Sinks and snapshots of streams, batch by batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from obslake.streaming import refresh as R

POINTS = "k string, at string, n long, value double"


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS).select("k", F.col("at").cast("timestamp_ntz").alias("ts"), F.struct("n").alias("seq"), "value")


def kept(spark, path):
    return {r.k: r.value for r in R.kept_latest(spark, path).collect()}


def test_latest_of_batches_with_gaps_reruns_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "kept")
    sink = R.refresh_latest(path, ["k"])
    assert R.kept_latest(spark, path) is None
    sink(points(spark, [("a", "2024-01-02", 1, 1.0), ("b", "2024-01-01", 2, 2.0), ("c", None, 3, 3.0)]), 0)
    sink(points(spark, [("a", "2024-01-01", 4, 9.0), ("b", "2024-01-03", 5, 5.0)]), 3)
    assert kept(spark, path) == {"a": 1.0, "b": 5.0, "c": 3.0}
    again = points(spark, [("a", "2024-01-05", 6, 6.0), ("d", "2024-01-05", 7, 7.0)])
    sink(again, 4)
    sink(again, 4)
    assert kept(spark, path) == {"a": 6.0, "b": 5.0, "c": 3.0, "d": 7.0}
    for n in range(5, 9):
        sink(points(spark, [("a", f"2024-01-{n + 1:02d}", n, float(n))]), n)
    assert kept(spark, path)["a"] == 8.0 and max(map(len, R._versions(spark, path).values())) == 2
    sink(points(spark, []), 9)
    assert len(kept(spark, path)) == 4


def test_known_keys_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "known")
    sink = R.discover(path, ["k"])
    for n, ks in enumerate((["a", "b", "a"], ["b", "c"], ["b", "c"], [])):
        sink(spark.createDataFrame([(k, 1) for k in ks], "k string, x int"), n)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_an_unreadable_table_of_known_keys_is_an_error(spark, tmp_path):
    path = tmp_path / "known"
    R.discover(str(path), ["k"])(spark.createDataFrame([("a",)], "k string"), 0)
    for folder, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as broken:
                    broken.write(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|cannot|fail"):
        R.discover(str(path), ["k"])(spark.createDataFrame([("a",)], "k string"), 1)


def test_snapshot_bears_some_failures_but_not_all(spark):
    def fails():
        raise OSError("down")

    df, errors = R.snapshot({"x": lambda: spark.range(2), "y": fails, "z": lambda: spark.range(1).where("id > 5")})
    assert sorted((r.source, r.id) for r in df.collect()) == [("x", 0), ("x", 1)]
    assert errors == {"y": "OSError: down"}
    with pytest.raises(RuntimeError):
        R.snapshot({"y": fails})


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    day = dt.datetime(2024, 1, 1)
    schema = "k string, ts timestamp_ntz, value double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = R.bucketed(spark.readStream.schema(schema).parquet(src), ["k"], "ts", "value", 60, "1 hour")
        R.run_available(stream, R.append_batches(out), state)
        return sorted((r.bucket.hour, r.n) for r in spark.read.parquet(out).select("bucket", "n").collect())

    assert run([("a", day + dt.timedelta(minutes=m), 1.0) for m in (0, 30, 70, 250)]) == [(0, 2), (1, 1)]
    # late rows change no bucket that was emitted
    assert run([("a", day + dt.timedelta(minutes=m), 1.0) for m in (10, 260, 400)]) == [(0, 2), (1, 1), (4, 2)]
