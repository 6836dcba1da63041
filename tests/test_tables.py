import pytest
from pyspark.sql import functions as F

from obslake import tables
from obslake.operators import anomaly, schema_drift
from obslake.tables import lookup_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_copies_of_a_lookup_beyond_the_limit_are_not_broadcast(spark, tmp_path, how):
    spark.range(40).select((F.col("id") % 20).alias("k"), F.lit("x").alias("v")).distinct().write.parquet(f"{tmp_path}/small")
    big, small = spark.range(60).select(F.when(F.col("id") < 50, F.col("id") % 25).alias("k"), "id"), spark.read.parquet(f"{tmp_path}/small")
    out = lookup_join(big, small, ["k"], how, max_rows=10)
    rows = sorted(out.collect(), key=str)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(big.join(small, "k", how).collect(), key=str)


def test_snapshots_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    fields = spark.createDataFrame([("d", n, name, "text") for n in (1, 2, 3) for name in ("a", "b")[: 1 + n % 2]], "dataset_id string, snapshot_no int, name string, type_class string")
    want = sorted(schema_drift.lifespans(fields).collect())
    monkeypatch.setattr(tables, "at_most", lambda *_: False)
    out = schema_drift.lifespans(fields)
    assert sorted(out.collect()) == want and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_flagged_readings_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "s", i // 2, float(i // 2)) for i in range(8)], "row_id long, series string, t long, v double")
    flagged = spark.createDataFrame([("s", 1, 1.0, "spike", 0.9), ("s", 3, 3.0, "stuck", 0.8)], "series string, t long, v double, flag string, probability double")
    monkeypatch.setattr(tables, "at_most", lambda *_: False)
    out = anomaly.flag_rows(rows, flagged)
    assert sorted(r.row_id for r in out.collect()) == [2, 3, 6, 7] and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_of_many_bytes_is_not_broadcast(spark, tmp_path):
    spark.range(2000).select("id", F.repeat(F.lit("x"), 5000).alias("v")).write.parquet(f"{tmp_path}/small")
    big, small = spark.range(3000), spark.read.parquet(f"{tmp_path}/small")
    for more in ({}, {"salts": 1}):
        out = lookup_join(big, small, ["id"], **more)
        assert out.where("v is not null").count() == 2000 and out.count() == 3000 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_runs_and_constants_of_series_are_not_broadcast(spark):
    rows = [("s", i * 3_600_000_000, float(i % 7), 0.0, 100.0, False, 3_600_000_000) for i in range(50)]
    blocks = tables.checkpointed(anomaly.shards(spark.createDataFrame(rows, "series string, t long, v double, lo double, hi double, log_scale boolean, cadence_us long")))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (anomaly.carried(blocks), anomaly.constants(blocks))]
    # but for the few bounds that series share
    assert [p.count("BroadcastHashJoin") for p in plans] == [0, 1]


def test_lifespans_are_not_broadcast(spark):
    fields = [("d", n, name, None, None, "text", 1, "text") for n in (1, 2, 3) for name in ("a", "b" if n < 3 else "c")]
    spans = tables.checkpointed(schema_drift.lifespans(spark.createDataFrame(fields, "dataset_id string, snapshot_no int, name string, label string, description string, data_type string, ordinal int, type_class string")))
    out = schema_drift.columns(spans, spark.createDataFrame([("d", 3, "b", "c")], "dataset_id string, snapshot_no int, old_name string, new_name string"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.snapshot_no, r.name, r.column_name) for r in out.collect()) == [(1, "a", "a"), (1, "b", "c"), (2, "a", "a"), (2, "b", "c"), (3, "a", "a"), (3, "c", "c")]
