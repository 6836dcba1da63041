"""Extra columns, some of them named like results, change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from obslake.functions.units import CONVERSIONS
from obslake.operators import anomaly, raw_records, regular_grid, roles, schema_drift, time_normalise, unit_convert
from obslake.operators.raw_records import load_records


def noisy(df, *names):
    return df.withColumns({n: F.lit("noise") for n in names if n not in df.columns})


def test_times(spark):
    df = noisy(spark.createDataFrame([(1, "s", "2025-01-01T00:00:00", None)], "row_id long, source string, t string, ingested_at timestamp"), "utc_us", "zone_used", "zone_name", "est_zone", "violations", "t_local_us")
    zones = noisy(spark.createDataFrame([("s", "UTC")], "source string, zone_name string"), "t", "utc_us")
    out = time_normalise.normalise_times(df, "t", "source", zones, "ingested_at")
    assert out.select("utc_us").first()[0] == 1735689600000000 and out.select("zone_name", "est_zone", "t_local_us").first()[0] == "noise"
    missing = time_normalise.normalise_times(df, "t", "source", zones.limit(0), "ingested_at")
    assert missing.select("utc_us").first()[0] is None


def test_records(spark):
    df = noisy(spark.createDataFrame([(1, "a,2,J")], "record_id long, raw string"), "reason", "error_offset", "fields", "v", "v_below", "name", "more")
    r = load_records(df, "raw", ["name", "v", "f"], ["v"], {"f": ["J"]}).first()
    assert (r.name, r.v, r.reason, r.more) == ("a", 2.0, None, "noise")
    assert raw_records.parse_records(df, "raw", ["a"]).columns.count("reason") == 1


def test_grid(spark):
    a = dt.datetime(2025, 1, 1)
    r = noisy(spark.createDataFrame([("m", int(a.replace(tzinfo=dt.UTC).timestamp() * 1e6), 5.0)], "source string, utc_us long, value double"), "cadence_minutes", "shard", "slot", "active_from")
    d = noisy(spark.createDataFrame([("m", a, a + dt.timedelta(minutes=2))], "source string, active_from timestamp, active_to timestamp"), "cadence_minutes", "slot")
    c = noisy(spark.createDataFrame([("m", 1)], "source string, cadence_minutes int"), "value", "active_to")
    assert [x.status for x in regular_grid.regular_series(r, d, c).orderBy("slot_ms").collect()] == ["observed", "filled"]


def test_units(spark):
    df = spark.createDataFrame([(1, "s", "u", "temp", None, "50 F", None, None, None)], "obs_id long, stream_id string, unit_id string, metric string, source_field string, value string, unit string, record_label string, observed_at timestamp")
    ref = spark.createDataFrame([(q, u, int(f == (1.0, 0.0))) for (q, u), f in CONVERSIONS.items()], "quantity string, unit_code string, is_common int")
    lab = spark.createDataFrame([("temp", "air_temperature")], "metric_label string, quantity string")
    out = unit_convert.convert_units(noisy(df, "quantity", "number", "unit_code", "is_common", "factor", "shift", "extra"), noisy(ref, "shift"), noisy(lab, "unit_code")).first()
    assert out.unit_code == "degF" and abs(out.common_value - 10) < 1e-9 and out.extra == "noise"


def test_readings_and_rows(spark):
    df = noisy(spark.createDataFrame([("s", 1, 500.0, 0.0, 100.0, False, 60_000_000)], "series string, t long, v double, lo double, hi double, log_scale boolean, cadence_us long"), "shard", "y", "run", "flag", "n")
    assert [r.flag for r in anomaly.flag_readings(df).collect()] == ["out_of_range"]
    rows = noisy(spark.createDataFrame([("d", 1, 1, '{"a": "1"}')], "dataset_id string, snapshot_no int, row_no int, payload string"), "record", "name", "column_name")
    cols = spark.createDataFrame([("d", 1, "a", "b", "integer")], "dataset_id string, snapshot_no int, name string, column_name string, column_class string")
    assert schema_drift.consistent_rows(rows, cols).first().record == {"b": "1"}


def test_roles(spark):
    df = spark.createDataFrame([("A", "2025-01-01", "<5.1", "x", "1,200", None), ("B", "2025-01-02", "n/a", "y", "7", None)], "station string, sampledate string, pfoa string, remark string, reading string, empty string")
    found = roles.classify(df, df.columns, explicit={"remark": "descriptive"}, times=["sampledate"])
    assert found == {"station": "descriptive", "sampledate": "time", "pfoa": "data", "remark": "descriptive", "reading": "data", "empty": "unassigned"}
    assert roles.identity_field("measurement_id", "beach_name") == "beach_name" and roles.identity_field("station_id", "beach_name") == "station_id"
    s = roles.RecordStructure(("station",), ("station", "remark", "station"))
    assert [r.label for r in roles.selections(df, s, ["sampledate"]).orderBy("station").collect()] == ["A / x", "B / y"]
