import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from obslake.functions.timestamps import utc_text
from obslake.operators import time_normalise as T

CASES = [
    ("2025-09-28T01:00:00.250", "2025-09-28T06:00:00.250Z"),
    ("2025-09-28 01:00:00.123456", "2025-09-28T06:00:00.123Z"),
    ("  2025-09-28T01:00:00.000 ", "2025-09-28T06:00:00.000Z"),
    ("2025-09-28T01:00:24.000-05:00", "2025-09-28T06:00:24.000Z"),
    ("2025-09-28 06:12:34.000z", "2025-09-28T06:12:34.000Z"),
    ("2025-09-28T02:48:28.000-05:00[America/Chicago]", "2025-09-28T07:48:28.000Z"),
    ("2025-11-02T01:30:00[America/Chicago]", ""),
    ("1759042800", "2025-09-28T07:00:00.000Z"),
    ("1759042800000", "2025-09-28T07:00:00.000Z"),
    ("1759039933.486", "2025-09-28T06:12:13.486Z"),
    ("09/28/2025 1:00 PM", "2025-09-28T18:00:00.000Z"),
    ("12/07/2025 12:05 AM", "2025-12-07T06:05:00.000Z"),
    ("12/07/2025 12:05 PM", "2025-12-07T18:05:00.000Z"),
    ("12/07/2025 13:05 PM", ""),
    ("9/28/2025 01:45:11.000", "2025-09-28T06:45:11.000Z"),
    ("Fri, 03 Oct 2025 00:00:00.875 -0500", "2025-10-03T05:00:00.875Z"),
    ("01 Dec 2025 00:00:00.000", "2025-12-01T06:00:00.000Z"),
    ("Nov 10, 2025 1:00:00.000 PM", "2025-11-10T19:00:00.000Z"),
    ("20250928 010259.000", "2025-09-28T06:02:59.000Z"),
    ("20250928T060000.000Z", "2025-09-28T06:00:00.000Z"),
    ("09/28/2025 01:00:00.000 CDT", "2025-09-28T06:00:00.000Z"),
    ("09/28/2025 11:29:41.000 GMT-06:00", "2025-09-28T17:29:41.000Z"),
    ("09/28/2025 11:29:41.000 XYZ", ""),
    ("2025-09-28 02:00:00,000", "2025-09-28T07:00:00.000Z"),
    ("2025/09/28 01:00:00.000", "2025-09-28T06:00:00.000Z"),
    ("2025-09-28T02:00", "2025-09-28T07:00:00.000Z"),
    ("2025-11-02T01:30:00.000", ""),
    ("2026-03-08T02:30:00.000", ""),
    ("2026-03-08T03:00:00.000", "2026-03-08T08:00:00.000Z"),
    ("2026-02-30T23:15:00", ""),
    ("2025-11-01T25:61:00", ""),
    ("2025-11", ""),
    ("2025-11-01", ""),
    ("T00:30:00", ""),
    ("??/??/2026 00:00", ""),
    ("n/a", ""),
    ("a|b", ""),
    ("2025-09-28T01:00:60.000", ""),
    ("x" * 50_000, ""),
]


def test_layouts(spark):
    rows = [(i, "s", t, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, source string, t string, utc_text string")
    zones = spark.createDataFrame([("s", "America/Chicago"), ("s", "America/Chicago")], "source string, zone_name string")
    out = T.normalise_times(df.withColumn("ingested_at", F.lit(None).cast("timestamp")), "t", "source", zones, "ingested_at")
    got = {r[0]: r[1] or "" for r in out.select("row_id", utc_text(F.col("utc_us"))).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CASES)] == CASES
    assert "utc_text" in out.columns


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_layouts(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "pending"), (4, "2025-01-01T00:00:00Z")], "row_id long, t string")
    out = T.normalise_times(df, "t", None, None, None, "America/Detroit")
    assert {r.row_id: r.utc_us for r in out.collect()} == {1: None, 2: None, 3: None, 4: 1735689600000000}
    found = T.found(out, "x", "t", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    assert [tuple(r) for r in found.collect()] == [("x", 3, "")]
    assert T.normalise_times(df.limit(0), "t", None, None, None, "UTC").count() == 0


@pytest.mark.parametrize("zone", ["America/Chicago", "Etc/GMT+6", "UTC", "Europe/Berlin"])
def test_zone_is_estimated(spark, zone):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        at = dt.datetime(2025, 9, 28, tzinfo=dt.UTC) + dt.timedelta(hours=i)
        late = dt.timedelta(minutes=rng.uniform(0.3, 9)) if rng.random() > 0.05 else dt.timedelta(hours=rng.uniform(2, 500))
        rows.append((i, "s", at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M:%S"), at + late))
    df = spark.createDataFrame(rows, "row_id long, source string, t string, ingested_at timestamp")
    zones = spark.createDataFrame([("other", "UTC"), ("s", None)], "source string, zone_name string")
    out = T.normalise_times(df, "t", "source", zones, "ingested_at")
    assert {r[0] for r in out.select("zone_used").distinct().collect()} == {zone}
    assert out.count() == 1500


def _moving(first, second, n=1500, spread=9.0):
    rng, rows = random.Random(2), []
    for i in range(n):
        at = dt.datetime(2025, 1, 6, tzinfo=dt.UTC) + dt.timedelta(hours=i)
        zone = ZoneInfo(first if i < n // 2 else second)
        rows.append((i, "s", at.astimezone(zone).strftime("%Y-%m-%dT%H:%M:%S"), at + dt.timedelta(minutes=rng.uniform(0.3, spread)), int(at.timestamp())))
    return rows


ROWS = "row_id long, source string, t string, ingested_at timestamp, true long"


def test_a_source_that_moves_has_a_history(spark):
    df = spark.createDataFrame(_moving("Asia/Tokyo", "Europe/Berlin"), ROWS)
    zones = spark.createDataFrame([("s", "Asia/Tokyo")], "source string, zone_name string")
    out = T.normalise_times(df, "t", "source", zones, "ingested_at", estimate="all").collect()
    wrong = sum(r.utc_us is not None and r.utc_us // 1_000_000 != r.true for r in out)
    # what is left is the period of 28 days in which it moves
    assert wrong <= 28 * 24 // 2 + 1 and {r.zone_used for r in out} == {"Asia/Tokyo", "Europe/Berlin"}


def test_known_zone_settles_short_series_and_ties(spark):
    zones = spark.createDataFrame([("s", "Etc/GMT+6")], "source string, zone_name string")
    for n in (4, 600):  # Chicago in winter is Etc/GMT+6
        out = T.normalise_times(spark.createDataFrame(_moving("America/Chicago", "America/Chicago", n), ROWS), "t", "source", zones, "ingested_at", estimate="all")
        assert {r.zone_used for r in out.collect()} == {"Etc/GMT+6"}


def test_undecided_zone(spark):
    df = spark.createDataFrame(_moving("UTC", "UTC", 400, 9000.0), ROWS)
    bare = T.normalise_times(df, "t", "source", None, "ingested_at").collect()
    assert all(r.utc_us is None and r.zone_used is None for r in bare)
    zones = spark.createDataFrame([("s", "UTC")], "source string, zone_name string")
    assert all(r.utc_us // 1_000_000 == r.true for r in T.normalise_times(df, "t", "source", zones, "ingested_at", estimate="all").collect())
    assert T.normalise_times(df.limit(0), "t", "source", zones, "ingested_at", estimate="all").count() == 0
