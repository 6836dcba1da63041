"""Queries that must look at every row of their tables, against plain SQL over the whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.01"
QUERIES = entry_module.queries()


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_stale_sources_of_every_table(spark, tmp_path):
    d = str(tmp_path)
    registry = [("ann_arbor_rainfall", "a"), ("ann_arbor_rainfall", "b"), ("ann_arbor_air_quality", "a"), ("ann_arbor_air_quality", "c"), ("chicago_beach_weather", "a"), ("chicago_beach_weather", "d")]
    spark.createDataFrame(registry, "source_table string, source_name string").write.parquet(f"{d}/source_registry.parquet")
    spark.createDataFrame([("a", 0.1), ("a", 9.0), (None, 9.0)], "site string, rainfall double").write.parquet(f"{d}/ann_arbor_rainfall.parquet")
    spark.createDataFrame([("c",)], "location_name string").write.parquet(f"{d}/ann_arbor_air_quality.parquet")
    spark.createDataFrame([("a",), ("b",)], "station_name string").write.parquet(f"{d}/chicago_beach_weather.parquet")
    got = QUERIES["stale_sources"](spark, d).select("source_table", "site")
    assert rows(got) == [("ann_arbor_air_quality", "a"), ("ann_arbor_rainfall", "b"), ("chicago_beach_weather", "d")]


def test_stale_sources_count_small_readings(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("ann_arbor_rainfall", "a")], "source_table string, source_name string").write.parquet(f"{d}/source_registry.parquet")
    spark.createDataFrame([("a", 0.0)], "site string, rainfall double").write.parquet(f"{d}/ann_arbor_rainfall.parquet")
    spark.createDataFrame([], "location_name string").write.parquet(f"{d}/ann_arbor_air_quality.parquet")
    spark.createDataFrame([], "station_name string").write.parquet(f"{d}/chicago_beach_weather.parquet")
    assert QUERIES["stale_sources"](spark, d).count() == 0


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables aren't here")
    c = duckdb.connect()
    for t in ("events", "customer", "orders"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    c.sql("create view halves as select *, ts >= (select make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) from events) as late from events")
    return c


def sql(duck, text):
    return sorted(tuple(map(str, r)) for r in duck.sql(text).fetchall())


def test_new_streams_of_the_second_half(spark, duck):
    want = sql(duck, "select distinct user_id, event_type from halves where late except select user_id, event_type from halves where not late")
    assert rows(QUERIES["new_streams"](spark, DATA).select("user_id", "event_type")) == want


def test_new_streams_splits_every_row_by_time(spark, tmp_path):
    d = str(tmp_path)
    # ids against the order of time, all even
    events = [(2 * i, f"2024-01-{20 - i:02d} 00:00:00", u, "x") for i, u in enumerate([9, 8, 1, 2, 3, 1])] + [(100, None, 7, "x")]
    spark.createDataFrame(events, "event_id long, t string, user_id long, event_type string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type").write.parquet(f"{d}/events.parquet")
    assert rows(QUERIES["new_streams"](spark, d).select("user_id")) == [("8",), ("9",)]


def test_reconcile_selection_has_every_customer(spark, duck):
    got = QUERIES["reconcile_selection"](spark, DATA).collect()
    assert sorted(r.c_custkey for r in got) == [r[0] for r in duck.sql("select c_custkey from customer order by 1").fetchall()]
    assert all(r.saved.startswith("v1:") if r.c_custkey % 2 == 0 else r.saved == str(r.c_custkey) for r in got)


def test_statistics_once_writes_the_hours_from_the_middle_on(spark, duck):
    want = sql(duck, """with m as (select time_bucket(interval '1 hour', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) as m from events)
        select event_type, time_bucket(interval '1 hour', ts) as bucket, count(*) as n from events, m group by 1, 2 having count(*) filter (ts < m) = 0""")
    assert want and rows(QUERIES["statistics_once"](spark, DATA).select("event_type", "bucket", "n")) == want


def test_source_route_compares_with_all_events_up_to_a_time(spark, duck):
    want = sql(duck, "select max(ts) filter (not late), max(ts), case when epoch_us(max(ts)) - epoch_us(max(ts) filter (not late)) >= 1800e6 then 'file' else 'api' end from halves")
    assert rows(QUERIES["source_route"](spark, DATA).select("api_latest", "file_latest", "source")) == want


def test_chao1_population_counts_all_orders(spark, duck):
    want = duck.sql("select count(*), count(*) filter (c = 1), count(*) filter (c = 2), sum(c) from (select count(*) as c from orders group by o_custkey)").fetchall()[0]
    got = QUERIES["chao1_population"](spark, DATA).first()
    assert (got.observed, got.singletons, got.doubletons, got.sample_rows) == want
    unseen = got.singletons**2 / (2 * got.doubletons) if got.doubletons else got.singletons * max(got.singletons - 1, 0) / 2
    assert got.estimated == math.ceil(got.observed + unseen)
