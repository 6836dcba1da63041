"""Operators of records, catalogs and states on small tables with nulls, ties and clashing names."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.operators import catalog, fingerprint, geo, observations, portal, roles, sinks
from obslake.plans import records

DATA = "/root/testdata/sf0.001"

T0 = dt.datetime(2024, 1, 1)


def test_points_with_units_records_and_clashing_names(spark):
    rows = [("s1", "pm", "7", "ppb", "A", T0, 1), ("s1", "pm", "8", None, None, T0, 2), ("s1", " pm ", "9", "ppb", "B  b", T0, 3), (None, "pm", "1", "ppb", "x", T0, 4), ("s1", None, None, "ppb", "x", T0, 5)]
    df = spark.createDataFrame(rows, "site string, metric string, value string, UoM string, note string, at timestamp, n long")
    r = observations.with_unit_column(observations.Roles(unit=["site"], data=["value"], time="at", seq=["n"], names=["metric"], record_keys=["site", "note"], record_labels=["note"]), df.columns)
    assert r.unit_column == "UoM"
    got = {x.unit: x for x in observations.latest(observations.to_points(df, r), ["site", "metric", "unit"]).collect()}
    assert set(got) == {"ppb", None} and got["ppb"].value == 9.0 and got["ppb"].record_label == "B b"
    assert got[None].record_id is None and got["ppb"].record_id.startswith("v1:")
    assert observations.with_unit_column(observations.Roles(unit=["site"], data=["value"]), ["a"]).unit_column is None


def test_assembled_history_is_bounded(spark):
    points = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), i, float(i)) for i in range(10)] + [("b", None, 1, 2.0), ("c", T0, 1, None)], "k string, ts timestamp, seq long, value double").withColumn("value_text", F.col("value").cast("string"))
    got = {r.k: r for r in observations.assembled(points, ["k"], 4).collect()}
    assert (got["a"].value, got["a"].history_points, got["a"].history_start) == (9.0, 4, T0 + dt.timedelta(days=6))
    assert (got["b"].history_points, got["b"].history_start) == (0, None) and got["c"].history_points == 0
    assert observations.assembled(points.limit(0), ["k"]).count() == 0


def test_distinct_rows_are_clamped(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), (None, 3)], "k string, v int")
    assert [tuple(r) for r in observations.distinct_rows(df, "k", ["v", "k"], 99, 3).collect()] == [(None, 3), ("a", 2), ("b", 1)]
    assert observations.distinct_rows(df, "k", [], -4).count() == 1


def test_status(spark):
    reg = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("zz", 9)], "k string, t long")
    assert {r.k: (r.status, r.rows, r.latest) for r in sinks.status(reg, rows, ["k"], "t").collect()} == {"a": ("data_available", 2, 5), "b": ("no_data", 0, None), None: ("no_data", 0, None)}


def test_normal_forms(spark):
    df = spark.createDataFrame([(1, [" a ", "", None, "a", "b"], "x", " "), (2, None, None, None)], "i int, l array<string>, a string, b string")
    out = {r.i: r for r in df.select("i", V.normal_list("l").alias("n"), V.entity_key("a", "b").alias("e")).collect()}
    assert out[1].n == ["a", "b"] and out[2].n == [] and out[2].e is None
    times = spark.createDataFrame([("2024-01-01T00:00:00z",), ("2024-01-01 01:00:00 +0100",), ("1704067200",), ("1704067200000",), ("soon",), ("",), (None,)], "t string")
    got = [(r[0], r[1]) for r in times.select(F.unix_seconds(V.to_ts("t")), F.unix_seconds(V.to_iso_ts("t"))).collect()]
    assert got == [(1704067200, 1704067200)] * 2 + [(1704067200, None)] * 2 + [(None, None)] * 3


def test_query_values(spark):
    urls = ["https://x.example/a?q=one+two&q=b", "https://x.example/a?p=1&q=%C3%A9#q=no", "https://x.example/?xq=1", "not one?q=1", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(portal.query_value(F.col("u"), "q")).collect()]
    assert got == ["one two", "é", None, None, None]


def test_coordinate_modes(spark):
    df = spark.createDataFrame([("a", "Lat"), ("a", "lon"), ("a", "lon"), ("b", "the_geom"), ("b", "Location"), ("c", "latitude"), ("c", None), ("d", None)], "k string, name string")
    got = {r.k: (r.coordinate_mode, r.coordinate_fields) for r in geo.coordinate_modes(df, ["k"], "name").collect()}
    assert got == {"a": ("wgs84_fields", "Lat|lon"), "b": ("geometry", "Location|the_geom"), "c": ("none", "latitude"), "d": ("none", "")}
    assert geo.coordinate_fields(["x", "LON", "geom", "lat"]) == ["LON", "geom", "lat"]


def test_labels_of_candidates(spark):
    df = spark.createDataFrame([(7, "t" * 300, ["a", "b", "c", "d"]), (123, "x", []), (1234, None, None)], "s int, t string, w array<string>")
    got = [r[0] for r in df.select(catalog.candidate_label(F.col("s"), F.coalesce("t", F.lit("")), F.coalesce("w", F.array().cast("array<string>")))).collect()]
    assert got[0].startswith("007 · ttt") and len(got[0]) <= 150 and got[0].endswith(" — a, b, c") and got[1:] == ["123 · x", "1234 · "]


def test_language_packs(spark):
    base = spark.createDataFrame([("rain", "precipitation", 1), (None, "x", 1)], "alias string, metric_id string, metric_order int")
    more = spark.createDataFrame([("rain", "precipitation", 0), ("Regen", "precipitation", 1)], "alias string, metric_id string, metric_order int")
    got = {r.alias: (r.language, r.metric_order) for r in catalog.merge_packs([("en", 1, base), ("de", 1, more)]).collect()}
    assert got == {"rain": ("en", 0), "Regen": ("de", 1)}
    with pytest.raises(ValueError):
        catalog.merge_packs([("en", 2, base)])


def test_reviewed_roles_outlive_a_change_of_schema(spark):
    df = spark.createDataFrame([("a", "1.5", "x")], "station string, temperature string, other string")
    assert roles.retained(df, df.columns, {"station": "location", "gone": "time"}) == {"station": "location", "temperature": "data", "other": "unassigned"}
    fields = spark.createDataFrame([("d", n) for n in ("station", "Temperature", "date", "q", "q")], "k string, name string")
    reviewed = spark.createDataFrame([("d", "station", "data"), ("d", "gone", "time"), ("e", "q", "time")], "k string, name string, role string")
    got = {r.name: (r.role, r.reviewed) for r in roles.retained_roles(fields, reviewed, ["k"]).collect()}
    assert got == {"station": ("data", True), "Temperature": ("data", False), "date": ("time", False), "q": ("unassigned", False)}


def test_states_survive_bad_json(spark):
    part = {c: "p" for c in ("digest", "schema", "roles", "metrics", "dimensions", "coordinates", "ordering")}
    one = spark.createDataFrame([("a", *part.values(), 1000.0, True)], "k string, " + ", ".join(f"{c} string" for c in part) + ", last_attempt_s double, failed boolean")
    kept = fingerprint.dump_state(one, "k")
    back = fingerprint.load_state(kept, "k", "state").first()
    assert back.asDict() == one.first().asDict()
    bad = fingerprint.load_state(spark.createDataFrame([("a", "{"), ("b", None), ("c", "[1]")], "k string, state string"), "k", "state").collect()
    assert all(r.digest is None and r.last_attempt_s == 0.0 and r.failed is False for r in bad)
    now = spark.createDataFrame([("a", *["q"] * 7)], "k string, " + ", ".join(f"{c} string" for c in part))
    reason = lambda t, manual=False: fingerprint.decide(fingerprint.load_state(kept, "k", "state"), now, "k", F.lit(t), manual).first().reason
    assert [reason(2000.0), reason(1000.0 + 6 * 3600), reason(2000.0, True)] == ["cooldown", "schema_changed", "manual_request"]


def test_texts_in_nested_json(spark):
    rows = ['{"a": "x", "b": ["y", 1, {"c": "q\\"u", "d": null}], "e": {}}', '["k", ":"]', '"alone"', "{}", "{broken", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(V.json_texts("j")).collect()]
    assert got == [["x", "y", 'q"u'], ["k", ":"], ["alone"], [], None, None, None]


def test_geometry_types(spark):
    rows = ['{"type": "MultiPolygon"}', '{"type": "Feature"}', '{"type": 3}', "[]", "no", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(geo.geometry_type(F.col("j"))).collect()]
    assert got == ["multipolygon", None, None, None, None, None]


def test_candidate_labels_clean_each_text_once(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the test tables aren't here")
    plan = records.candidate_labels(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
