import datetime as dt
import json

import pytest

from obslake.functions import units as U
from obslake.operators import schema_drift as S
from obslake.operators import unit_convert as C

UNITS = [(q, u) for q, u in U.CONVERSIONS]
LABELS = {"Air temperature": "air_temperature", "temperature": "air_temperature", "rain": "precipitation", "rain_total": "precipitation", "Feinstaub PM2.5": "pm2_5", "stage": "water_level", "pressure": "air_pressure", "PFOS": "pfos", "wind": "wind_speed"}


@pytest.mark.parametrize(
    ("metric", "value", "unit", "field", "label", "want"),
    [
        ("temperature", "54.2", "°F", None, None, ("air_temperature", 54.2, "degF", "unit")),
        (" AIR  temperature", "12,5 C", None, None, None, ("air_temperature", 12.5, "degC", "value")),
        ("rain in in", "0.4", None, None, None, ("precipitation", 0.4, "inch", "metric")),
        ("rain in centimetre", "0.4", None, None, None, ("precipitation", 0.4, "cm", "metric")),
        ("rain_total [l/m²]", "4", None, None, None, ("precipitation", 4.0, "mm", "metric")),
        ("Feinstaub PM2.5", "12,323.9nanograms per m3", None, None, None, ("pm2_5", 12323.9, "ng_m3", "value")),
        ("Feinstaub PM2.5", "3", "μg/m3", None, None, ("pm2_5", 3.0, "ug_m3", "unit")),
        ("stage", "7.1", None, "stage_ft", None, ("water_level", 7.1, "foot", "source_field")),
        ("stage", "2.1", None, "stage", "Lake Inn, values in m", ("water_level", 2.1, "metre", "record_label")),
        ("PFOS", "0.006", "MCG/L ", None, None, ("pfos", 0.006, "ug_l", "unit")),
        ("wind", "5 m·s⁻¹", None, None, None, ("wind_speed", 5.0, "m_s", "value")),
        ("pressure", '29.9 "Hg', None, None, None, ("air_pressure", 29.9, "inHg", "value")),
        ("pressure", "offline", "hPa", None, None, ("air_pressure", None, None, None)),
        ("mood", "7", "K", None, None, (None, 7.0, None, None)),
        (None, None, None, None, None, (None, None, None, None)),
    ],
)
def test_reading(metric, value, unit, field, label, want):
    assert U.ContextReader(UNITS, LABELS).read(metric, value, unit, field, label) == want


def test_plausible_units(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, "k", "u", "pressure", "p", str(101_000 + i), None, None, t0 + dt.timedelta(hours=i)) for i in range(50)]
    rows += [(100 + i, "l", "u", "temperature", "t", str(280 + i % 5), None, None, t0 + dt.timedelta(hours=i)) for i in range(50)]
    rows += [(200 + i, "m", "u", "temperature", "t", ("55.0" if i < 25 else "13.0"), None, None, t0 + dt.timedelta(hours=i)) for i in range(50)]
    rows += [(300, None, None, "temperature", None, "--", None, None, None), (301, None, None, None, None, None, None, None, None), (302, None, None, "temperature", None, "15", None, None, None)]
    df = spark.createDataFrame(rows, "obs_id long, stream_id string, unit_id string, metric string, source_field string, value string, unit string, record_label string, observed_at timestamp")
    ref = spark.createDataFrame([(q, u, int(f == (1.0, 0.0))) for (q, u), f in U.CONVERSIONS.items()], "quantity string, unit_code string, is_common int")
    lab = spark.createDataFrame(list(LABELS.items()), "metric_label string, quantity string")
    got = {r.obs_id: r for r in C.convert_units(df, ref, lab).collect()}
    assert len(got) == len(rows)
    assert {got[i].unit_code for i in range(50)} == {"Pa"} and abs(got[0].common_value - 1010) < 1e-6
    assert {got[100 + i].unit_code for i in range(50)} == {"kelvin"}
    assert [got[200 + i].unit_code for i in (0, 10, 40, 49)] == ["degF", "degF", "degC", "degC"]
    assert got[300].unit_code is None and got[301].quantity is None and got[302].unit_code == "degC"


def tables(spark, fields, prints):
    listed = spark.createDataFrame(fields, "dataset_id string, snapshot_no int, ordinal int, name string, label string, data_type string, description string")
    fp = spark.createDataFrame(prints, "dataset_id string, snapshot_no int, schema_json string")
    al = spark.createDataFrame([("int", "integer"), ("double", "number"), ("text", "text")], "data_type string, type_class string")
    return S.lifespans(S.snapshot_fields(listed, fp, al))


def test_changes_and_table(spark):
    f = lambda s, n, lab, ty="text", de=None: ("d", s, 0, n, lab, ty, de)
    fields = [f(1, "a", "A"), f(1, "b", "B", "int"), f(1, "c", "C"), f(1, "x", None, "text", "same"), f(1, "a", "A"), f(2, "a2", "A"), f(2, "b", "B!", " DOUBLE"), f(2, "y", None, "text", "same"), f(2, None, "q"), f(4, "A2", "A"), f(4, "b", "B", "double"), f(4, "y", None)]
    prints = [("d", 3, json.dumps([["a2", "text"], ["b", "double"], ["y", "text"], ["n", "int"]])), ("d", 2, json.dumps([["zz", "text"]])), ("e", 1, "broken")]
    spans = tables(spark, fields, prints)
    got = sorted((r.snapshot_no, r.old_name, r.new_name) for r in S.changes(spans).collect())
    assert got == [(2, "a", "a2"), (2, "b", "b"), (2, "c", ""), (2, "x", "y"), (3, "", "n"), (4, "", "A2"), (4, "a2", ""), (4, "n", "")]
    renamed = S.changes(spans).where("change = 'renamed'").select("dataset_id", "snapshot_no", "old_name", "new_name")
    rows = spark.createDataFrame([("d", 1, 1, '{"a": "p", "b": 3, "more": 1}'), ("d", 2, 1, '{"b": 3.5, "a2": null}'), ("d", 3, 1, "nonsense"), ("q", 1, 1, '{"k": 1}')], "dataset_id string, snapshot_no int, row_no int, payload string")
    out = {(r.dataset_id, r.snapshot_no): r.record for r in S.consistent_rows(rows, S.columns(spans, renamed)).collect()}
    assert out["d", 1]["a2"] == "p" and out["d", 1]["b"] == "3.0" and out["d", 1]["more"] == "1"
    assert out["d", 2] == {"a2": None, "b": "3.5", "y": None} and set(out["d", 3].values()) == {None} and out["q", 1] == {"k": "1"}


def test_no_snapshots(spark):
    assert S.changes(tables(spark, [], [])).count() == 0


def test_a_prior_is_blended_by_its_weight(spark):
    stated = lambda n: spark.createDataFrame([("air_temperature", 30.0 + i % 3) for i in range(n)] + [("new", 5.0 + i % 2) for i in range(n)], "quantity string, value double")
    means = [{r.quantity: r.mean for r in C.usual_values(stated(n), ["air_temperature", "new", "none"], C.PRIORS).collect()} for n in (2, 29, 30, 31, 3000)]
    temperature = [m["air_temperature"] for m in means]
    assert temperature == sorted(temperature) and temperature[0] < 16 < 30 < temperature[-1]
    assert abs(temperature[2] - temperature[1]) < 0.6 and abs(temperature[3] - temperature[2]) < 0.6
    assert all(m["new"] == pytest.approx(5.5, abs=0.1) and "none" not in m for m in means)


def test_units_of_streams_with_an_early_outlier_and_without_time(spark):
    t0 = dt.datetime(2025, 3, 1)
    unit = lambda i: 290.0 if i < 60 else 15.0
    rows = [(i, "k", "u", "temperature", "t", str(unit(i) + i % 4), None, None, t0 + dt.timedelta(hours=12 * i)) for i in range(120)]
    rows += [(500, "k", "u", "temperature", "t", "288", None, None, dt.datetime(1971, 1, 1)), (501, "k", "u", "temperature", "t", "16", None, None, None)]
    df = spark.createDataFrame(rows, "obs_id long, stream_id string, unit_id string, metric string, source_field string, value string, unit string, record_label string, observed_at timestamp")
    ref = spark.createDataFrame([(q, u, int(f == (1.0, 0.0))) for (q, u), f in U.CONVERSIONS.items()], "quantity string, unit_code string, is_common int")
    lab = spark.createDataFrame(list(LABELS.items()), "metric_label string, quantity string")
    got = {r.obs_id: r.unit_code for r in C.convert_units(df, ref, lab).collect()}
    assert [got[i] for i in range(120)] == ["kelvin"] * 60 + ["degC"] * 60
    assert got[500] == "kelvin" and got[501] == "degC"


def test_many_labels_longest_and_first():
    r = U.ContextReader(UNITS, LABELS)
    assert r.metric("max air temperature of rain") == ("air_temperature", None)
    assert r.metric("rain temperature") == ("precipitation", None)
    assert r.metric("training") == (None, None) and U.ContextReader([], {}).metric("x") == (None, None)


def test_fields_from_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "rain").mkdir()
    label = {b"label": b"Rain depth"}
    a = pa.schema([pa.field("site", pa.string()), pa.field("rain", pa.int64(), metadata=label), pa.field("flag", pa.bool_())])
    b = pa.schema([pa.field("site", pa.string()), pa.field("rain_mm", pa.int64(), metadata=label), pa.field("flag", pa.string())])
    for n, schema in enumerate((a, b)):
        pq.write_table(pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema), str(tmp_path / "rain" / f"{n}.parquet"))
    (tmp_path / "rain" / "2.parquet").write_bytes(b"not a footer at all")
    listed = S.footer_fields(spark, str(tmp_path))
    fingerprints = spark.createDataFrame([], "dataset_id string, snapshot_no int, schema_json string")
    aliases = spark.createDataFrame([("int64", "integer"), ("bool", "boolean"), ("string", "text")], "data_type string, type_class string")
    spans = S.lifespans(S.snapshot_fields(listed, fingerprints, aliases))
    got = sorted(tuple(r) for r in S.changes(spans).collect())
    assert got == [("rain", 2, "flag", "flag", "type_class"), ("rain", 2, "rain", "rain_mm", "renamed")]


def test_changes_of_islands_and_ties(spark):
    rows = [("d", n, "x", None, None, "text") for n in (1, 2, 4, 5)] + [("d", n, "keep", None, None, "text") for n in (1, 2, 3, 4, 5)]
    rows += [("d", 1, f"old{k}", "L", None, "text") for k in (1, 2, 3)] + [("d", 2, f"new{k}", "L", None, "text") for k in (1, 2)]
    rows += [("d", 2, "p", "A", "same", "text"), ("d", 3, "q", "B", "same", "text"), ("e", 7, "only", None, None, "text")]
    fields = spark.createDataFrame([(*r, 0, "text") for r in rows], "dataset_id string, snapshot_no int, name string, label string, description string, data_type string, ordinal int, type_class string")
    got = {tuple(r)[1:] for r in S.changes(S.lifespans(fields)).collect()}
    assert {(2, "old1", "new1", "renamed"), (2, "old2", "new2", "renamed"), (2, "old3", "", "removed"), (3, "p", "q", "renamed"), (3, "x", "", "removed"), (4, "", "x", "added")} <= got
    assert (2, "", "p", "added") in got and not any(r[1] == "only" for r in got)
    spans = {(r.snapshot_no, r.since, r.until) for r in S.lifespans(fields).where("name = 'x'").collect()}
    assert spans == {(1, 1, 2), (2, 1, 2), (4, 4, 5), (5, 4, 5)}
