import datetime as dt

from obslake.functions import units as U
from obslake.operators import unit_convert as C


def test_rows_without_time_are_judged_apart(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, "m", "u", "temperature", "t", "55.0" if i < 25 else "13.0", None, None, t0 + dt.timedelta(hours=i)) for i in range(50)]
    rows += [(100 + i, "m", "u", "temperature", "t", "280.0", None, None, None) for i in range(5)]
    rows += [(200 + i, "n", "u", "temperature", "t", "280.0", None, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "obs_id long, stream_id string, unit_id string, metric string, source_field string, value string, unit string, record_label string, observed_at timestamp")
    ref = spark.createDataFrame([(q, u, int(f == (1.0, 0.0))) for (q, u), f in U.CONVERSIONS.items()], "quantity string, unit_code string, is_common int")
    lab = spark.createDataFrame([("temperature", "air_temperature")], "metric_label string, quantity string")
    got = {r.obs_id: r.unit_code for r in C.convert_units(df, ref, lab).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in (0, 10, 40, 49)] == ["degF", "degF", "degC", "degC"]
    assert {got[i] for i in got if i >= 100} == {"kelvin"}
