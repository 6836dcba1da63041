from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.operators import catalog, inspection
from obslake.sources import files


def test_explorer_and_inspection(spark):
    rows = [(i, f"s{i % 6}", f"c{i % 6 // 3}", f"2025-01-{1 + i // 6:02d}T00:00:00", 1.5 + i % 7, 2.5 + i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, station string, county string, observed_at string, pm25 double, ozone double")
    e = inspection.explorer_summary(df.drop("row_id"))
    assert (e["structure"]["identity"], e["structure"]["time"], e["row_count"], e["distinct_primary_records"]) == ("station", "observed_at", 120, 6)
    assert [(r["child"], r["parent"]) for r in e["relationships"]] == [("station", "county")] and e["requires_confirmation"]
    f = inspection.inspect_dataset(df, "row_id", 12)
    assert {(r.station, r.observed_at) for r in f["sample"].collect()} == {(f"s{k}", f"2025-01-{x}T00:00:00") for k in range(6) for x in ("01", "20")}
    assert f["sampling_evidence"].asDict() | {"first_time": 0, "last_time": 0} == {"requested": 12, "source_rows": 120, "sampled_rows": 12, "entities": 6, "times": 2, "first_time": 0, "last_time": 0, "truncated": True}
    assert ("station", "county") in [(r["determinant"], r["dependent"]) for r in f["historical_relationships"]] and f["observation_model"]["shape"] == "wide"
    assert {"requires_confirmation", "sample.sampled_rows", "model.shape"} <= {k for k, _ in inspection.report(f)}
    assert inspection.inspect_dataset(spark.createDataFrame([(1, "x")], "row_id long, note string"), "row_id")["sampling_evidence"]["sampled_rows"] == 1


def test_profiles_by_metadata(spark):
    p = spark.createDataFrame([("air", 1, "core", "pm"), ("air", 1, "core", "no2"), ("air", 1, "support", "wind"), ("water", 2, "core", "level")], "profile_id string, profile_order int, kind string, metric_id string")
    m = spark.createDataFrame([("a", "pm"), ("b", "wind"), ("d", "level"), ("e", "wind")], "id string, metric_id string")
    meta = spark.createDataFrame([("a", "Air Quality, smog", True), ("b", "AIR QUALITY and smog", True), ("c", "river flood air quality", False), ("d", "nothing", True), ("f", "smog and air quality", True), ("g", None, False)], "id string, text string, has_fields boolean")
    terms = spark.createDataFrame([("air", "air quality"), ("air", "smog"), ("air", "AQI"), ("water", "river"), ("water", "flood")], "profile_id string, term string")
    got = {r.id: (r.profile_id, r.confidence) for r in catalog.match_profiles(m, ["id"], p, meta, terms).collect()}
    assert got == {"a": ("air", 0.475), "b": ("air", 0.1575), "c": ("water", 0.35), "d": ("water", 0.65)}
    assert {r.id for r in catalog.match_profiles(m, ["id"], p).collect()} == {"a", "d"}


def test_corpus_bounds(spark):
    df = spark.range(7).select(F.create_map(F.lit("k" * 200), F.struct(F.array_repeat(F.lit("x" * 500), 12).alias("l"), F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(i.cast("string").alias("a"), i.alias("b")))).alias("m"))).alias("r")).agg(F.collect_list("r").alias("rows"))
    rows = files.bounded_rows(df, "rows").first()["rows"]
    assert len(rows) == 5 and list(rows[0]) == ["k" * 120]
    v = rows[0]["k" * 120]
    assert len(v["l"]) == 10 and {len(x) for x in v["l"]} == {160} and set(v["m"]) == {str(i) for i in range(1, 21)}
    same = spark.sql("select array(map(repeat('k', 120) || 'a', 1, repeat('k', 120) || 'b', 2)) as rows")
    assert files.bounded_rows(same, "rows").first()["rows"] == [{"k" * 120: 2}]


def test_common_fields(spark):
    rows = [(e, f"F {n}") for n in range(60) for e in range(60 - n)] + [(0, "f 0"), (0, "F 0")]
    got = files.common_fields(spark.createDataFrame(rows, "e int, name string"), ["e"], "name", V.corpus_identifier).collect()
    assert len(got) == 50 and (got[0].field_name, got[0].n, got[0].unique_field_names) == ("f_0", 61, 60) and got[-1].n == 11
