"""Expected values of the analytics on small inputs, and random inputs against plain loops."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.operators import catalog, dependencies, fingerprint, geo, observations, portal, profile, sampling, series


def one(df):
    return df.first()


def test_long_rows_become_streams(spark):
    rows = [("A", "2025-01-01T00:00:00", " PM2.5 ", 5, "ug/m3", 0), ("A", "2025-01-01T01:00:00", "PM2.5", 7, "ug/m3", 1), ("A", "2025-01-01T01:00:00", "NO2", 3, "ppb", 2), ("", "2025-01-01T02:00:00", "NO2", 9, "ppb", 3), ("A", None, "NO2", 99, "ppb", 4)]
    df = spark.createDataFrame(rows, "station string, observed_at string, pollutant string, value bigint, unit string, n int").withColumn("observed_at", V.to_ts("observed_at"))
    roles = observations.Roles(unit=["station"], data=["value"], time="observed_at", seq=["n"], names=["pollutant"], unit_column=observations.unit_column(df.columns))
    got = {r.metric: (r.value, r.unit) for r in observations.latest(observations.to_points(df, roles), ["stream_id"]).collect()}
    assert got == {"PM2.5": (7.0, "ug/m3"), "NO2": (3.0, "ppb")}


def test_canonical_categories_and_keys(spark):
    df = spark.createDataFrame([(" 1 ", "Count", "a,\"é"), ("1.0", " count ", "b")], "a string, b string, c string")
    assert df.select(V.stream_id("a", "b")).distinct().count() == 1
    r = df.select(V.key_token("c", "b").alias("t")).select("t", V.key_parts("t").alias("p")).collect()
    assert [x.p for x in r] == [['a,"é', "Count"], ["b", " count "]] and all("=" not in x.t and x.t.startswith("v1:") for x in r)
    assert one(df.select(V.key_token("c", F.lit("")).alias("t"))).t is None


def test_number_predicates(spark):
    texts = ["7", " 7 ", "1e3", "nan", "inf", "1_000", "1d", "", None, "<5.2", "1,234.5", "N/A", "true", "-.5", "5."]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.to_number("t").alias("f"), V.is_number("t").alias("a"), V.to_dirty_number("t").alias("d")).orderBy("i").collect()
    assert [r.f for r in out] == [7, 7, 1000, None, None, None, None, None, None, None, None, None, None, -0.5, 5]
    assert [r.a for r in out] == [True, True, True, True, True, False, False, False, False, False, False, False, False, True, True]
    assert [r.d for r in out][9:12] == [5.2, 1234.5, None]


def test_times(spark):
    texts = ["2026-07-21T12:00:00Z", "1784635200000", "1784635200", "2026-07-21", "2026", "10:15", "2026-07-21T14:00:00+02:00", "x"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.to_ts("t")).collect()]
    noon = dt.datetime(2026, 7, 21, 12)
    assert out[0] == out[1] == out[2] == out[6] == noon and out[3] == dt.datetime(2026, 7, 21) and out[7] is None and out[5] is None
    looks = [r[0] for r in spark.createDataFrame([("2026-07-21",), ("2026/7/1 10:00",), ("2026-7",), ("Tuesday 21",), (None,)], "t string").select(V.looks_temporal("t")).collect()]
    assert looks == [True, True, False, False, False]


def test_chao1(spark):
    r = one(sampling.chao1(spark.createDataFrame([(x,) for x in ["A", "B", "C", "C", "", None]], "station string"), "station"))
    assert (r.observed, r.singletons, r.doubletons, r.estimated, r.sample_rows, r.confidence) == (3, 2, 1, 5, 4, 0.5)
    assert one(sampling.chao1(spark.createDataFrame([], "station string"), "station")).estimated == 0


def test_cadence_and_staleness(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=step * i)) for s, step in (("a", 5), ("b", 10), ("c", 60)) for i in range(30)]
    p = spark.createDataFrame(rows + rows[:7], "s string, ts timestamp")
    assert one(series.cadence_window(p, ["s"], "ts")).cadence_seconds == 29 * 10 * 60 / 30
    assert one(series.cadence_window(p.where("s = 'b'"), ["s"], "ts")).cadence_seconds == 29 * 10 * 60 / 30
    single = spark.createDataFrame([(t0 + dt.timedelta(minutes=15 * i),) for i in range(80)], "ts timestamp")
    gap = series.cadence_median_gap(single, "ts")
    assert one(gap).cadence_seconds == 900
    last = t0 + dt.timedelta(minutes=15 * 79)
    for minutes, want in ((74, False), (75, True)):
        assert one(series.freshness(single, "ts", F.lit(last + dt.timedelta(minutes=minutes)), gap)).stale is want
    assert one(series.freshness(single.limit(0), "ts", F.lit(last), series.cadence_median_gap(single.limit(0), "ts"))).stale is None


def test_buckets(spark):
    t = dt.datetime(2026, 1, 1, 10, 15)
    rows = [("s", t, 20.0), ("s", t + dt.timedelta(minutes=6), 22.0), ("s", t + dt.timedelta(minutes=46), 24.0), ("s", None, 1.0), ("s", t, None)]
    p = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    hourly = {r.bucket.hour: r.mean_value for r in series.bucket_stats(p, ["s"], "ts", "v", 60).collect()}
    assert hourly == {10: 21.0, 11: 24.0}
    assert sorted(r.bucket.minute for r in series.bucket_stats(p, ["s"], "ts", "v", 5).collect()) == [0, 15, 20]


def test_stratified_sample_against_the_loop(spark):
    rng = random.Random(9)
    for trial in range(4):
        rows = [(i, rng.choice(["a", "b", "c", "dd", None]), rng.choice([None, *range(12)])) for i in range(rng.randrange(1, 50))]
        cap = rng.choice([1, 5, 17, 100])
        df = spark.createDataFrame(rows, "seq int, e string, ts int")
        got = sorted(r.seq for r in sampling.stratified_sample(df, "e", "ts", "seq", cap).collect())
        groups = defaultdict(list)
        for s, e, t in rows:
            groups[e or ""].append((t is None, t or 0, s))
        for g in groups.values():
            g.sort()
        chosen = []
        while any(groups.values()) and len(chosen) < cap:
            for e in sorted(groups):
                if groups[e] and len(chosen) < cap:
                    chosen.append(groups[e].pop()[2])
                if groups[e] and len(chosen) < cap:
                    chosen.append(groups[e].pop(0)[2])
        assert got == sorted(chosen), (trial, cap)


def test_ordering(spark):
    def kind(times, entities):
        rows = [(i, t, e) for i, (t, e) in enumerate(zip(times, entities))]
        return one(sampling.physical_ordering(spark.createDataFrame(rows, "n long, t int, e string"), "n", "t", "e")).ordering

    assert kind(range(8), "AABBCCDD") == "time_ascending" and kind(range(8, 0, -1), "AABBCCDD") == "time_descending"
    assert kind([None] * 6, "AAABBB") == "entity_grouped" and kind([None] * 6, "ABCABC") == "effectively_random"
    assert kind([1, 2, 3], "ABC") == "unknown"


def test_previous_row_over_ranges(spark):
    rows = [(i * i, i) for i in range(200)]
    got = sampling.with_previous(spark.createDataFrame(rows, "n long, v int"), "n", ["v"], shards=7).orderBy("n").collect()
    assert [r.prev_v for r in got] == [None, *range(199)]


def test_dependencies_against_loops(spark):
    rng = random.Random(12)
    for _ in range(3):
        rows = [(f"s{k}", ("x" if rng.random() < 0.02 else f"d{k % 5}"), f"c{k % 5 % 2}", rng.choice(["", None, "m", "n"])) for k in (rng.randrange(20) for _ in range(150))]
        fields = ["station", "district", "city", "other"]
        df = spark.createDataFrame(rows, "station string, district string, city string, other string")
        got = {(r.determinant, r.dependent): (r.determinant_values, r.dependent_values, round(r.confidence, 9)) for r in dependencies.functional_dependencies(df, fields, least_confidence=0.7).collect()}
        want = {}
        for a in range(4):
            for b in range(4):
                groups = defaultdict(set)
                for r in rows:
                    if a != b and r[a] and r[b]:
                        groups[r[a]].add(r[b])
                if len(groups) >= 2 and len(set().union(*groups.values())) > 1:
                    c = sum(len(x) == 1 for x in groups.values()) / len(groups)
                    if c >= 0.7:
                        want[fields[a], fields[b]] = (len(groups), len(set().union(*groups.values())), round(c, 9))
        assert got == want


def test_nested_dimensions_are_direct(spark):
    rows = [(f"s{i}", f"w{i // 2}", f"b{i // 4}", f"{d}") for i in range(16) for d in range(3)]
    df = spark.createDataFrame(rows, "station string, watershed string, basin string, day string")
    got = {(r.child, r.parent): (r.parent_values, r.child_values) for r in dependencies.dimension_relationships(df, ["station", "watershed", "basin"]).collect()}
    assert got == {("station", "watershed"): (8, 16), ("watershed", "basin"): (4, 8)}
    assert dependencies.dimension_relationships(df, ["station"]).count() == 0


def test_shapes_and_structure(spark):
    t = [f"2025-01-0{1 + i // 4}T00:00:00" for i in range(16)]
    wide = spark.createDataFrame([(f"s{i % 4}", t[i], 1.5 + i % 3, 2.5 + i % 5, ["ozone", "pm25"][i // 4 % 2]) for i in range(16)], "station string, observed_at string, pm25 double, ozone double, largest_pollutant string")
    s = profile.observation_shape(wide, wide.columns, "station", "observed_at")
    assert s["shape"] == "wide" and s["metrics"] == ["pm25", "ozone"] and s["roles"]["largest_pollutant"] == "changing_nominal"
    long = spark.createDataFrame([(f"s{i % 4}", t[i], ["ozone", "pm25"][i // 2 % 2], 1.5 + i, "ppb") for i in range(16)], "station string, observed_at string, pollutant string, value double, unit string")
    assert profile.observation_shape(long, long.columns, "station", "observed_at")["shape"] == "long"
    found = profile.dataset_structure(wide)
    assert found["kind"] == "time_series" and found["identity"] == "station" and found["time"] == "observed_at"
    ids = spark.createDataFrame([(f"m{i}", f"b{i % 3}", t[i], float(i % 5)) for i in range(16)], "measurement_id string, beach_name string, measurement_timestamp string, turbidity double")
    assert profile.dataset_structure(ids)["identity"] == "beach_name"


def test_catalog(spark):
    rows = [(1, "Hourly air quality", "pm2.5 by sensor", "timestamp station pm25"), (2, "Payroll archive", "", None), (3, "Budget", None, "")]
    df = catalog.score(spark.createDataFrame(rows, "id int, title string, description string, fields string"), "title", "description", "fields")
    got = {r.id: r.score for r in df.collect()}
    assert got[1] == 35 + 35 + 16 + 14 + 10 + 12 + 6 * 0 + 10 + 20 + 6 and got[2] == -35 - 15 and got[3] == -20
    assert [r.id for r in catalog.rank(df, "title").collect()] == [1]
    assert [r.id for r in catalog.search(df, "AIR Sensor", "title", "description").collect()] == [1]
    res = spark.createDataFrame([("p", "a", "CSV", True, "2024"), ("p", "b", "csv", True, "2025"), ("p", "c", "GeoJSON", False, "2026"), ("q", "d", "GeoJSON", False, None), ("r", "e", "pdf", False, None)], "package string, resource_id string, format string, active boolean, modified string")
    assert {r.package: r.resource_id for r in catalog.choose_resource(res, "package").collect()} == {"p": "b", "q": "d"}


def test_locations(spark):
    rows = [("far", "43.0", "-83"), ("near", "42.3", "-83.7"), ("none", None, None), ("bad", "", "")]
    df = spark.createDataFrame(rows, "name string, lat string, lon string")
    out = geo.rank_locations(df, "lat", "lon", (42.28, -83.74), ["name"]).collect()
    assert [r.name for r in out] == ["near", "far", "bad", "none"] and abs(out[0].distance_km - 3.97) < 0.1
    wrong = df.union(spark.createDataFrame([("x", "995", "1")], df.schema))
    assert [r.distance_km for r in geo.rank_locations(wrong, "lat", "lon", (42.28, -83.74), ["name"]).collect()] == [None] * 5
    p = spark.createDataFrame([('{"type": "Point", "coordinates": [-83.7, 42.3]}',), ("x",), (None,), ('{"type": "Point", "coordinates": [500, 42]}',)], "g string")
    assert [r[0] and tuple(r[0]) for r in p.select(geo.geojson_point(F.col("g"))).collect()] == [(42.3, -83.7), None, None, None]


def test_portal_addresses(spark):
    urls = ["https://data.x.gov/dataset/trees/resource/r1?a=1", "https://data.x.gov/api/3/action/package_show?id=trees", "https://data.x.gov/api/3/action/datastore_search?resource_id=r9", "https://data.y.org/resource/ABCD-12ef.json", "https://data.y.org/Health/Name/ab12-cd34/about", "https://data.y.org/api/catalog/v1", "https://z.org/", "https://z.org/fr/catalogue/?page=2", "ftp://z", "trees"]
    out = portal.parse_reference(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string"), "u").orderBy("i").collect()
    got = [(r.ref_provider, r.ref_dataset, r.ref_resource, r.ref_is_portal) for r in out]
    assert got == [("ckan", "trees", "r1", False), ("ckan", "trees", None, False), ("ckan", None, "r9", False), ("socrata", "abcd-12ef", None, False), ("socrata", "ab12-cd34", None, False), ("socrata", None, None, True), (None, None, None, True), (None, None, None, True), (None, None, None, None), (None, None, None, None)]
    assert out[7].ref_portal == "https://z.org/fr/catalogue/?page=2"
    html = r'<a href="https://a.org/x?y=1">x</a> <script>"u":"https:\/\/b.org\/data"</script> see https://c.org/path. <a href="/rel">'
    assert spark.createDataFrame([(html,)], "h string").select(portal.page_links(F.col("h"))).first()[0] == ["https://a.org/x", "https://c.org/path", "https://b.org/data"]


def test_fingerprint_and_decisions(spark):
    df = spark.createDataFrame([(" A ",), ("a",), ("b",), ("",), (None,)], "d string")
    f = one(fingerprint.fingerprint(df, [("d", "text")], {"d": "x"}, [], ["d"]))
    assert f.dimensions == "d=a|b" and len(f.digest) == 64
    part = "digest string, schema string, roles string, metrics string, dimensions string, coordinates string, ordering string"
    now = spark.createDataFrame([(k, "n", s, "", "", "", "", "") for k, s in (("new", "s"), ("same", "s"), ("cool", "s"), ("failed", "s"), ("schema", "t"))], "key string, " + part)
    old = spark.createDataFrame([("same", "n", "s", "", "", "", "", "", 0, False), ("cool", "o", "q", "", "", "", "", "", 95_000, False), ("failed", "o", "s", "r", "", "", "", "", 70_000, True), ("schema", "o", "s", "", "", "", "", "", 0, False)], "key string, " + part + ", last_attempt_s long, failed boolean")
    got = {r.key: (r.should_run, r.reason) for r in fingerprint.decide(old, now, "key", F.lit(100_000)).collect()}
    assert got == {"new": (True, "initial_analysis"), "same": (False, "unchanged"), "cool": (False, "cooldown"), "failed": (True, "field_roles_changed"), "schema": (True, "schema_changed")}


def test_labels(spark):
    df = spark.createDataFrame([(1, "x", "n", None), (2, "x", None, None), (3, "y", "n", "m")], "id int, label string, h1 string, h2 string")
    assert {r.id: r.unique_label for r in observations.disambiguate(df, "label", "id", ["h1", "h2"]).collect()} == {1: "x — n", 2: "x — 2", 3: "y"}
