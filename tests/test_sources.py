import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from obslake.sources import files, portals


def record(folder, answers):
    for url, answer in answers.items():
        (folder / portals.recorded_name(url)).write_text(json.dumps(answer), encoding="utf-8")


def load(spark, folder, **options):
    spark.dataSource.register(portals.PortalDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("portal").options(recorded=str(folder), **options).load()


ROWS = [{"station": s, "value": v} for s, v in (("a", 1), ("b", None), ("a", 2.5))]


@pytest.mark.parametrize("provider", ["ckan", "socrata", "arcgis", "opendatasoft"])
def test_records(spark, tmp_path, provider):
    portal, dataset = "https://data.example", "https://data.example/layer/0" if provider == "arcgis" else "abcd-1234"
    p = portals.PROVIDERS[provider](portal, dataset)
    meta = {
        "ckan": {"result": {"total": 3, "fields": [{"id": "_id", "type": "int"}, {"id": "station", "type": "text", "info": {"label": "Station"}}, {"id": "value", "type": "numeric"}]}},
        "socrata": {"columns": [{"fieldName": "station", "name": "Station", "dataTypeName": "text"}, {"fieldName": "value", "dataTypeName": "number"}, {"fieldName": ":@computed"}]},
        "arcgis": {"fields": [{"name": "station", "alias": "Station", "type": "esriFieldTypeString"}, {"name": "value", "type": "esriFieldTypeDouble"}]},
        "opendatasoft": {"fields": [{"name": "station", "label": "Station", "type": "text"}, {"name": "value", "type": "double"}]},
    }[provider]

    def page(rows):
        return {"ckan": {"success": True, "result": {"total": 3, "records": rows}}, "socrata": rows, "arcgis": {"features": [{"attributes": r} for r in rows]}, "opendatasoft": {"total_count": 3, "results": rows}}[provider]

    def count(n):
        return {"ckan": {"success": True, "result": {"total": n}}, "socrata": [{"n": str(n)}], "arcgis": {"count": n}, "opendatasoft": {"total_count": n}}[provider]

    record(tmp_path, {p.count_url({}): count(3), p.rows_url(0, 2, {}, None): page(ROWS[:2]), p.rows_url(2, 1, {}, None): page(ROWS[2:]), p.count_url({"station": "a"}): count(2), p.rows_url(0, 2, {"station": "a"}, None): page([ROWS[0], ROWS[2]])})
    if provider == "ckan":
        meta["result"]["total"] = 3
    record(tmp_path, {p.schema_url(): meta})
    df = load(spark, tmp_path, provider=provider, portal=portal, dataset=dataset, pageRows="2")
    assert df.columns == ["station", "value"] and df.schema["station"].metadata["label"] == "Station"
    assert sorted(map(tuple, df.collect()), key=str) == [("a", "1"), ("a", "2.5"), ("b", None)]
    assert sorted(map(tuple, df.where("station = 'a'").collect())) == [("a", "1"), ("a", "2.5")]


def test_catalogs(spark, tmp_path):
    portal = "https://data.example"
    answers = {
        "ckan": lambda i: {"result": {"count": 2, "results": [{"name": f"d{i}", "title": f"T{i}", "notes": "n"}]}},
        "socrata": lambda i: {"resultSetSize": 2, "results": [{"resource": {"id": f"d{i}", "name": f"T{i}"}}]},
        "arcgis": lambda i: {"numberMatched": 2, "features": [{"id": f"d{i}", "properties": {"title": f"T{i}"}}]},
        "opendatasoft": lambda i: {"total_count": 2, "results": [{"dataset_id": f"d{i}", "metas": {"default": {"title": f"T{i}"}}}]},
    }
    for provider, answer in answers.items():
        p = portals.PROVIDERS[provider](portal, None)
        record(tmp_path, {p.catalog_url(i, 1, "rain"): answer(i) for i in range(2)})
        df = load(spark, tmp_path, provider=provider, portal=portal, query="rain", pageRows="1")
        assert sorted((r.dataset_id, r.title) for r in df.collect()) == [("d0", "T0"), ("d1", "T1")]


def test_names_and_hosts():
    for url in ("http://127.0.0.1/x", "http://10.0.0.1", "ftp://example.org", "http://localhost/", "http://user@example.org/", "http://[::1]/", "nonsense"):
        with pytest.raises(ValueError):
            portals.public_url(url, resolve=False)
    assert portals.public_url("https://8.8.8.8/x", resolve=False)
    with pytest.raises(ValueError):
        portals.Socrata("https://x", "d").rows_url(0, 1, {"a; drop": "1"}, None)
    assert "o%27%27clock" in portals.Socrata("https://x", "d").count_url({"a": "o'clock"})
    with pytest.raises(NotImplementedError):
        portals.Capabilities(distinct=False).require("distinct")


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,note,v\r\n"A, b","line\nbreak ""q""",1\r\nshort\r\n'.encode())
    got = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns[1:] == ["note", "v"] and [tuple(r) for r in got.collect()] == [("A, b", 'line\nbreak "q"', "1"), ("short", "", "")]
    rows = [(1, '[{"id": "x", "k": 1}]'), (2, '{"features": [{"properties": {"k": 2}, "geometry": {"type": "Point"}}]}'), (3, '{"data": [{"attributes": {"k": "3"}}]}'), (4, "broken"), (5, None), (6, '{"k": 1}')]
    out = files.envelope_rows(spark.createDataFrame(rows, "n int, p string"), "p", {"k": "bigint"})
    assert sorted((r.n, r.k) for r in out.collect()) == [(1, 1), (2, 2), (3, 3)]
    assert {r.n: r.feature_id for r in out.collect()}[1] == "x"


def archive(names):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return b.getvalue()


def test_gtfs(spark):
    full = ["agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt"]
    rows = [(1, archive([*full, "calendar.txt"])), (2, archive(["feed/" + n.upper() for n in full] + ["feed/calendar_dates.txt"])), (3, archive(full)), (4, archive(full[1:] + ["calendar.txt"])), (5, b"no archive"), (6, None)]
    out = {r.n: r for r in files.gtfs_validate(spark.createDataFrame(rows, "n int, content binary"), "content").collect()}
    assert [out[i].is_valid for i in range(1, 7)] == [True, True, False, False, False, False]
    assert out[4].missing == ["agency.txt"] and out[2].nested and not out[1].nested


def test_corpus_ids(spark):
    df = spark.createDataFrame([("p", "ckan", "d", "x" * 500), ("p", None, "d", None)], "portal string, provider string, dataset string, t string")
    a, b = files.corpus_entries(df, ["portal", "provider", "dataset"], "t", 160).orderBy(F.desc("t")).collect()
    import hashlib

    assert a.corpus_id == hashlib.sha256(b"p\nckan\nd").hexdigest()[:20] and len(a.bounded_text) == 160 and b.bounded_text is None


@pytest.mark.parametrize("split", ["40", "97", "1000000"])
def test_csv_in_splits(spark, tmp_path, split):
    import csv
    import random

    rng = random.Random(3)
    cell = lambda: rng.choice(["", "plain", 'say "hi"', "two\nlines", "a,b", "x" * 30 + "\n" + "y" * 90, '"', "é€"])
    want = []
    for k in range(3):
        rows = [[f"{k}-{i}", cell(), cell()] for i in range(60)]
        want += rows
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n" if k else "\r\n")
            w.writerow(["id", "a", "b"])
            w.writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = files.read_csv(spark, str(tmp_path))
        assert df.columns == ["id", "a", "b"]
        assert sorted(map(list, df.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_odd_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2,3\n\n4\n,\n", encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [("", ""), ("1", "2"), ("4", "")]
    (tmp_path / "b.csv").write_text("", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "b.csv")).count() == 0


@pytest.mark.parametrize("provider", ["ckan", "socrata", "arcgis", "opendatasoft"])
def test_distinct_values(spark, tmp_path, provider):
    portal, dataset = "https://data.example", "https://data.example/layer/0" if provider == "arcgis" else "abcd-1234"
    p = portals.PROVIDERS[provider](portal, dataset)
    fields = {
        "ckan": {"result": {"fields": [{"id": "site"}, {"id": "area"}, {"id": "v"}]}},
        "socrata": {"columns": [{"fieldName": c} for c in ("site", "area", "v")]},
        "arcgis": {"fields": [{"name": c} for c in ("site", "area", "v")]},
        "opendatasoft": {"fields": [{"name": c} for c in ("site", "area", "v")]},
    }[provider]
    rows = [{"site": "a", "area": "x"}, {"site": "b", "area": "x"}]
    answer = {"ckan": {"result": {"records": rows}}, "socrata": rows, "arcgis": {"features": [{"attributes": r} for r in rows]}, "opendatasoft": {"results": rows}}[provider]
    record(tmp_path, {p.schema_url(): fields, p.distinct_url(["site", "area"], 1000): answer})
    df = load(spark, tmp_path, provider=provider, portal=portal, dataset=dataset, distinct="site,area", maxRows="5000")
    assert df.columns == ["site", "area"] and sorted(map(tuple, df.collect())) == [("a", "x"), ("b", "x")]
    with pytest.raises(Exception, match="no such fields"):
        load(spark, tmp_path, provider=provider, portal=portal, dataset=dataset, distinct="nope").columns


def test_catalogs_that_stand_in(spark, tmp_path):
    portal = "https://data.example"
    s, a = portals.Socrata(portal, None), portals.ArcGis(portal, None)
    record(tmp_path, {s.other_catalog_url(0, 10, None): {"resultSetSize": 1, "results": [{"resource": {"id": "d", "name": "T"}}]}})
    assert [r.dataset_id for r in load(spark, tmp_path, provider="socrata", portal=portal, pageRows="10").collect()] == ["d"]
    feed = {"dataset": [{"identifier": i, "title": i} for i in ("x", "y", "x")] + ["odd"]}
    record(tmp_path, {a.other_catalog_url(0, 2, None): feed})
    df = load(spark, tmp_path, provider="arcgis", portal=portal, pageRows="2")
    assert sorted(r.dataset_id for r in df.collect()) == ["x", "x", "y"]
    assert [r.dataset_id for r in portals.distinct_catalog(df).collect()] == ["x", "y"]
    assert [r.dataset_id for r in portals.distinct_catalog(df, 1).collect()] == ["x"]
    with pytest.raises(Exception, match="(?i)no such file|FileNotFound"):
        load(spark, tmp_path, provider="ckan", portal="https://other.example").collect()


def test_dataset_of_a_resource():
    c = portals.Ckan("https://data.example", None)
    assert "resource_show" in c.package_url(" r1 ") and "r1" in c.package_url(" r1 ")
    assert c.package({"result": {"package_id": " p "}}) == "p"
    for bad in ({}, {"result": None}, {"result": {"package_id": " "}}):
        with pytest.raises(ValueError):
            c.package(bad)
    assert [portals.clamped(x, 5) for x in (-1, 0, 3, 9)] == [1, 1, 3, 5]


def test_shared_snapshot(spark, tmp_path):
    calls = []

    def read():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "snap")
    n = [files.shared_snapshot(spark, path, read, t, 900, force).count() for t, force in ((1000, False), (1500, False), (1900, False), (1901, False), (1902, True), (2000, False))]
    assert n == [1, 1, 1, 2, 3, 3] and len(list((tmp_path / "snap").glob("at=*"))) == 2
