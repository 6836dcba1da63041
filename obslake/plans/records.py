"""Queries of records, sources, sinks and catalogs as whole pipelines, beside those of the analytics."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslake.functions import values as V
from obslake.operators import catalog, fingerprint, geo, observations, portal, roles, sinks
from obslake.plans.problems import TIME_TABLES
from obslake.plans.reference import EVENTS, LINES, PROFILES, ontology_mapping
from obslake.sources import files
from obslake.streaming import refresh
from obslake.tables import shared_folder, table, union_all

READINGS = observations.Roles(unit=["unit_id"], data=["value"], time="observed_at", seq=["obs_id"], names=["metric"], record_keys=["unit_id", "stream_id"], record_labels=["record_label"])
SOURCE_TABLES = {n: x[1] for n, x in TIME_TABLES.items() if x[1]}


def record_points(spark: SparkSession, d: str) -> DataFrame:
    """The latest point per unit, metric and measuring unit, with its record's token and label; the unit column is found by name."""
    o = table(spark, d, "semantic_observation")
    points = observations.to_points(o, observations.with_unit_column(READINGS, o.columns))
    return observations.latest(points, ["unit_id", "metric", "unit"], ["value_text", "record_id", "record_label"])


def stream_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every stream's latest value with the span of its 250 latest points. 250 is the window of a refresh."""
    points = observations.to_points(table(spark, d, "events"), EVENTS)
    return observations.assembled(points, ["user_id", "event_type"]).select("user_id", "event_type", "ts", "value", "history_start", "history_end", "history_points")


def wide_states(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of each supplier's latest row."""
    measures = table(spark, d, "lineitem").withColumns({f"order_{i}": F.col(c) for i, c in enumerate([LINES.time, *LINES.seq])})
    return observations.latest_fields(measures, LINES.unit, LINES.data, [f"order_{i}" for i in range(len(LINES.seq) + 1)])


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return union_all([table(spark, d, n).select(F.lit(n).alias("source_table"), F.col(c).alias("source_name"), "ingested_at") for n, c in SOURCE_TABLES.items()])


def source_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether each registered source has data, and its newest arrival in microseconds."""
    out = sinks.status(table(spark, d, "source_registry"), _arrivals(spark, d), ["source_table", "source_name"], "ingested_at")
    return out.select("source_table", "source_name", "status", "rows", F.unix_micros("latest").alias("latest_us"))


def snapshot_tick(spark: SparkSession, d: str) -> DataFrame:
    """One tick over three sources and one that fails: rows per source that could be read."""
    rows, _ = refresh.snapshot({**{n: (lambda n=n, c=c: table(spark, d, n).select(F.col(c).alias("name"))) for n, c in SOURCE_TABLES.items()}, "gone": lambda: table(spark, d, "no_such_table")})
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("name").alias("names"))


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as CSV files, with quotes and line breaks in their texts, and read again in splits."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    columns = ["doc_id", "lang", "source", "text"]
    table(spark, d, "documents").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.length("text").alias("length"), F.md5("text").alias("digest"))


def json_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON envelopes in text files, one a line."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    table(spark, d, "events").select(F.concat(F.lit('{"results": [{"id": '), F.col("event_id").cast("string"), F.lit(', "properties": '), "props", F.lit("}]}"))).write.text(path)
    return files.envelope_rows(files.read_json(spark, path, lines=True), "payload", {"k": "bigint"}).select(F.col("feature_id").cast("bigint").alias("event_id"), "k")


@F.pandas_udf(T.BinaryType())
def _archive(names: pd.Series) -> pd.Series:
    def pack(members: list[str]) -> bytes:
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in members:
                z.writestr(n, "x")
        return b.getvalue()

    return names.map(pack)


def gtfs_check(spark: SparkSession, d: str) -> DataFrame:
    """An archive per portal, some nested, in capitals, without a table or a calendar."""
    n = F.length("portal_id")
    tables = F.array(*[F.lit(x) for x in files.GTFS_REQUIRED])
    members = F.when(n % 6 == 5, tables).otherwise(F.array_remove(tables, F.get(tables, (n % 6).cast("int"))))
    members = F.when(n % 2 == 0, F.array_append(members, "calendar.txt")).otherwise(members)
    named = F.transform(members, lambda x: F.when(F.col("provider") == "ckan", F.concat(F.lit("Feed/"), F.upper(x))).otherwise(x))
    out = files.gtfs_validate(table(spark, d, "portal").select("portal_id", _archive(named).alias("content")), "content")
    return out.select("portal_id", F.array_join("missing", "|").alias("missing"), "has_calendar", "nested", "is_valid")


def distinct_records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct places of the monitors, in order; the limit asked for is above what is allowed."""
    return observations.distinct_rows(table(spark, d, "ann_arbor_air_quality"), "location_name", ["lat", "lon"], 5000)


def _packs(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "metric_alias").select(F.col("metric_label").alias("alias"), F.col("quantity").alias("metric_id"), F.lit(0).alias("metric_order"))
    return catalog.merge_packs([("base", 1, labels.where(~F.col("alias").rlike("[^ -~]"))), ("international", 1, labels)])


def language_packs(spark: SparkSession, d: str) -> DataFrame:
    """The ontology with its language packs merged."""
    return _packs(spark, d).select("alias", "metric_id", "language")


def international_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Fields of any script on metrics, by names in compatibility form."""
    fields = table(spark, d, "open_data_field").select("dataset_id", "name", "label", "description").distinct()
    return catalog.map_fields(fields, ["dataset_id"], _packs(spark, d), V.unicode_identifier).select("dataset_id", "name", "metric_id", "confidence", "matched_by")


def retained_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of each dataset's last listed fields; those reviewed one listing before stay."""
    f = table(spark, d, "open_data_field").where("name is not null").select("dataset_id", "snapshot_no", "name", F.lower(F.trim("data_type")).alias("t")).distinct()
    snaps = f.select("dataset_id", "snapshot_no").distinct().groupBy("dataset_id").agg(F.sort_array(F.collect_set("snapshot_no"), asc=False).alias("s"))
    both = f.join(F.broadcast(snaps), "dataset_id")
    role = F.when(F.col("t").rlike("date|time"), "time").when(F.col("t").rlike("number|double|int|float|numeric|decimal"), "data").otherwise("descriptive")
    reviewed = both.where(F.col("snapshot_no") == F.get("s", F.lit(1))).select("dataset_id", "name", role.alias("role"))
    return roles.retained_roles(both.where(F.col("snapshot_no") == F.get("s", F.lit(0))), reviewed, ["dataset_id"])


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the documents that score as candidates: score, title, first reasons."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), "source", "text")
    scored = catalog.score(docs, "source", "text", cleaned="cleaned").where("score >= 20")
    # the label has the reasons twice: found once per row, in the text that was cleaned for the score
    told = scored.select("doc_id", "score", "title", F.inline(F.array(F.struct(catalog.reasons(F.col("cleaned"), catalog.ENVIRONMENT_TERMS).alias("why")))))
    return told.select("doc_id", catalog.candidate_label(F.col("score"), F.col("title"), F.col("why")).alias("label"))


TERMS = [("weather", "temperature"), ("weather", "wind"), ("air", "ozone"), ("air", "particles"), ("water", "water"), ("water", "flow")]


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Of each dataset's last listed snapshot: its fields' names and descriptions as texts. A snapshot has as many fields as columns."""
    f = table(spark, d, "open_data_field").where("name is not null")
    last = f.groupBy("dataset_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    one = f.join(last, ["dataset_id", "snapshot_no"]).groupBy("dataset_id", "snapshot_no")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.lower(c))), " ")
    return one.agg(joined("name").alias("fields"), joined("description").alias("description"), F.max("captured_at").alias("captured_at"))


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(PROFILES, "profile_id string, profile_order int, kind string, metric_id string")
    terms = spark.createDataFrame(TERMS, "profile_id string, term string")
    metadata = _described(spark, d).select("dataset_id", F.col("description").alias("text"), (F.col("fields") != "").alias("has_fields"))
    return catalog.match_profiles(ontology_mapping(spark, d), ["dataset_id"], p, metadata, terms)


def described_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each dataset by its fields and by terms in their descriptions."""
    return _profiled(spark, d)


def scored_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Datasets scored by their texts, fields, files, quality and the confidence of their profile."""
    files_ = table(spark, d, "open_data_row").groupBy("dataset_id").agg(F.min("file_name").alias("resource"))
    df = _described(spark, d).join(files_, "dataset_id", "left").join(_profiled(spark, d).select("dataset_id", "confidence"), "dataset_id", "left")
    view = F.when(F.length("fields") % 2 == 0, "Table").otherwise("map")
    adjustment = catalog.quality(F.col("description"), view, F.col("snapshot_no") % 3 == 0, F.col("captured_at").isNotNull(), F.col("fields") != "")
    return catalog.score(df.withColumn("title", F.col("dataset_id")), "title", "description", "fields", "resource", adjustment, F.col("confidence")).select("dataset_id", "score")


def geometry_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind of geometry in texts, and the coordinates of points."""
    kind = F.when(F.col("row_id") % 4 == 0, "Polygon").when(F.col("row_id") % 4 == 1, "point").otherwise("Point")
    text = F.when(F.col("row_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(kind.alias("type"), F.array("lon", "lat").alias("coordinates"))))
    g = table(spark, d, "ann_arbor_air_quality").select("row_id", text.alias("g"))
    p = geo.geojson_point(F.col("g"))
    return g.select("row_id", geo.geometry_type(F.col("g")).alias("kind"), p["lat"].alias("lat"), p["lon"].alias("lon"))


def metadata_texts(spark: SparkSession, d: str) -> DataFrame:
    """all texts in nested metadata, in order."""
    r = table(spark, d, "open_data_row")
    nested = F.concat(F.lit('{"a": {"b": ["first", 1, null, {"c": '), F.to_json(F.struct("file_name")), F.lit('}]}, "payload": '), F.col("payload"), F.lit("}"))
    return r.select("dataset_id", "snapshot_no", "row_no", F.array_join(V.json_texts(nested), "|").alias("texts"))


def normal_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of codes trimmed, without empty and repeated ones, in order."""
    p = table(spark, d, "michigan_pfas")
    listed = F.array("pfoaflags", F.concat(F.lit("  "), "pfosflags", F.lit(" ")), F.lit(""), F.lit(None).cast("string"), "pfoaflags")
    return p.select("row_id", F.array_join(V.normal_list(listed), "|").alias("codes"))


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    """entity keys of the parts that are there."""
    return table(spark, d, "michigan_pfas").select("row_id", V.entity_key("wssn", "sysloccode", "pfoaflags").alias("entity"))


def query_values(spark: SparkSession, d: str) -> DataFrame:
    """First values of keys in addresses' queries."""
    url = F.concat(F.lit("https://"), "portal_id", F.lit(".example/search?sort=&q="), F.replace("title", F.lit(" "), F.lit("+")), F.lit("&q=other#q=none"))
    p = table(spark, d, "portal").select("portal_id", url.alias("url"))
    return p.select("portal_id", portal.query_value(F.col("url"), "q").alias("q"), portal.query_value(F.col("url"), "sort").alias("sort"), portal.query_value(F.col("url"), "none").alias("none"))


def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """what the parsers of ISO texts and Unix times make of the stations' time texts, in microseconds."""
    w = table(spark, d, "chicago_beach_weather")
    return w.select("row_id", F.unix_micros(V.to_ts("measurement_timestamp")).alias("any_us"), F.unix_micros(V.to_iso_ts("measurement_timestamp")).alias("iso_us"))


def coordinate_modes(spark: SparkSession, d: str) -> DataFrame:
    """How each dataset gives coordinates, by the labels of its fields."""
    return geo.coordinate_modes(table(spark, d, "open_data_field"), ["dataset_id"], "label")


def resource_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The dataset that every file belongs to, and how many rows it has there."""
    r = table(spark, d, "open_data_row")
    owners = r.groupBy(F.col("file_name").alias("resource_id")).agg(F.min("dataset_id").alias("package_id"))
    return r.groupBy(F.col("file_name").alias("resource_id")).agg(F.count("*").alias("rows")).join(owners, "resource_id", "left")


def catalog_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Per portal its distinct entries, those that score as candidates, the best one and the status."""
    docs = table(spark, d, "documents").where("portal_id is not null").groupBy("portal_id", "source", "text").agg(F.min("doc_id").alias("doc_id"))
    scored = catalog.score(docs, "source", "text")
    good = F.col("score") >= 20
    out = scored.groupBy("portal_id").agg(F.count("*").alias("entries"), F.count_if(good).alias("candidates"), F.min(F.when(good, F.struct((-F.col("score")).alias("s"), "doc_id")))["doc_id"].alias("best"))
    return table(spark, d, "portal").select("portal_id").join(out, "portal_id", "left").select("portal_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", F.when(F.col("candidates") > 0, "ready").otherwise("failed").alias("status"))


def selection_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The monitors' distinct places, ranked by distance, with tokens, and whether a saved selection, in either spelling, has them."""
    places = table(spark, d, "ann_arbor_air_quality").where("location_name is not null").groupBy("location_name").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    ranked = geo.rank_locations(places, "lat", "lon", (42.28, -83.74), ["location_name"], trusted=True).withColumn("token", V.key_token("location_name"))
    names = table(spark, d, "source_registry").where("source_table = 'ann_arbor_air_quality' and cadence_minutes is not null").select("source_name")
    saved = names.select(F.when(F.length("source_name") % 2 == 0, V.key_token("source_name")).otherwise(F.col("source_name")).alias("saved")).distinct()
    by = ranked.join(saved.withColumn("one", F.lit(True)), F.col("saved") == F.col("token"), "left").drop("saved")
    by = by.join(saved.withColumn("two", F.lit(True)), F.col("saved") == F.col("location_name"), "left")
    return by.select("location_name", F.round("distance_km", 6).alias("distance_km"), "token", F.coalesce("one", "two", F.lit(False)).alias("selected"))


def reanalysis_states(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from states kept as JSON, of which some can't be read; attempts lie hours back, some have failed, some analyses are asked for by hand."""
    code = F.ascii(F.substring("dataset_id", -1, 1))
    part = ["digest", "schema", "roles", "metrics", "dimensions", "coordinates", "ordering"]
    f = table(spark, d, "analysis_fingerprint").select("dataset_id", "snapshot_no", "digest", F.col("schema_json").alias("schema"), F.lit("").alias("roles"), "metrics", F.lit("").alias("dimensions"), F.col("coordinate_mode").alias("coordinates"), "ordering")
    last = f.groupBy("dataset_id").agg(F.max("snapshot_no").alias("n"))
    both = f.join(last, "dataset_id")
    now = both.where("snapshot_no = n").select("dataset_id", *part)
    older = both.where("snapshot_no < n").groupBy("dataset_id").agg(F.max_by(F.struct(*part), "snapshot_no").alias("s")).select("dataset_id", "s.*", (F.lit(1_000_000) - (code % 9) * 4 * 3600).cast("double").alias("last_attempt_s"), (code % 2 == 1).alias("failed"))
    kept = fingerprint.dump_state(older, "dataset_id").withColumn("state", F.when(code % 7 == 0, F.lit("{broken")).otherwise(F.col("state")))
    return fingerprint.decide(fingerprint.load_state(kept, "dataset_id", "state"), now, "dataset_id", F.lit(1_000_000.0), code % 11 == 0)


ALL = [
    record_points, stream_snapshot, wide_states, source_status, snapshot_tick, csv_scan, json_scan, gtfs_check, distinct_records, language_packs, international_mapping, retained_roles,
    candidate_labels, normal_lists, entity_keys, query_values, parsed_times, coordinate_modes, resource_lookup, catalog_preparation, selection_pipeline, reanalysis_states, described_profiles, scored_datasets, geometry_types, metadata_texts,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}
