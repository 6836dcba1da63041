"""The pN_ queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslake.operators import anomaly, raw_records, regular_grid, schema_drift, time_normalise, unit_convert
from obslake.tables import checkpointed, lookup_join, table, union_all

#: Of each table with time texts: text column, source column, usual layout as a Java pattern, zone if it's one for all.
TIME_TABLES = {
    "chicago_beach_weather": ("measurement_timestamp", "station_name", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$", None),
    "ann_arbor_air_quality": ("timestamp_hour_start", "location_name", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", None),
    "ann_arbor_rainfall": ("period", "site", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", None),
    "michigan_pfas": ("sampledate", None, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "America/Detroit"),
}


def with_instants(spark: SparkSession, d: str, name: str, columns: list[str], estimate: str | None = "unknown") -> DataFrame:
    """The table's row_id, source (as __source), time text and given columns, with utc_us."""
    text, source, _, zone = TIME_TABLES[name]
    df = table(spark, d, name).select("row_id", *([F.col(source).alias("__source")] if source else []), text, "ingested_at", *columns)
    zones = None
    if source:
        zones = table(spark, d, "source_registry").where(F.col("source_table") == name).select(F.col("source_name").alias("__source"), "zone_name")
    return time_normalise.normalise_times(df, text, "__source" if source else None, zones, "ingested_at", zone, estimate)


def _sourced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The time texts of all tables with sources as one, by source as table|source, and the registered zones of these."""
    parts = [table(spark, d, n).select(F.lit(n).alias("table_name"), "row_id", F.concat(F.lit(f"{n}|"), x[1]).alias("__source"), F.col(x[0]).alias("__text"), "ingested_at") for n, x in TIME_TABLES.items() if x[1]]
    return union_all(parts), table(spark, d, "source_registry").select(F.concat("source_table", F.lit("|"), "source_name").alias("__source"), "zone_name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose time text is unusual, with their instant, zones estimated and checked against the registry. Null and
    empty texts are no case."""
    rows, zones = _sourced(spark, d)
    timed = time_normalise.normalise_times(rows, "__text", "__source", zones, "ingested_at", estimate="all")
    parts = [time_normalise.found(with_instants(spark, d, n, []), n, x[0], x[2]) for n, x in TIME_TABLES.items() if not x[1]]
    usual = F.coalesce(*[F.when(F.col("table_name") == n, time_normalise.unusual_times(timed, "__text", x[2])) for n, x in TIME_TABLES.items() if x[1]])
    return union_all([timed.where(usual).select("table_name", "row_id", time_normalise.found_text().alias("utc_text")), *parts])


def p1_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Every source's zone in every period as estimated from arrivals alone, beside the registered one."""
    from obslake.functions.timestamps import with_parsed_time

    rows, registry = _sourced(spark, d)
    df = with_parsed_time(rows, "__text")
    bare = df.where(F.col("t_local_us").isNotNull() & F.col("t_offset_min").isNull() & F.col("t_region").isNull())
    part = F.split("__source", r"\|", 2)
    return time_normalise.zone_history(bare, "__source", "t_local_us", "ingested_at").join(registry, "__source", "left").select(part[0].alias("source_table"), part[1].alias("source_name"), "period", "est_zone", "violations", "readings", "decided", "zone_name")


PFAS_COLUMNS = ["systemname", "wssn", "locname", "sysloccode", "sampledate", "pfoaresult", "pfosresult", "pfoaflags", "pfosflags"]


def _pfas(spark: SparkSession, d: str) -> DataFrame:
    codes = [r[0] for r in table(spark, d, "pfas_flag").select("flag_code").where("flag_code is not null").distinct().orderBy("flag_code").limit(1001).collect()]
    if len(codes) > 1000:
        raise ValueError("pfas_flag is a short code list")
    return raw_records.load_records(table(spark, d, "michigan_pfas_raw"), "raw_record", PFAS_COLUMNS, ["pfoaresult", "pfosresult"], {"pfoaflags": codes})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be loaded, with the first reason that holds."""
    return _pfas(spark, d).where("reason is not null").select("record_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed rows of the records that can be loaded."""
    return _pfas(spark, d).where("reason is null").drop("reason", "error_offset", "raw_record")


#: Of each table of problem 3: fields with the least and greatest possible value, and whether steps are relative.
MEASURED = {"chicago_beach_weather": {"air_temperature": (-60.0, 60.0, False), "humidity": (0.0, 100.0, False)}, "ann_arbor_air_quality": {"pm2point5_raw": (0.0, 1000.0, True)}}


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the fields in long form: row_id, series (table, field and source), t, v, lo, hi, log_scale, cadence_us."""
    parts = []
    for name, fields in MEASURED.items():
        cadence = table(spark, d, "source_registry").where((F.col("source_table") == name) & (F.col("cadence_minutes") >= 1)).groupBy(F.col("source_name").alias("__source")).agg(F.min("cadence_minutes").alias("__cadence"))
        rows = with_instants(spark, d, name, list(fields)).where("utc_us is not null and __source is not null")
        rows = lookup_join(rows, cadence, ["__source"])
        one = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(log).alias("log_scale")) for f, (lo, hi, log) in fields.items()]
        parts.append(
            rows.select("row_id", "__source", "utc_us", "__cadence", F.inline(F.array(*one)))
            .where("v is not null")
            .select("row_id", F.concat_ws("|", F.lit(name), "field_name", "__source").alias("series"), F.col("utc_us").alias("t"), "v", "lo", "hi", "log_scale", (F.coalesce("__cadence", F.lit(60)).cast("long") * 60_000_000).alias("cadence_us"))
        )
    return union_all(parts)


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every flagged reading with its kind and probability; copies of a flagged row are flagged too."""
    rows = checkpointed(_measured(spark, d))
    flagged = anomaly.flag_rows(rows.select("row_id", "series", "t", "v"), checkpointed(anomaly.flag_readings(rows)))
    part = F.split("series", r"\|", 3)
    return flagged.select(part[0].alias("table_name"), "row_id", part[1].alias("field_name"), "flag", "probability")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_flags(spark, d).select("table_name", "row_id", "field_name")


def p3_impossible(spark: SparkSession, d: str) -> DataFrame:
    """Of the flagged readings, those out of range."""
    return p3_flags(spark, d).where("flag = 'out_of_range'").select("table_name", "row_id", "field_name")


def p4_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every observation with its quantity, recorded unit and value in the common unit."""
    o = table(spark, d, "semantic_observation").select("obs_id", "stream_id", "unit_id", "metric", "source_field", "value", "unit", "record_label", "observed_at")
    out = unit_convert.convert_units(o, table(spark, d, "unit_reference"), table(spark, d, "metric_alias"))
    return out.select("obs_id", "stream_id", "quantity", "number", "unit_code", "unit_from", "is_common", "common_value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Observations that hold a number recorded in another unit than the common one."""
    return p4_converted(spark, d).where("unit_code is not null and not is_common").select("obs_id", "unit_code")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.lifespans(checkpointed(schema_drift.snapshot_fields(table(spark, d, "open_data_field"), table(spark, d, "analysis_fingerprint"), table(spark, d, "type_alias"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a dataset's fields from one snapshot to the next."""
    return schema_drift.changes(_spans(spark, d)).select("dataset_id", "snapshot_no", "old_name", "new_name")


def p5_columns(spark: SparkSession, d: str) -> DataFrame:
    """The consistent column of every field of every snapshot."""
    spans = checkpointed(_spans(spark, d))
    return schema_drift.columns(spans, schema_drift.changes(spans).where("change = 'renamed'").select("dataset_id", "snapshot_no", "old_name", "new_name"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All rows under consistent column names and types, as one JSON object each, keys in order of the snapshot's names."""
    spans = checkpointed(_spans(spark, d))
    renamed = schema_drift.changes(spans).where("change = 'renamed'").select("dataset_id", "snapshot_no", "old_name", "new_name")
    out = schema_drift.consistent_rows(table(spark, d, "open_data_row"), schema_drift.columns(spans, renamed))
    return out.select("dataset_id", "snapshot_no", "row_no", "file_name", F.to_json("record", {"ignoreNullFields": "false"}).alias("record_json"))


#: Of each table of problem 6: source column and value column, whether a reading without value is one.
GRID_TABLES = {"chicago_beach_weather": ("station_name", "air_temperature", True), "ann_arbor_rainfall": ("site", "rainfall", False)}


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The series of all tables' sources, made as one: a source is table|source."""
    readings = []
    for name, (_, value, bare) in GRID_TABLES.items():
        rows = with_instants(spark, d, name, [value]).select(F.concat(F.lit(f"{name}|"), "__source").alias("source"), "utc_us", F.col(value).cast("double").alias("value"))
        readings.append(rows if bare else rows.where("value is not null"))
    own, key = F.col("source_table").isin(*GRID_TABLES), F.concat("source_table", F.lit("|"), "source_name").alias("source")
    cadence = table(spark, d, "source_registry").where(own).select(key, "cadence_minutes")
    deployments = table(spark, d, "source_deployment").where(own).select(key, "active_from", "active_to")
    part = F.split("source", r"\|", 2)
    return regular_grid.regular_series(union_all(readings), deployments, cadence).select(part[0].alias("table_name"), part[1].alias("source_name"), *["slot_ms", "readings", "value", "last_ms", "next_ms", "filled", "status"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The empty slots of every deployment."""
    return _series(spark, d).where("status != 'observed'").select("table_name", "source_name", "slot_ms")


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    """The regular series of every source, empty slots filled from the last reading and marked."""
    return _series(spark, d)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_zone_estimates, p2_found, p2_loaded, p3_found, p3_flags, p3_impossible, p4_found, p4_converted, p5_found, p5_columns, p5_table, p6_found, p6_series)}
