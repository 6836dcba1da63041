"""Queries of the observation analytics over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.operators import catalog, dependencies, fingerprint, geo, inspection, observations, portal, profile, roles, sampling, series, sinks
from obslake.plans.problems import TIME_TABLES
from obslake.sources import files
from obslake.streaming import refresh
from obslake.tables import shared_folder, table, union_all

EVENTS = observations.Roles(unit=["user_id"], data=["value"], time="ts", seq=["event_id"], names=["event_type"])
LINES = observations.Roles(unit=["l_suppkey"], data=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], time="l_shipdate", seq=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
NOW = "2024-02-01 00:00:00"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return observations.to_points(table(spark, d, "events"), EVENTS)


def _people(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)


def latest_per_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of every stream of a long table."""
    return observations.latest_streams(table(spark, d, "events"), EVENTS).select("stream_id", "user_id", "metric", "ts", "value")


def wide_to_streams_latest(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of a wide table is a stream."""
    return observations.latest(observations.to_points(table(spark, d, "lineitem"), LINES), ["l_suppkey", "metric"], ["ts", "value"]).select("l_suppkey", "metric", "ts", "value")


def selected_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Only the selected measures are read and made points."""
    p = observations.to_points(table(spark, d, "lineitem"), LINES, selected=["l_quantity"])
    return p.groupBy("l_suppkey", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def point_history_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per stream and time the last row, summed up per stream."""
    h = observations.history(observations.to_points(table(spark, d, "lineitem"), LINES), ["l_suppkey", "metric"])
    return h.groupBy("l_suppkey", "metric").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 2).alias("total"))


def top_k_latest_per_unit(spark: SparkSession, d: str) -> DataFrame:
    """The three latest orders of the selected customers."""
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(chosen, "o_custkey", "left_semi")
    return observations.top_latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "rn", "o_orderkey", "o_orderdate", "o_totalprice")


def filtered_tail(spark: SparkSession, d: str) -> DataFrame:
    """An equality filter on text, then the last rows; the filter comes first."""
    return table(spark, d, "events").where(V.text("event_type") == "error").orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id", "value")


def cadence_median_gap(spark: SparkSession, d: str) -> DataFrame:
    """A09, W05."""
    return series.cadence_median_gap(table(spark, d, "events"), "ts").select(F.round("cadence_seconds", 4).alias("cadence_seconds"))


def cadence_window30(spark: SparkSession, d: str) -> DataFrame:
    """A10, W06."""
    return series.cadence_window(_points(spark, d), ["stream_id"], "ts").select(F.round("cadence_seconds", 4).alias("cadence_seconds"))


def freshness_staleness(spark: SparkSession, d: str) -> DataFrame:
    """A11, A12."""
    e = table(spark, d, "events")
    return series.freshness(e, "ts", F.lit(NOW).cast("timestamp_ntz"), series.cadence_median_gap(e, "ts")).select("latest", F.round("lag_seconds", 3).alias("lag_seconds"), "stale")


def _buckets(spark: SparkSession, d: str, minutes: int) -> DataFrame:
    b = series.bucket_stats(table(spark, d, "events"), ["event_type"], "ts", "value", minutes)
    return b.select("event_type", "bucket", "n", F.round("mean_value", 6).alias("mean_value"), "min_value", "max_value")


def bucket_stats_5min(spark: SparkSession, d: str) -> DataFrame:
    """A13, R04."""
    return _buckets(spark, d, 5)


def bucket_stats_hourly(spark: SparkSession, d: str) -> DataFrame:
    """A13, R04."""
    return _buckets(spark, d, 60)


def chao1_population(spark: SparkSession, d: str) -> DataFrame:
    """Over all orders."""
    return sampling.chao1(table(spark, d, "orders"), "o_custkey")


def physical_ordering(spark: SparkSession, d: str) -> DataFrame:
    """A02, W04."""
    o = sampling.physical_ordering(table(spark, d, "events"), "event_id", "ts", "user_id")
    return o.select("row_count", *[F.round(c, 6).alias(c) for c in ("ascending", "descending", "adjacent_same")], "ordering")


def retrieval_plan(spark: SparkSession, d: str) -> DataFrame:
    """A03, A04."""
    return sampling.retrieval_plan(table(spark, d, "events"), "user_id", ["event_type"], [])


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """200 rows, each user's newest and oldest in turn. The cap is the operator's parameter."""
    return sampling.stratified_sample(table(spark, d, "events"), "user_id", "ts", "event_id", 200).select("event_id", "user_id", "ts")


def sampling_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A06."""
    e = table(spark, d, "events")
    return sampling.sampling_evidence(sampling.stratified_sample(e, "user_id", "ts", "event_id", 200), e, "user_id", "ts", 200)


def functional_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """A07, O07."""
    f = dependencies.functional_dependencies(_people(spark, d), ["c_custkey", "n_name", "r_name", "c_mktsegment"])
    return f.select("determinant", "dependent", "determinant_values", "dependent_values", F.round("confidence", 6).alias("confidence"))


def dimension_relationships(spark: SparkSession, d: str) -> DataFrame:
    """A08, J08."""
    return dependencies.dimension_relationships(_people(spark, d), ["c_custkey", "n_name", "r_name"])


BEHAVED = ["event_id", "ts", "user_id", "event_type", "value"]


def field_behaviour(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every field and the role they make."""
    b = profile.with_roles(profile.field_behaviour(table(spark, d, "events"), BEHAVED, "user_id"), [])
    return b.select("field", "non_null", "distinct_values", *[F.round(c, 6).alias(c) for c in ("numeric_ratio", "temporal_ratio", "uniqueness", "stability")], "changes", "role")


def long_metric_preview(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return profile.long_preview(table(spark, d, "events"), "event_type", "value")


def observation_shape(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    s = profile.observation_shape(table(spark, d, "events"), BEHAVED, "user_id", "ts", names=("event_type", "value"))
    return spark.createDataFrame([(s["shape"], s["confidence"], "|".join(s["metrics"]))], "shape string, confidence double, metrics string")


def grid_scores(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    l = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_suppkey", "l_returnflag")
    return profile.grid_scores(l, ["month"], ["l_suppkey", "l_returnflag"]).select("time_field", "place_field", "pairs", F.round("score", 6).alias("score"))


def dataset_structure(spark: SparkSession, d: str) -> DataFrame:
    """Kind and fields of a table of readings."""
    s = profile.dataset_structure(table(spark, d, "ann_arbor_air_quality").drop("ingested_at"))
    return spark.createDataFrame([(k, "|".join(v) if isinstance(v, list) else str(v)) for k, v in s.items()], "part string, found string")


def explorer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Structure, nestings and hypotheses of a table, and whether they are to be confirmed."""
    return spark.createDataFrame(inspection.report(inspection.explorer_summary(table(spark, d, "michigan_pfas").drop("row_id", "ingested_at"))), "part string, found string")


def inspect_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A30 of A22, A05, A24, A07, A19: the evidence of a table of readings; the sample's size is the operator's parameter."""
    found = inspection.inspect_dataset(table(spark, d, "ann_arbor_air_quality").drop("ingested_at"), "row_id")
    return spark.createDataFrame(inspection.report(found), "part string, found string")


def role_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    return spark.createDataFrame(profile.hypotheses(profile.dataset_structure(table(spark, d, "michigan_pfas").drop("ingested_at"))), "field string, role string, confidence double")


def unit_selections(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each composite key."""
    p = _people(spark, d)
    return observations.first_per_key(p.select("n_name", "c_mktsegment", "c_custkey", "c_name"), ["n_name", "c_mktsegment"], ["c_custkey"]).select("n_name", "c_mktsegment", "c_custkey", V.joined("n_name", "c_mktsegment").alias("label"))


def disambiguated_labels(spark: SparkSession, d: str) -> DataFrame:
    """A14, W09, J09."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return observations.disambiguate(p, "p_name", "p_partkey", ["p_brand", "p_type"]).select("p_partkey", "unique_label")


def unit_key_tokens(spark: SparkSession, d: str) -> DataFrame:
    """reversible tokens of composite keys."""
    c = table(spark, d, "customer").select("c_custkey", V.key_token("c_custkey", "c_mktsegment").alias("token"))
    return c.select("c_custkey", "token", F.array_join(V.key_parts("token"), "|").alias("parts"))


def stream_ids(spark: SparkSession, d: str) -> DataFrame:
    """distinct stream ids."""
    return _points(spark, d).select("stream_id", "user_id", "metric").distinct()


def _halves(e: DataFrame, unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The events before the middle of their time range, cut to the unit, and those from it on; events without time are
    among the first."""
    middle = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("__middle"))
    if unit:
        middle = middle.select(F.date_trunc(unit, "__middle").cast("timestamp_ntz").alias("__middle"))
    both = e.crossJoin(F.broadcast(middle)).withColumn("__late", F.coalesce(F.col("ts") >= F.col("__middle"), F.lit(False)))
    return both.where(~F.col("__late")).select(*e.columns), both.where("__late").select(*e.columns)


def new_streams(spark: SparkSession, d: str) -> DataFrame:
    """Streams seen in the second half of the time that the first doesn't know."""
    first, second = _halves(table(spark, d, "events"))
    return observations.new_keys(second, first, ["user_id", "event_type"])


def reconcile_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's persisted token, of either spelling, matched by token, else by its decoded key."""
    available = table(spark, d, "customer").select("c_custkey", V.key_token("c_custkey").alias("token"))
    saved = available.select(F.when(F.col("c_custkey") % 2 == 0, F.col("token")).otherwise(V.text("c_custkey")).alias("saved"))
    by_token = saved.join(available.select(F.col("token").alias("saved"), F.col("c_custkey").alias("k1")), "saved", "left")
    both = by_token.join(available.select(V.text("c_custkey").alias("saved"), F.col("c_custkey").alias("k2")), "saved", "left")
    return both.select("saved", F.coalesce("k1", "k2").alias("c_custkey")).where("c_custkey is not null")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text")


def score_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Weighted terms over whole texts."""
    return catalog.score(_docs(spark, d), "source", "text").select("doc_id", "score")


def catalog_quality(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    q = catalog.quality(F.concat_ws(" ", "source", "text"), F.when(F.col("source") == "catalog_description", "dataset").otherwise("story"))
    return _docs(spark, d).select("doc_id", q.alias("adjustment"))


def rank_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents. Ten is the report's size."""
    s = catalog.score(_docs(spark, d).withColumn("title", F.lpad(V.text("doc_id"), 12, "0")), "source", "text")
    return catalog.rank(s, "title", 20, 10).select("doc_id", "score")


def search_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every word of a query."""
    return catalog.search(_docs(spark, d), "ozone sensor", "text").select("doc_id")


def ontology_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the catalog's snapshots on the metrics of an alias table."""
    fields = table(spark, d, "open_data_field").select("dataset_id", "name", "label", "description").distinct()
    aliases = table(spark, d, "metric_alias").select(F.col("metric_label").alias("alias"), F.col("quantity").alias("metric_id"), F.lit(0).alias("metric_order"))
    return catalog.map_fields(fields, ["dataset_id"], aliases, V.ascii_identifier).select("dataset_id", "name", "metric_id", "confidence", "matched_by")


PROFILES = [("weather", 1, "core", "air_temperature"), ("weather", 1, "core", "relative_humidity"), ("weather", 1, "support", "wind_speed"), ("weather", 1, "support", "air_pressure"), ("air", 2, "core", "pm2_5"), ("air", 2, "core", "nitrogen_dioxide"), ("water", 3, "core", "water_level"), ("water", 3, "support", "streamflow")]


def profile_match(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each dataset, by its fields; the tables have no dataset's metadata."""
    p = spark.createDataFrame(PROFILES, "profile_id string, profile_order int, kind string, metric_id string")
    return catalog.match_profiles(ontology_mapping(spark, d), ["dataset_id"], p)


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """the addresses in texts in normal form."""
    links = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(https?://\S+)"), F.lit(1))).alias("url")).distinct()
    return links.select("url", portal.normal_url(F.col("url")).alias("normal"), portal.origin(F.col("url")).alias("origin"))


def parse_reference(spark: SparkSession, d: str) -> DataFrame:
    """provider, portal and dataset of addresses."""
    links = _docs(spark, d).select(F.explode(portal.page_links(F.col("text"))).alias("url")).distinct()
    return portal.parse_reference(links, "url")


def candidate_roots(spark: SparkSession, d: str) -> DataFrame:
    """F21."""
    path = F.when(F.col("provider") == "ckan", "/city/dataset/rain").when(F.col("provider") == "socrata", "/Browse/").when(F.col("provider") == "arcgis", "").otherwise("/city/datasets/list")
    p = table(spark, d, "portal").select("portal_id", F.concat(F.lit("https://www."), "portal_id", F.lit(".example"), path).alias("url"))
    return p.select("portal_id", F.array_join(portal.candidate_roots(F.col("url")), " ").alias("roots"), F.array_join(portal.sibling_hosts(F.col("url")), " ").alias("siblings"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses per document."""
    return _docs(spark, d).select("doc_id", F.explode(portal.page_links(F.col("text"))).alias("link"))


def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Items of JSON envelopes as rows."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"results": ['), "props", F.lit("]}")).alias("payload"))
    return files.envelope_rows(e, "payload", {"k": "bigint"}).select("event_id", "k")


def location_rank(spark: SparkSession, d: str) -> DataFrame:
    """Monitors by distance from a place."""
    places = table(spark, d, "ann_arbor_air_quality").where("location_name is not null").groupBy("location_name").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return geo.rank_locations(places, "lat", "lon", (42.28, -83.74), ["location_name"]).select("location_name", F.round("distance_km", 6).alias("distance_km"))


def coordinate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A33."""
    return geo.coordinate_evidence(table(spark, d, "ann_arbor_air_quality"), "lat", "lon")


def fingerprint_events(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    e = table(spark, d, "events")
    return fingerprint.fingerprint(e, [(f.name, f.dataType.simpleString()) for f in e.schema], {"user_id": "entity"}, ["value"], ["event_type", "user_id"])


def reanalysis_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset whether its last snapshot's fingerprint asks for an analysis."""
    f = table(spark, d, "analysis_fingerprint").select("dataset_id", "snapshot_no", "digest", F.col("schema_json").alias("schema"), F.lit("").alias("roles"), "metrics", F.lit("").alias("dimensions"), F.col("coordinate_mode").alias("coordinates"), "ordering", F.unix_seconds("captured_at").alias("at"))
    part = ["digest", "schema", "roles", "metrics", "dimensions", "coordinates", "ordering"]
    last = f.groupBy("dataset_id").agg(F.max("snapshot_no").alias("n"))
    both = f.join(last, "dataset_id")
    now = both.where("snapshot_no = n").select("dataset_id", *part)
    older = both.where("snapshot_no < n").groupBy("dataset_id").agg(F.max_by(F.struct(*part, "at"), "snapshot_no").alias("s")).select("dataset_id", *[F.col(f"s.{c}").alias(c) for c in part], F.col("s.at").alias("last_attempt_s"), F.lit(False).alias("failed"))
    return fingerprint.decide(older, now, "dataset_id", F.lit(4_000_000_000))


def resource_choice(spark: SparkSession, d: str) -> DataFrame:
    """The newest active CSV, else JSON, per portal."""
    r = table(spark, d, "documents").select("portal_id", V.text("doc_id").alias("resource_id"), F.when(F.col("doc_id") % 3 == 0, "CSV").when(F.col("doc_id") % 3 == 1, "GeoJSON").otherwise("PDF").alias("format"), (F.col("doc_id") % 2 == 0).alias("active"), V.text("collected_at").alias("modified"))
    return catalog.choose_resource(r, "portal_id").select("portal_id", "resource_id", "kind")


def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    """Categories that mean the same."""
    p = table(spark, d, "part").select(F.concat(F.lit("  "), F.upper("p_type"), F.lit("  "), "p_brand").alias("a"), F.concat(V.text("p_size"), F.lit(".0")).alias("b"))
    return p.select(V.canonical_text("a").alias("category"), V.canonical_text("b").alias("size")).groupBy("category", "size").agg(F.count("*").alias("n"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Entries per source and language with stable ids and bounded texts; corpus_fields() has the field names."""
    c = files.corpus_entries(table(spark, d, "documents"), ["portal_id", "source", "doc_id"], "text", 160)
    return c.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("corpus_id").alias("ids"), F.max(F.length("bounded_text")).alias("longest"), F.min("corpus_id").alias("first_id"))


def corpus_fields(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most common field names of all datasets' snapshots. Fifty is the summary's size."""
    return files.common_fields(table(spark, d, "open_data_field").where("name is not null"), ["dataset_id", "snapshot_no"], "name", V.corpus_identifier)


def field_names(spark: SparkSession, d: str) -> DataFrame:
    """the normal forms of field names."""
    n = table(spark, d, "open_data_field").select("name", "label").distinct()
    return n.select("name", "label", V.ascii_identifier("label").alias("ascii_form"), V.word_identifier("label").alias("word_form"), V.corpus_identifier("label").alias("corpus_form"))


def unicode_names(spark: SparkSession, d: str) -> DataFrame:
    """compatibility form and case folding."""
    n = table(spark, d, "open_data_field").select("label").distinct()
    return n.select("label", V.unicode_identifier("label").alias("folded"))


def dirty_numbers(spark: SparkSession, d: str) -> DataFrame:
    """number texts of observations."""
    o = table(spark, d, "semantic_observation")
    return o.select("obs_id", V.to_number("value").alias("finite"), V.to_dirty_number("value").alias("dirty"), V.looks_temporal("value").alias("temporal"))


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Registered sources of every source table without any reading row."""
    reg = table(spark, d, "source_registry").select("source_table", F.col("source_name").alias("site"))
    rows = union_all([table(spark, d, n).select(F.lit(n).alias("source_table"), F.col(x[1]).alias("site")) for n, x in TIME_TABLES.items() if x[1]])
    return observations.new_keys(reg, rows, ["source_table", "site"])


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)


def streaming_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The hourly buckets of a stream, each emitted once when the watermark of an hour has passed it."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stats = refresh.bucketed(_event_stream(spark, d), ["event_type"], "ts", "value", 60, "1 hour")
    refresh.run_available(stats, refresh.append_batches(f"{base}/out"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("event_type", "bucket", "n", F.round("mean_value", 6).alias("mean_value"), "min_value", "max_value")


def stream_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The append-only table of known streams, fed by a stream."""
    base = f"{shared_folder(spark)}/known-{uuid.uuid4().hex}"
    refresh.run_available(_event_stream(spark, d), refresh.discover(f"{base}/known", ["user_id", "event_type"]), f"{base}/state")
    return spark.read.parquet(f"{base}/known").select("user_id", "event_type")


def latest_sink(spark: SparkSession, d: str) -> DataFrame:
    """The kept latest value of every stream, refreshed by a stream batch by batch."""
    base = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    points = _event_stream(spark, d).select("user_id", "event_type", "ts", F.struct("event_id").alias("seq"), "value")
    refresh.run_available(points, refresh.refresh_latest(f"{base}/kept", ["user_id", "event_type"]), f"{base}/state")
    return refresh.kept_latest(spark, f"{base}/kept").select("user_id", "event_type", "ts", "value")


def statistics_once(spark: SparkSession, d: str) -> DataFrame:
    """Hourly buckets that the first half of the time didn't have; it ends with an hour, so no bucket is written in part."""
    e = table(spark, d, "events")
    written = series.bucket_stats(_halves(e, "hour")[0], ["event_type"], "ts", "value", 60)
    return sinks.once_per_bucket(series.bucket_stats(e, ["event_type"], "ts", "value", 60), written, ["event_type", "bucket"]).select("event_type", "bucket", "n")


def attribute_projection(spark: SparkSession, d: str) -> DataFrame:
    """Present values of a row as JSON."""
    p = table(spark, d, "part")
    return p.select("p_partkey", sinks.attributes(p, ["p_name", "p_brand", "p_type", "p_size"]).alias("attributes"))


def unsent_reports(spark: SparkSession, d: str) -> DataFrame:
    """Schemas that changed since the snapshot before."""
    f = table(spark, d, "analysis_fingerprint").select("dataset_id", "snapshot_no", "schema_json")
    sent = f.select("dataset_id", (F.col("snapshot_no") + 1).alias("snapshot_no"), F.sha2("schema_json", 256).alias("digest"))
    return sinks.unreported(f, sent, ["dataset_id", "snapshot_no"], "schema_json").select("dataset_id", "snapshot_no", "digest")


def pruned_sources(spark: SparkSession, d: str) -> DataFrame:
    """Registered sources without a deployment."""
    kept = table(spark, d, "source_registry").select("source_table", "source_name")
    return sinks.stale_keys(kept, table(spark, d, "source_deployment"), ["source_table", "source_name"])


def prepared_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Prepared catalogs after a restart."""
    c = table(spark, d, "portal").select("portal_id", F.concat(F.lit(" HTTPS://"), "portal_id", F.lit("/ ")).alias("portal_url"), F.when(F.col("provider") == "ckan", "running").otherwise("ready").alias("status"))
    return sinks.prepared(c, F.lit(False)).select("portal_id", "portal_key", "status")


def source_route(spark: SparkSession, d: str) -> DataFrame:
    """The file's rows if the interface, which has all events of the first half of the time, lags too far."""
    e = table(spark, d, "events")
    return sinks.choose_source(_halves(e)[0], e, "ts", F.lit(1800.0))


def role_classification(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the fields of a survey, one chosen by hand."""
    p = table(spark, d, "michigan_pfas").drop("row_id", "ingested_at")
    found = roles.classify(p, p.columns, explicit={"systemname": "location"}, times=["sampledate"])
    return spark.createDataFrame(list(found.items()), "field string, role string")


def record_selections(spark: SparkSession, d: str) -> DataFrame:
    """Units of a composite key with labels."""
    s = roles.RecordStructure(("wssn", "sysloccode"), ("systemname", "locname"))
    return roles.selections(table(spark, d, "michigan_pfas"), s, ["row_id"]).select("token", "label")


ALL = [
    latest_per_stream, wide_to_streams_latest, selected_metrics, point_history_dedup, top_k_latest_per_unit, filtered_tail, cadence_median_gap, cadence_window30, freshness_staleness,
    bucket_stats_5min, bucket_stats_hourly, chao1_population, physical_ordering, retrieval_plan, stratified_sample, sampling_evidence, functional_dependencies, dimension_relationships,
    field_behaviour, long_metric_preview, observation_shape, grid_scores, dataset_structure, explorer_summary, inspect_dataset, role_hypotheses, unit_selections, disambiguated_labels, unit_key_tokens, stream_ids, new_streams,
    reconcile_selection, score_catalog, catalog_quality, rank_catalog, search_catalog, ontology_mapping, profile_match, url_normalize, parse_reference, candidate_roots, html_links, json_envelope,
    location_rank, coordinate_evidence, fingerprint_events, reanalysis_decisions, resource_choice, canonical_text, corpus_summary, corpus_fields, field_names, unicode_names, dirty_numbers, stale_sources,
    streaming_buckets, stream_discovery, latest_sink, statistics_once, attribute_projection, unsent_reports, pruned_sources, prepared_catalogs, source_route, role_classification, record_selections,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}
