"""Catalogs of datasets: weighted terms, quality, ranking, search, field ontology and dataset profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslake.tables import BROADCAST_BYTES, BROADCAST_ROWS, at_most, lookup_join, union_all

# Terms in a dataset's texts and their weights.
ENVIRONMENT_TERMS = {
    "air quality": 35, "weather": 30, "temperature": 24, "humidity": 22, "pm2.5": 35, "pm25": 35, "pm10": 30, "aqi": 35, "ozone": 24, "rainfall": 30,
    "precipitation": 28, "river": 22, "stream": 20, "water level": 24, "flood": 24, "wind": 20, "climate": 18, "solar": 18, "energy": 14, "sensor": 16,
    "hourly": 14, "real time": 18, "realtime": 18, "traffic count": 24, "pedestrian count": 24, "bicycle count": 24, "speed": 14, "water quality": 26, "noise": 16,
}
LOW_VALUE_TERMS = {"payroll": -35, "budget": -20, "procurement": -18, "meeting minutes": -30, "pdf": -18, "archive": -15}
FIELD_TERMS = {
    "timestamp": 12, "date": 6, "time": 6, "station": 10, "sensor": 10, "counter": 10, "latitude": 8, "longitude": 8, "temperature": 16, "humidity": 16, "pm25": 20,
    "pm2_5": 20, "pm10": 18, "aqi": 20, "rain": 14, "precip": 14, "wind": 12, "count": 12, "speed": 12, "volume": 10, "concentration": 12,
}
# Words of official publishers and of copies, and kinds of views.
OFFICIAL_MARKERS = ["city of new york", "nyc open data", "department of", "official", "agency", "government"]
DERIVED_MARKERS = ["community created", "community view", "derived view", "filtered view", "copy of ", "test dataset", "sample dataset"]
SOURCE_VIEWS, PRESENTATION_VIEWS = ["dataset", "table", "tabular"], ["chart", "filter", "map", "story", "visualization"]


def term_score(text: Column, terms: dict[str, int]) -> Column:
    """Sum of the weights of the terms that a text holds: a chain of searches in one projection, no join."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(t)), w).otherwise(0) for t, w in terms.items()], F.lit(0))


def searchable(*texts: Column) -> Column:
    """Lower case, everything but letters, digits and points as one blank."""
    return F.regexp_replace(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9.]+", " ")


def quality(texts: Column, view_type: Column | None = None, has_parent: Column | None = None, updated: Column | None = None, has_columns: Column | None = None) -> Column:
    """Adjustment for source over presentation views, official publishers, copies, update and schema metadata."""
    low = F.lower(texts)
    any_of = lambda xs: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in xs])
    out = F.when(any_of(OFFICIAL_MARKERS), 10).otherwise(0) + F.when(any_of(DERIVED_MARKERS), -30).otherwise(0)
    if view_type is not None:
        out = out + F.when(F.lower(view_type).isin(SOURCE_VIEWS), 12).when(F.lower(view_type).isin(PRESENTATION_VIEWS), -18).otherwise(0)
    for flag, weight in ((has_parent, -14), (updated, 4), (has_columns, 6)):
        if flag is not None:
            out = out + F.when(flag, weight).otherwise(0)
    return out


def score(df: DataFrame, title: str, description: str, fields: str | None = None, resource: str | None = None, adjustment: Column | None = None, confidence: Column | None = None, cleaned: str | None = None) -> DataFrame:
    """Adds ``score``; ``fields`` is a text of the dataset's field names, ``confidence`` that of its profile. ``cleaned``
    names a column that the searched text is added as."""
    # the text is cleaned once per row: a generator keeps the optimizer from repeating that in every search for a term
    out = df.select("*", F.inline(F.array(F.struct(searchable(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))).alias("__text")))))
    s = term_score(F.col("__text"), ENVIRONMENT_TERMS | LOW_VALUE_TERMS)
    if resource:
        s = s + F.when(F.col(resource).isNotNull(), 15).otherwise(0)
    has = F.lit(False)
    if fields:
        has = F.coalesce(F.col(fields) != "", F.lit(False))
        s = s + F.when(has, 10 + term_score(F.lower(fields), FIELD_TERMS)).otherwise(0)
    if adjustment is not None:
        s = s + adjustment
    if confidence is not None:
        s = s + F.coalesce(F.bround(confidence * F.when(has, 55).otherwise(30)), F.lit(0)).cast("int")
    return out.select(*df.columns, *([F.col("__text").alias(cleaned)] if cleaned else []), F.inline(F.array(F.struct(s.alias("score")))))


def rank(df: DataFrame, title: str, least: int = 0, limit: int | None = None) -> DataFrame:
    out = df.where(F.col("score") >= least).orderBy(F.desc("score"), F.lower(title))
    return out if limit is None else out.limit(limit)


def search(df: DataFrame, query: str, *texts: str) -> DataFrame:
    """Rows whose texts hold every word of the query."""
    hay = F.lower(F.concat_ws(" ", *texts))
    for word in query.lower().split():
        df = df.where(F.contains(hay, F.lit(word)))
    return df


def map_fields(fields: DataFrame, key: list[str], aliases: DataFrame, normal) -> DataFrame:
    """Per field the best metric of an alias table: by name 1.0, label 0.96, description 0.88; the first metric on ties.

    ``fields`` has name, label, description; ``aliases`` alias, metric_id, metric_order; ``normal`` makes names comparable.
    """
    ways = F.array(*[F.struct(F.lit(c).alias("matched_by"), F.lit(w).alias("confidence"), F.col(c).alias("t")) for c, w in (("name", 1.0), ("label", 0.96), ("description", 0.88))])
    tried = fields.select(*key, "name", F.inline(ways)).where("t is not null").withColumn("alias", normal("t"))
    known = aliases.select(normal("alias").alias("alias"), "metric_id", "metric_order").where("alias != ''")
    hit = lookup_join(tried, known, ["alias"], "inner")
    best = hit.groupBy(*key, "name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "metric_order", "metric_id", "matched_by")).alias("b"))
    return best.select(*key, "name", F.col("b.metric_id").alias("metric_id"), (-F.col("b.c")).alias("confidence"), F.col("b.matched_by").alias("matched_by"))


def match_profiles(mapped: DataFrame, key: list[str], profiles: DataFrame, metadata: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Per dataset the profile of the greatest confidence, 0.65 core + 0.2 support share + 0.15 metadata share, x 0.45
    without any core metric; of datasets without fields 0.35 metadata share; below 0.15 none. The metadata share is a half
    per term found, 1 at most. ``profiles`` has profile_id, profile_order, kind (core, support, or another for a profile
    without metrics) and metric_id; ``metadata`` a row per dataset with the key, text and has_fields; ``terms`` profile_id
    and term."""
    sizes = profiles.groupBy("profile_id", "profile_order").agg(F.count_if(F.col("kind") == "core").alias("cores"), F.count_if(F.col("kind") == "support").alias("supports"))
    hits = lookup_join(mapped.select(*key, "metric_id").distinct(), profiles, ["metric_id"], "inner").groupBy(*key, "profile_id").agg(F.count_if(F.col("kind") == "core").alias("c"), F.count_if(F.col("kind") == "support").alias("s"))
    if metadata is not None and terms is not None:
        known = terms.distinct().withColumn("__t", F.lower("term"))
        if not at_most(known, BROADCAST_ROWS, BROADCAST_BYTES):
            raise ValueError("terms of profiles are a short list")
        said = metadata.select(*key, F.lower("text").alias("__text"), F.coalesce("has_fields", F.lit(False)).alias("has_fields"))
        found = said.join(F.broadcast(known), F.contains("__text", "__t")).groupBy(*key, "profile_id").agg(F.least(F.count("*"), F.lit(2)).alias("m"), F.max("has_fields").alias("has_fields"))
        hits = hits.join(found, [*key, "profile_id"], "full").withColumn("has_fields", F.col("c").isNotNull() | F.col("has_fields")).fillna(0, ["c", "s", "m"])
    else:
        hits = hits.select("*", F.lit(0).alias("m"), F.lit(True).alias("has_fields"))
    full = lookup_join(hits, sizes, ["profile_id"], "inner")
    conf = 0.65 * F.col("c") / F.greatest("cores", F.lit(1)) + 0.20 * F.col("s") / F.greatest("supports", F.lit(1)) + 0.15 * F.col("m") / 2
    conf = F.when(~F.col("has_fields"), 0.35 * F.col("m") / 2).when(F.col("c") > 0, F.least(F.lit(1.0), conf)).otherwise(F.least(F.lit(1.0), conf) * 0.45)
    full = full.withColumn("confidence", conf).where("confidence >= 0.15")
    return full.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence"), "profile_order"))).where("rn = 1").select(*key, "profile_id", F.round("confidence", 6).alias("confidence"))


def choose_resource(resources: DataFrame, package: str) -> DataFrame:
    """Per package the newest active CSV resource, else JSON, else any in a data store, else none.

    ``resources`` has resource_id, format, active and modified (text; the greatest is the newest)."""
    fmt = F.lower(F.coalesce("format", F.lit("")))
    kind = F.when(F.contains(fmt, F.lit("csv")) & F.col("active"), 3).when(F.contains(fmt, F.lit("json")), 2).when(F.col("active"), 1).otherwise(0)
    best = resources.withColumn("__k", kind).where("__k > 0").groupBy(package).agg(F.max(F.struct("__k", F.coalesce("modified", F.lit("")).alias("m"), "resource_id")).alias("b"))
    return best.select(package, F.col("b.resource_id").alias("resource_id"), F.col("b.__k").alias("kind"))


def reasons(text: Column, terms: dict[str, int], most: int = 3) -> Column:
    """The first ``most`` terms that a text holds, in order of the table of terms."""
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms])), 1, most)


def candidate_label(score: Column, title: Column, why: Column) -> Column:
    """``score · title — reasons``: the score in three digits, the title cut at 100 characters, the whole at 150."""
    tail = F.when(F.size(why) > 0, F.concat(F.lit(" — "), F.array_join(F.slice(why, 1, 3), ", "))).otherwise("")
    return F.substring(F.concat(F.format_string("%03d", score), F.lit(" · "), F.substring(title, 1, 100), tail), 1, 150)


def merge_packs(packs: list[tuple[str, int, DataFrame]], version: int = 1) -> DataFrame:
    """alias, metric_id, metric_order, language of an ontology and its language packs; the first pack with an alias of a
    metric gives its language. ``packs`` are (language, version, aliases with alias, metric_id and metric_order); a pack
    of another version is an error."""
    for language, v, _ in packs:
        if v != version:
            raise ValueError(f"version {v} of the pack {language} is not supported")
    every = [df.select("alias", "metric_id", "metric_order", F.lit(i).alias("__i"), F.lit(language).alias("language")) for i, (language, _, df) in enumerate(packs)]
    merged = union_all(every).where("alias is not null and metric_id is not null")
    return merged.groupBy("alias", "metric_id").agg(F.min("metric_order").alias("metric_order"), F.min_by("language", "__i").alias("language"))
