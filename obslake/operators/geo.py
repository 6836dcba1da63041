"""Coordinates: evidence, distance, ranking by proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslake.functions import values as V

EARTH_KM = 6371.0088
# Names of coordinate columns that are worth asking for, and those that tell how a dataset gives coordinates.
LATITUDES, LONGITUDES, GEOMETRIES = ("latitude", "lat", "y_lat", "y_latitude"), ("longitude", "lon", "lng", "long", "x_lon", "x_longitude"), ("geometry", "geom", "the_geom", "location")
MODE_LATITUDES, MODE_LONGITUDES, MODE_GEOMETRIES = ("latitude", "lat", "y_wgs84"), ("longitude", "lon", "lng", "x_wgs84"), ("geometry", "geom", "geolocation", "location")


GEOMETRY_TYPES = ("point", "multipoint", "line", "linestring", "multilinestring", "polygon", "multipolygon", "geometry", "geometrycollection")


def coordinate_fields(fields: list[str]) -> list[str]:
    """The fields that are named as coordinates or geometries, in order."""
    return [f for f in fields if f.casefold() in (*LATITUDES, *LONGITUDES, *GEOMETRIES)]


def coordinate_modes(fields: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, coordinate_mode, coordinate_fields per dataset: wgs84_fields with a latitude and a longitude, else geometry
    with a field of that kind, else none; and its fields named as coordinates, in order of name."""
    low = F.lower(name)
    has = lambda names: F.coalesce(F.bool_or(low.isin(*names)), F.lit(False))
    mode = F.when(has(MODE_LATITUDES) & has(MODE_LONGITUDES), "wgs84_fields").when(has(MODE_GEOMETRIES), "geometry").otherwise("none")
    # distinct names of a dataset are as many as its columns
    own = F.array_sort(F.collect_set(F.when(low.isin(*LATITUDES, *LONGITUDES, *GEOMETRIES), F.col(name))))
    return fields.groupBy(*key).agg(mode.alias("coordinate_mode"), F.array_join(own, "|").alias("coordinate_fields"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def geometry_type(c: Column) -> Column:
    """The kind of geometry, in small letters, that a GeoJSON text holds; null for other texts."""
    kind = F.lower(F.try_variant_get(F.try_parse_json(c), "$.type", "string"))
    return F.when(kind.isin(*GEOMETRY_TYPES), kind)


def geojson_point(c: Column) -> Column:
    """struct<lat, lon> of a GeoJSON point's text, else null."""
    v = F.try_parse_json(c)
    kind = F.try_variant_get(v, "$.type", "string")
    lon, lat = F.try_variant_get(v, "$.coordinates[0]", "double"), F.try_variant_get(v, "$.coordinates[1]", "double")
    return F.when((F.lower(kind) == "point") & valid(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def coordinate_evidence(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row present, valid_pairs, trusted: whether every pair with a value is a valid one."""
    y, x = V.to_number(lat), V.to_number(lon)
    some = V.present(lat) | V.present(lon)
    return df.agg(F.count_if(some).alias("present"), F.count_if(some & valid(y, x)).alias("valid_pairs")).select("present", "valid_pairs", ((F.col("present") > 0) & (F.col("present") == F.col("valid_pairs"))).alias("trusted"))


def rank_locations(df: DataFrame, lat: str, lon: str, home: tuple[float, float], order: list[str], trusted: bool | None = None) -> DataFrame:
    """The rows with distance_km, nearest first, rows without coordinates last, ties by the texts of ``order``.

    With coordinates that aren't trusted (of which one is invalid), only the texts order and distances are null.
    """
    if trusted is None:
        trusted = bool(coordinate_evidence(df, lat, lon).first()["trusted"])
    y, x = V.to_number(lat), V.to_number(lon)
    far = F.when(F.lit(trusted) & valid(y, x), haversine_km(F.lit(home[0]), F.lit(home[1]), y, x))
    keys = [F.lower(F.trim(F.coalesce(V.text(c), F.lit("")))) for c in order]
    return df.withColumn("distance_km", far).orderBy(F.asc_nulls_last("distance_km"), *keys)
