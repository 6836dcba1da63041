"""What is kept of results: statistics written once, latest values, attributes, reports, prepared catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslake.functions import values as V

TEXT_CUT, ATTRIBUTES = 255, 30


def once_per_bucket(incoming: DataFrame, written: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose key isn't written yet: a bucket is written once and never revised."""
    return incoming.join(written.select(*key).distinct(), key, "left_anti")


def cut(c: Column | str, most: int = TEXT_CUT) -> Column:
    return F.substring(V.text(c), 1, most)


def attributes(df: DataFrame, columns: list[str], most: int = ATTRIBUTES) -> Column:
    """JSON of the first ``most`` present values of the columns, texts cut at 255 characters."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), cut(c).alias("v")) for c in columns]), lambda x: x["v"].isNotNull())
    return F.to_json(F.map_from_arrays(F.transform(F.slice(pairs, 1, most), lambda x: x["k"]), F.transform(F.slice(pairs, 1, most), lambda x: x["v"])))


def unreported(reports: DataFrame, sent: DataFrame, key: list[str], content: str) -> DataFrame:
    """Reports whose content's SHA-256 isn't the one last sent for their key; ``sent`` has the key and digest."""
    own = reports.withColumn("digest", F.sha2(F.col(content), 256))
    return own.join(sent.select(*key, "digest"), [*key, "digest"], "left_anti")


def stale_keys(kept: DataFrame, selected: DataFrame, key: list[str]) -> DataFrame:
    """Kept rows whose key is no longer selected."""
    return kept.join(selected.select(*key).distinct(), key, "left_anti")


def portal_key(c: Column) -> Column:
    """Trimmed, lower case, without final slashes."""
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")


def prepared(catalogs: DataFrame, running: Column) -> DataFrame:
    """Prepared catalogs after a restart: what was still running has failed."""
    return catalogs.withColumn("status", F.when((F.col("status") == "running") & ~running, "failed").otherwise(F.col("status"))).withColumn("portal_key", portal_key(F.col("portal_url")))


def choose_source(api: DataFrame, file: DataFrame, ts: str, stale_after_s: Column) -> DataFrame:
    """One row api_latest, file_latest, source: the file if either has no time or the interface lags by the threshold."""
    both = api.agg(F.max(ts).alias("api_latest")).crossJoin(F.broadcast(file.agg(F.max(ts).alias("file_latest"))))
    lag = (F.unix_micros(F.col("file_latest").cast("timestamp")) - F.unix_micros(F.col("api_latest").cast("timestamp"))) / 1e6
    return both.select("api_latest", "file_latest", F.when(lag.isNull() | (lag >= stale_after_s), "file").otherwise("api").alias("source"))


def status(registered: DataFrame, rows: DataFrame, key: list[str], arrived: str) -> DataFrame:
    """key, status, rows, latest per registered source: data_available if it has a row, else no_data; the newest arrival."""
    seen = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.max(arrived).alias("latest"))
    out = registered.select(*key).distinct().join(seen, key, "left")
    return out.select(*key, F.when(F.col("rows") > 0, "data_available").otherwise("no_data").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "latest")
