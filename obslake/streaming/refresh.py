"""Observation streams with Structured Streaming: buckets, discovery of new streams, refreshed latest values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obslake.operators import observations
from obslake.tables import union_all

#: Parts that tables kept by streams are cut into.
BUCKETS = 64
#: Their partition columns.
PART, VERSION = "__part", "__version"


def bucketed(points: DataFrame, key: list[str], ts: str, value: str, minutes: int, watermark: str | None = None) -> DataFrame:
    """Statistics per key and bucket of a stream. With a watermark, append mode emits each bucket once, when it is closed."""
    src = points.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark:
        src = src.withWatermark("__ts", watermark)
    return src.groupBy(*key, F.window("__ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")).select(*key, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "mean_value", "min_value", "max_value")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is available now and waits for its end."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps every batch under its number; one that is run again after a failure replaces what it wrote."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def snapshot(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all sources that can be read, with ``source``, and the errors of those that can't. If none can be read
    that is an error; a source counts as readable if its first row can be."""
    frames, errors = [], {}
    for name, read in sources.items():
        try:
            df = read()
            df.take(1)
            frames.append(df.withColumn("source", F.lit(name)))
        except Exception as e:  # noqa: BLE001 - whatever a source fails with is its error
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    if not frames:
        raise RuntimeError(f"no source can be read: {errors}")
    return union_all(frames), errors


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def discover(known_path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that appends to the table at ``known_path`` the keys it doesn't have; they are never removed. A batch that is
    run again after a failure adds nothing twice, for what it wrote is known then. The table is cut by a hash of the key,
    and a batch reads the parts that its keys are in."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(*key).distinct().withColumn(PART, _bucket(key))
        path, fs = _hadoop(spark, known_path)
        if fs.exists(path):
            # at most one row per bucket
            touched = [r[0] for r in keys.select(PART).distinct().collect()]
            schema = keys.schema
            keys = keys.join(spark.read.schema(schema).parquet(known_path).where(F.col(PART).isin(touched)), [*key, PART], "left_anti")
        keys.write.mode("append").partitionBy(PART).parquet(known_path)

    return sink


def _versions(spark: SparkSession, kept_path: str) -> dict[int, list[int]]:
    """The versions of each part, in order."""
    path, fs = _hadoop(spark, kept_path)
    out: dict[int, list[int]] = {}
    if fs.exists(path):
        for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept_path}/{PART}=*/{VERSION}=*")) or []:
            b, v = (int(x.split("=")[1]) for x in s.getPath().toString().rsplit("/", 2)[1:])
            out.setdefault(b, []).append(v)
    return {b: sorted(v) for b, v in out.items()}


def kept_latest(spark: SparkSession, kept_path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The latest points kept by refresh_latest(), as of the batch before ``before``; None if there are none."""
    newest = {b: max((x for x in v if before is None or x < before), default=None) for b, v in _versions(spark, kept_path).items() if buckets is None or b in buckets}
    paths = [f"{kept_path}/{PART}={b}/{VERSION}={v}" for b, v in newest.items() if v is not None]
    return spark.read.parquet(*paths) if paths else None


def refresh_latest(kept_path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest point of each stream, in parts by a hash of the key.

    A batch merges its points into the parts that its keys are in, as new versions named by its number, so one that is run
    again starts from the same points; batch numbers may be left out. Versions are deleted once two newer ones exist.
    ``batch`` has the key, ts, seq and what else is kept.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = observations.latest(batch, key).withColumn(PART, _bucket(key)).persist()
        touched = [r[0] for r in fresh.select(PART).distinct().collect()]
        old = kept_latest(spark, kept_path, n, touched)
        both = fresh.drop(PART) if old is None else fresh.drop(PART).unionByName(old)
        merged = observations.latest(both, key).withColumn(PART, _bucket(key)).withColumn(VERSION, F.lit(n))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, VERSION).parquet(kept_path)
        fresh.unpersist()
        for b, versions in _versions(spark, kept_path).items():
            for v in versions[:-2]:
                path, fs = _hadoop(spark, f"{kept_path}/{PART}={b}/{VERSION}={v}")
                fs.delete(path, True)

    return sink
