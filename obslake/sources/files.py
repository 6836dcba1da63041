"""File sources: CSV and JSON as loosely typed rows, JSON envelopes, corpora of dataset schemas, GTFS archives."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslake.tables import at_most

#: Splits of CSV files that may start inside quotes; which ones is known to every task.
MOST_SPLITS = 1_000_000

# Keys of the list of items in an envelope, in order; tables of a GTFS feed.
ENVELOPE_KEYS = ["features", "records", "results", "data", "items"]
GTFS_REQUIRED = ["agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt"]
GTFS_CALENDARS = ["calendar.txt", "calendar_dates.txt"]
# Bounds of the sample rows in a corpus entry: rows, characters of a text, items of a list, keys of a map, characters of its keys and of a row's.
SAMPLE_ROWS, TEXT_CHARS, LIST_ITEMS, MAP_KEYS, KEY_CHARS, ROW_KEY_CHARS = 5, 160, 10, 20, 80, 120


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, with whether their split starts inside quotes, as whole records (part 0), as the rest of
    a record that began in an earlier split (1), as a record that ends in a later one (2), or as a split that lies within
    a record (3)."""
    names = ["file", "start", "no", "part", "record"]
    at, no, first, inside, held = None, 0, True, False, []

    def close() -> list[tuple]:
        return [(*at, no, 3 if first else 2, "\n".join(held))] if held else []

    for batch in batches:
        out: list[tuple] = []
        for line, file, start, within in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (file, start) != at:
                out += close()
                at, no, first, inside, held = (file, start), 0, bool(within), bool(within), []
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                out.append((file, start, no, 1 if first else 0, "\n".join(held)))
                first, held = False, []
                no += 1
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=names)
    rest = list(zip(*close()))
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=names)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the first record; quoted line breaks allowed, cells missing at a row's end as empty
    texts, cells beyond the columns left out, blank lines passed over, a byte order mark dropped.

    Files are read in splits, however large. Whether a split starts inside quotes is told by the number of quotes before
    it: each split's count is summed up by a prefix scan, and a record that crosses splits is put together from its parts.
    All files have the columns of the first one by name; each begins with them. At most MOST_SPLITS splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "start").agg(F.sum(quotes).alias("q"))
    before = F.sum("q").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    open_ = per.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("within")).where("within")
    if not at_most(open_, MOST_SPLITS):
        raise ValueError("too many splits that start inside quotes")
    # a broadcast join keeps the lines of a split in order
    told = lines.join(F.broadcast(open_), ["file", "start"], "left").select("value", "file", "start", F.coalesce("within", F.lit(False)).alias("within"))
    found = told.mapInArrow(_records, "file string, start bigint, no bigint, part int, record string")
    whole = found.where("part = 0").select("file", "start", "no", "record")
    order = Window.partitionBy("file").orderBy("start", F.col("part") == 2)
    parts = found.where("part > 0").withColumn("begun", F.sum((F.col("part") == 2).cast("int")).over(order))
    crossed = parts.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("part") == 2).alias("opens"), "record"))).alias("x"), F.max(F.when(F.col("part") == 2, F.struct("start", "no"))).alias("k"))
    text = F.array_join(F.transform(F.array_sort(F.col("x")), lambda y: y["record"]), "\n")
    records = whole.unionByName(crossed.select("file", F.coalesce(F.col("k.start"), F.lit(0)).alias("start"), F.coalesce(F.col("k.no"), F.lit(0)).alias("no"), text.alias("record")))
    head = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s")).where("s = 0").groupBy("f").agg(F.first("value").alias("h")).orderBy("f").first()
    if head is None:
        return spark.createDataFrame([], "value string").limit(0)
    names = next(csv.reader([head["h"].lstrip("\ufeff").rstrip("\r")]), [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = records.where((F.col("start") > 0) | (F.col("no") > 0)).select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    return body.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " ") if all(n.isidentifier() for n in names) else schema.toDDL(), {"escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}).alias("r")).select("r.*").fillna("")


def shared_snapshot(spark: SparkSession, path: str, read: Callable[[], DataFrame], now_s: float, age_s: float = 900.0, force: bool = False) -> DataFrame:
    """The rows of ``read`` as kept below ``path``; read anew if what is kept is older than ``age_s`` or by ``force``.

    Every reader of one path has the same rows. Snapshots are named by their time; one that is being written isn't seen
    until it is whole, and older ones are deleted but for the last two.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getParent() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/at=*/_SUCCESS")) or [])]
    kept = sorted(int(p.getName().split("=")[1]) for p in done)
    if force or not kept or now_s - kept[-1] / 1000 > age_s:
        kept.append(int(now_s * 1000))
        read().write.mode("overwrite").parquet(f"{path}/at={kept[-1]}")
        for old in sorted(set(kept))[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/at={old}"), True)
    return spark.read.parquet(f"{path}/at={kept[-1]}")


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON files as texts for envelope_rows(), one per file, or with ``lines`` one per line, read in splits."""
    return spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "payload")


def envelope_rows(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of a JSON envelope: the named fields, cast, with ``geometry`` and ``feature_id`` as texts.

    Items are the payload itself if it is a list, else the first list among features, records, results, data, items. A
    field is taken from the item's properties or attributes if it has them, else from the item. Unreadable payloads, and
    such without a list, give no rows; other columns are kept.
    """
    v = F.try_parse_json(F.col(payload))
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ENVELOPE_KEYS]
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *lists)
    rest = [c for c in df.columns if c != payload]
    rows = df.select(*rest, F.explode(items).alias("__i"))
    item = F.col("__i")
    get = lambda name, kind: F.coalesce(*[F.try_variant_get(item, f"$.{p}{name}", kind) for p in ("properties.", "attributes.", "")])
    return rows.select(*rest, *[get(n, k).alias(n) for n, k in fields.items()], F.try_variant_get(item, "$.geometry", "string").alias("geometry"), F.coalesce(F.try_variant_get(item, "$.properties.feature_id", "string"), F.try_variant_get(item, "$.id", "string")).alias("feature_id"))


def corpus_entries(df: DataFrame, key: list[str], text: str, most: int) -> DataFrame:
    """Adds corpus_id, 20 hexadecimal digits of the SHA-256 of the key's lines, and the text cut at ``most`` characters."""
    lines = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return df.select("*", F.substring(F.sha2(lines, 256), 1, 20).alias("corpus_id"), F.substring(text, 1, most).alias("bounded_text"))


def _entries(m: Column, of: T.MapType, chars: int, most: int | None) -> Column:
    """The map's first ``most`` entries with keys cut; of keys that are the same then, the last stays."""
    listed = F.map_entries(m) if most is None else F.slice(F.map_entries(m), 1, most)
    e = F.transform(listed, lambda x: F.struct(F.substring(x["key"].cast("string"), 1, chars).alias("key"), bounded_value(x["value"], of.valueType).alias("value")))
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def bounded_value(c: Column, of: T.DataType) -> Column:
    """The value within the bounds of a corpus entry, at every depth; what is no number, list, map or structure is cut as a text."""
    if isinstance(of, (T.BooleanType, T.IntegralType, T.FractionalType, T.NullType)):
        return c
    if isinstance(of, T.ArrayType):
        return F.transform(F.slice(c, 1, LIST_ITEMS), lambda x: bounded_value(x, of.elementType))
    if isinstance(of, T.MapType):
        return _entries(c, of, KEY_CHARS, MAP_KEYS)
    if isinstance(of, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[bounded_value(c[f.name], f.dataType).alias(f.name[:KEY_CHARS]) for f in of.fields[:MAP_KEYS]]))
    return F.substring(c.cast("string"), 1, TEXT_CHARS)


def bounded_rows(df: DataFrame, rows: str) -> DataFrame:
    """df with its column of sample rows (an array of maps) bounded: the first 5 rows, all their keys, bounded values."""
    of = df.schema[rows].dataType.elementType
    return df.withColumn(rows, F.transform(F.slice(rows, 1, SAMPLE_ROWS), lambda r: _entries(r, of, ROW_KEY_CHARS, None)))


def common_fields(fields: DataFrame, entry: list[str], name: str, normal, most: int = 50) -> DataFrame:
    """field_name, n, unique_field_names: the most common names in normal form over the fields of all entries; ties by name.

    A field listed again in its entry counts once. How many names there are in all is counted before the cut."""
    per = fields.select(*entry, name).distinct().groupBy(normal(name).alias("field_name")).agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "field_name").limit(most).crossJoin(F.broadcast(per.agg(F.count("*").alias("unique_field_names"))))


def gtfs_members(content: pd.Series) -> pd.Series:
    def names(b: bytes | None) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                return [i.filename for i in z.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, TypeError):
            return None

    return content.map(names)


def gtfs_validate(df: DataFrame, content: str) -> DataFrame:
    """Adds members, missing (required tables that aren't there), has_calendar, nested, is_valid of a ZIP archive's bytes.

    Names count without folder and letter case; bytes that are no archive have null members and aren't valid."""
    listed = F.pandas_udf(gtfs_members, "array<string>")
    out = df.withColumn("members", listed(F.col(content)))
    base = F.transform("members", lambda x: F.lower(F.element_at(F.split(x, "[/\\\\]"), -1)))
    required = F.array(*[F.lit(x) for x in GTFS_REQUIRED])
    calendar = F.arrays_overlap(base, F.array(*[F.lit(x) for x in GTFS_CALENDARS]))
    missing: Column = F.array_except(required, base)
    return out.select("*", missing.alias("missing"), calendar.alias("has_calendar"), F.exists("members", lambda x: F.contains(x, F.lit("/"))).alias("nested"), F.coalesce((F.size(missing) == 0) & calendar, F.lit(False)).alias("is_valid"))
