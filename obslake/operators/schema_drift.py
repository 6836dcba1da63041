"""Problem 5: schemas that drift between snapshots: the list of changes, and all rows in one consistent table.

A catalogue of column lifespans is built per dataset and field name, from listed fields, fingerprints or the footers of
files: the islands of consecutive snapshots that have the field, by the snapshots before and after each. Where an island
starts or ends beside an existing snapshot a field was added or removed, unless a start and an end at the same snapshot are
one field under two names; changes of type class lie inside an island. Starts and ends are paired by rank within what they
have in common, in one aggregate each, without a join. Renames chain lifespans to one column, whose casts follow from the
classes of the type alias table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obslake.tables import checkpointed, lookup_join, spread

NAME = ["dataset_id", "name"]


def footer_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the Parquet files below ``folder``, one subfolder per dataset, from their footers alone.

    Rows (dataset_id, snapshot_no, ordinal, name, label, description, data_type, captured_at) as in a list of fields: a
    dataset's files are its snapshots, numbered from 1 in order of their names; label and description are those of the
    field's metadata, if it has any. Executors read the footers, whole files are never read. Files that are no Parquet
    have no fields.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("modificationTime").alias("captured_at"))
    files = files.select("captured_at", "path", F.element_at(F.split("path", "/"), -2).alias("dataset_id"), F.element_at(F.split("path", "/"), -1).alias("__file"))
    files = files.withColumn("snapshot_no", F.row_number().over(Window.partitionBy("dataset_id").orderBy("__file", "path"))).drop("__file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for at, path, dataset, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, inside = fs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
                try:
                    schema = pq.read_schema(inside, filesystem=system)
                except pa.ArrowInvalid:
                    continue
                for k, f in enumerate(schema):
                    own = {x.decode(): y.decode() for x, y in (f.metadata or {}).items()}
                    rows.append((dataset, number, k + 1, f.name, own.get("label"), own.get("description"), str(f.type), at))
            cols = list(zip(*rows)) or [()] * 8
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), batch.schema.field(0).type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["dataset_id", "snapshot_no", "ordinal", "name", "label", "description", "data_type", "captured_at"])

    return spread(files).mapInArrow(read, "dataset_id string, snapshot_no int, ordinal int, name string, label string, description string, data_type string, captured_at timestamp")


def snapshot_fields(listed: DataFrame, fingerprints: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per dataset, snapshot and field name: label, description, data_type, ordinal, type_class.

    Fields come from ``listed``; for a snapshot it doesn't list, from the schema_json of ``fingerprints`` ([name, type]
    pairs; unreadable JSON gives no fields), without label and description. Repeated rows count once; if rows of one
    field differ, the least label, description and type are taken. Rows with null names are ignored. A type that
    ``aliases`` lacks is its own class.
    """
    none = F.lit(None).cast("string")
    own = listed.where("dataset_id is not null and snapshot_no is not null and name is not null").select("dataset_id", "snapshot_no", "name", F.lit(1).alias("__own"), "label", "description", "data_type", "ordinal")
    pairs = fingerprints.where("dataset_id is not null and snapshot_no is not null").select("dataset_id", "snapshot_no", F.posexplode(F.from_json("schema_json", "array<array<string>>")).alias("ordinal", "f"))
    pairs = pairs.where(F.col("f")[0].isNotNull()).select("dataset_id", "snapshot_no", F.col("f")[0].alias("name"), F.lit(0).alias("__own"), none.alias("label"), none.alias("description"), F.get("f", F.lit(1)).alias("data_type"), "ordinal")
    fields = own.unionByName(pairs).groupBy("dataset_id", "snapshot_no", "name", "__own").agg(*[F.min(c).alias(c) for c in ("label", "description", "data_type", "ordinal")])
    fields = fields.withColumn("__any", F.max("__own").over(Window.partitionBy("dataset_id", "snapshot_no"))).where("__own = __any").drop("__own", "__any").withColumn("__type", F.lower(F.trim("data_type")))
    classes = aliases.groupBy(F.lower(F.trim("data_type")).alias("__type")).agg(F.min("type_class").alias("type_class"))
    return lookup_join(fields, classes, ["__type"]).withColumn("type_class", F.coalesce("type_class", "__type")).drop("__type")


def lifespans(fields: DataFrame) -> DataFrame:
    """The fields with ``since`` and ``until``, the first and last snapshot of their island, ``starts`` and ``ends``:
    whether the field comes with this snapshot or goes after it while the dataset has the snapshot before or after, and
    ``old_class``, a struct of the type class one snapshot earlier, null if it isn't there."""
    along = Window.partitionBy("dataset_id").orderBy("snapshot_no")
    beside = lambda c, step, w: F.coalesce((F.lag(c) if step < 0 else F.lead(c)).over(w) == F.col(c) + step, F.lit(False))
    snaps = fields.select("dataset_id", "snapshot_no").distinct().select("*", beside("snapshot_no", -1, along).alias("__prev"), beside("snapshot_no", 1, along).alias("__next"))
    out = lookup_join(fields, snaps, ["dataset_id", "snapshot_no"], "inner")
    order = Window.partitionBy(*NAME).orderBy("snapshot_no")
    here = out.select(
        "*",
        beside("snapshot_no", -1, order).alias("__had"),
        beside("snapshot_no", 1, order).alias("__has"),
        F.lag("type_class").over(order).alias("__class"),
    )
    whole = order.rowsBetween(Window.unboundedPreceding, 0)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    return here.select(
        *fields.columns,
        F.last(F.when(~F.col("__had"), F.col("snapshot_no")), True).over(whole).alias("since"),
        F.first(F.when(~F.col("__has"), F.col("snapshot_no")), True).over(rest).alias("until"),
        (F.col("__prev") & ~F.col("__had")).alias("starts"),
        (F.col("__next") & ~F.col("__has")).alias("ends"),
        F.when(F.col("__had"), F.struct(F.col("__class").alias("c"))).alias("old_class"),
    )


def changes(spans: DataFrame) -> DataFrame:
    """Rows (dataset_id, snapshot_no, old_name, new_name, change): added, removed, renamed or type_class.

    A renamed field is an end and a start at one snapshot with the same label, or else the same description; each field
    is renamed at most once in a snapshot, in order of names on ties. A snapshot without its predecessor has no changes.
    """
    name, none, n = F.col("name"), F.lit(None).cast("string"), F.col("snapshot_no")
    event = lambda when, at, old, new: F.when(when, F.struct(at.alias("at"), old.alias("old_name"), new.alias("new_name")))
    retyped = F.col("old_class").isNotNull() & ~F.col("old_class.c").eqNullSafe(F.col("type_class"))
    found = F.array(event(F.col("starts"), n, none, name), event(F.col("ends"), n + 1, name, none), event(retyped, n, name, name))
    events = spans.select("dataset_id", "label", "description", F.inline(F.filter(found, lambda x: x.isNotNull()))).withColumnRenamed("at", "snapshot_no")
    key = ["dataset_id", "snapshot_no"]

    def paired(df: DataFrame, by: str) -> DataFrame:
        """Starts and ends with the same value of ``by``: the k-th of each become one row; all else is left as it is."""
        old, new = F.col("old_name"), F.col("new_name")
        # what has nothing in common with others, or is done, is a group of its own
        own = F.concat_ws("\0", F.lit("own"), F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")))
        common = F.when(F.col(by).isNotNull() & (old.isNull() | new.isNull()), F.concat(F.lit("by\0"), F.col(by))).otherwise(own)
        rank = Window.partitionBy(*key, "__by", old.isNull()).orderBy(F.coalesce(old, new))
        ranked = df.withColumn("__by", common).withColumn("__k", F.row_number().over(rank))
        return ranked.groupBy(*key, "__by", "__k").agg(*[F.max(c).alias(c) for c in ("old_name", "new_name", "label", "description")]).drop("__by", "__k")

    out = paired(paired(events, "label"), "description")
    old, new = F.col("old_name"), F.col("new_name")
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "type_class").otherwise("renamed")
    return out.select(*key, F.coalesce(old, F.lit("")).alias("old_name"), F.coalesce(new, F.lit("")).alias("new_name"), change.alias("change"))


def _common(classes: Column) -> Column:
    """The class that holds all values of several: itself if one, number for integers and numbers, else text."""
    return F.when(F.size(classes) == 1, classes[0]).when(F.size(F.array_except(classes, F.array(F.lit("integer"), F.lit("number")))) == 0, F.lit("number")).otherwise(F.lit("text"))


def columns(spans: DataFrame, renamed: DataFrame) -> DataFrame:
    """Rows (dataset_id, snapshot_no, name, column_name, column_class): the consistent column of every field.

    Lifespans linked by renames are one column, with the name of its last lifespan and the class that holds all its
    values. Links are followed by doubling, so a chain of n renames takes log2(n) rounds. All joins are merged: the planner takes
    a table for as small as its compressed file and would broadcast millions of fields through the driver. Two columns that would get one
    name get the snapshot they begin with appended, but for the one that begins last.
    """
    span = spans.select("dataset_id", "name", "since", "until").distinct()
    link = renamed.select("dataset_id", F.col("new_name").alias("name"), F.col("snapshot_no").alias("since"), F.col("old_name"), (F.col("snapshot_no") - 1).alias("until_old"))
    old = span.select("dataset_id", F.col("name").alias("old_name"), F.col("until").alias("until_old"), F.col("since").alias("old_since"))
    node = lambda n, s: F.struct(F.col(n).alias("name"), F.col(s).alias("since"))
    parent = link.join(old.hint("merge"), ["dataset_id", "old_name", "until_old"]).select("dataset_id", node("name", "since").alias("node"), node("old_name", "old_since").alias("root"))
    roots = span.select("dataset_id", node("name", "since").alias("node"), "until").join(parent.hint("merge"), ["dataset_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    longest = spans.agg(F.max(F.col("until") - F.lit(0)) - F.min("since")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length())):
        up = roots.select("dataset_id", F.col("node").alias("root"), F.col("root").alias("__up"))
        roots = checkpointed(roots.join(up.hint("merge"), ["dataset_id", "root"], "left").select("dataset_id", "node", "until", F.coalesce("__up", "root").alias("root")))
    tagged = spans.join(roots.select("dataset_id", F.col("node.name").alias("name"), F.col("node.since").alias("since"), "root").hint("merge"), ["dataset_id", "name", "since"])
    column = tagged.groupBy("dataset_id", "root").agg(F.max_by("name", F.struct("snapshot_no", "name")).alias("column_name"), F.sort_array(F.collect_set("type_class")).alias("__classes"))
    same = Window.partitionBy("dataset_id", "column_name").orderBy(F.desc("root.since"), F.desc("root.name"))
    column = column.withColumn("column_name", F.when(F.row_number().over(same) > 1, F.concat("column_name", F.lit("@"), F.col("root.since"))).otherwise(F.col("column_name")))
    return tagged.join(column.select("dataset_id", "root", "column_name", _common(F.col("__classes")).alias("column_class")).hint("merge"), ["dataset_id", "root"]).select("dataset_id", "snapshot_no", "name", "column_name", "column_class")


def _cast(value: Column, kind: Column) -> Column:
    """A value's text in the normal form of its class; text that isn't of the class stays as it is."""
    t = F.trim(value)
    flag = F.when(F.lower(t).isin("true", "t", "yes", "y", "1"), F.lit("true")).when(F.lower(t).isin("false", "f", "no", "n", "0"), F.lit("false"))
    return (
        F.when(kind == "integer", F.coalesce(t.try_cast("long").cast("string"), value))
        .when(kind == "number", F.coalesce(t.try_cast("double").cast("string"), value))
        .when(kind == "boolean", F.coalesce(flag, value))
        .otherwise(value)
    )


def consistent_rows(rows: DataFrame, column_map: DataFrame) -> DataFrame:
    """The rows with ``record``, a map from consistent column names to values, cast to the columns' classes.

    All rows are kept. Every column of the row's snapshot is there, null where the payload lacks it; payload keys that
    no field lists are kept under their own name as text, unless a column has it. Unreadable payloads give only nulls.
    """
    per = column_map.groupBy("dataset_id", "snapshot_no").agg(F.sort_array(F.collect_set(F.struct("name", "column_name", "column_class"))).alias("__columns"))
    out = lookup_join(rows.drop("record").withColumn("__values", F.from_json("payload", "map<string,string>")), per, ["dataset_id", "snapshot_no"])
    cols = F.coalesce("__columns", F.array().cast("array<struct<name:string,column_name:string,column_class:string>>"))
    mapped = F.transform(cols, lambda c: F.struct(c["column_name"].alias("key"), _cast(F.col("__values")[c["name"]], c["column_class"]).alias("value")))
    listed = F.concat(F.transform(cols, lambda c: c["name"]), F.transform(cols, lambda c: c["column_name"]))
    rest = F.filter(F.map_entries(F.coalesce("__values", F.create_map().cast("map<string,string>"))), lambda e: ~F.array_contains(listed, e["key"]))
    return out.withColumn("record", F.map_from_entries(F.concat(mapped, rest))).drop("__values", "__columns")
