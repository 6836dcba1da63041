"""Wide and long rows as semantic observation points; latest values and histories of streams."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.tables import spread

#: Names of unit columns, in order of preference.
UNIT_COLUMNS = ["unit", "units", "uom", "unit_of_measure", "measurement_unit", "unit_name"]


@dataclass(frozen=True)
class Roles:
    """Which columns of a table are what. ``names`` (columns whose values name the measurement) make it a long table."""

    unit: list[str]
    data: list[str]
    time: str | None = None
    seq: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    unit_column: str | None = None
    record_keys: list[str] = field(default_factory=list)
    record_labels: list[str] = field(default_factory=list)


#: Columns of points; a name column of the same name isn't kept beside them.
POINT = ("stream_id", "metric", "source_field", "value_text", "value", "ts", "seq", "unit", "record_id", "record_label")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def to_points(df: DataFrame, roles: Roles, selected: list[str] | None = None) -> DataFrame:
    """One row per row and data column: stream_id, <unit columns>, <name columns>, metric, source_field, value_text, value,
    ts, seq, unit, and with record keys or labels record_id, their reversible token (null if a part is missing), and
    record_label, the present labels joined.

    Null data are left out, and rows without unit. ``selected`` narrows the data columns before anything is read. Values
    that are no finite numbers keep their text and have a null value. Without order columns, time alone orders. Columns that
    a later step doesn't use cost nothing: numbers are not made texts, and ids not hashed, until they are asked for.
    """
    data = [c for c in roles.data if selected is None or c in selected]
    keep = list(dict.fromkeys([*roles.unit, *roles.names, *([roles.time] if roles.time else []), *roles.seq, *([roles.unit_column] if roles.unit_column else []), *roles.record_keys, *roles.record_labels]))
    numeric = all(t.startswith(NUMERIC) for c, t in df.dtypes if c in data)
    kind = "double" if numeric else "string"
    # a measure may order rows as well: it is copied before it is unpivoted
    base = spread(df).select(*keep, *[F.col(c).cast(kind).alias(f"__{c}") for c in data])
    for c in roles.unit:
        base = base.where(V.present(c))
    cells = base.unpivot(keep, [f"__{c}" for c in data], "source_field", "__v").where(F.col("__v").isNotNull()).withColumn("source_field", F.substring("source_field", 3, 1000))
    value = F.when(~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf"))), F.col("__v")) if numeric else V.to_number("__v")
    name = V.joined(*roles.names) if roles.names else F.col("source_field")
    if roles.names and len(data) > 1:
        name = F.concat_ws(" / ", name, "source_field")
    return cells.select(
        _stream_id(roles).alias("stream_id"),
        *dict.fromkeys([*roles.unit, *(c for c in roles.names if c not in POINT)]),
        name.alias("metric"),
        "source_field",
        V.text("__v").alias("value_text"),
        value.alias("value"),
        (F.col(roles.time) if roles.time else F.lit(None).cast("timestamp")).alias("ts"),
        F.struct(*[F.col(c) for c in roles.seq]).alias("seq") if roles.seq else F.struct(F.lit(0).alias("none")).alias("seq"),
        (F.col(roles.unit_column) if roles.unit_column else F.lit(None).cast("string")).alias("unit"),
        *([V.key_token(*roles.record_keys).alias("record_id")] if roles.record_keys else []),
        *([V.joined(*roles.record_labels).alias("record_label")] if roles.record_labels else []),
    )


def with_unit_column(roles: Roles, columns: list[str]) -> Roles:
    """The roles with the table's unit column, if it has one."""
    return replace(roles, unit_column=roles.unit_column or unit_column(columns))


def _stream_id(roles: Roles) -> Column:
    return V.stream_id(F.concat_ws("\u0001", *[V.text(c) for c in roles.unit]), *[F.col(c) for c in roles.names], F.col("source_field"))


def latest_streams(df: DataFrame, roles: Roles, selected: list[str] | None = None) -> DataFrame:
    """stream_id, <unit columns>, metric, source_field, ts, value, value_text, unit: the latest point of every stream.

    In two steps: by the identity as written, which is cheap to group by, then by stream_id, which makes one of spellings
    that mean the same. Ids are hashed once per written identity, not once per point.
    """
    points = to_points(df, roles, selected)
    written = list(dict.fromkeys([*roles.unit, *roles.names, "source_field"]))
    columns = ["ts", "seq", "value", "value_text", "unit"]
    once = latest(points, written, columns)
    name = V.joined(*roles.names) if roles.names else F.col("source_field")
    if roles.names and len(roles.data if selected is None else selected) > 1:
        name = F.concat_ws(" / ", name, "source_field")
    once = once.select(_stream_id(roles).alias("stream_id"), *roles.unit, name.alias("metric"), "source_field", *columns)
    return latest(once, ["stream_id"], [*roles.unit, "metric", "source_field", *columns]).drop("seq")


def unit_column(columns: list[str]) -> str | None:
    return next((c for n in UNIT_COLUMNS for c in columns if c.lower() == n), None)


def latest(points: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The latest point of each key: points with a time before others, then by time, then by order. An aggregate, so that a
    hot key is reduced before it is shuffled. ``columns`` of the chosen point are returned; None: all."""
    rest = [c for c in points.columns if c not in key] if columns is None else list(dict.fromkeys(c for c in columns if c not in key))
    rank = F.struct(F.col("ts").isNotNull().alias("a"), F.col("ts").alias("b"), F.col("seq").alias("c"))
    return points.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("__p")).select(*key, "__p.*")


def history(points: DataFrame, key: list[str]) -> DataFrame:
    """Numeric points, the last row of each stream and time."""
    return points.where("value is not null and ts is not null").groupBy(*key, "ts").agg(F.max_by("value", "seq").alias("value"))


def recent_history(points: DataFrame, key: list[str], most: int = 250) -> DataFrame:
    """The ``most`` latest points of each stream's history; the rank is pushed below the shuffle."""
    return history(points, key).withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts")))).where(F.col("rn") <= most).drop("rn")


def assembled(points: DataFrame, key: list[str], most: int = 250) -> DataFrame:
    """Every stream's latest ts and value with its bounded history: history_start, history_end and history_points (null
    and 0 for a stream without numbers in time)."""
    span = recent_history(points, key, most).groupBy(*key).agg(F.min("ts").alias("history_start"), F.max("ts").alias("history_end"), F.count("*").alias("history_points"))
    return latest(points, key, ["ts", "value", "value_text"]).join(span, key, "left").fillna(0, ["history_points"])


def latest_fields(df: DataFrame, key: list[str], data: list[str], order: list[str]) -> DataFrame:
    """key, metric, value: every measure of the latest row per key, a row of its own each; nulls stay. The state of a wide
    table without streams."""
    row = df.groupBy(*key).agg(F.max_by(F.struct(*data), F.struct(*order)).alias("__r")).select(*key, "__r.*")
    return row.unpivot(key, data, "metric", "value")


def distinct_rows(df: DataFrame, identity: str, others: list[str], limit: int = 200, most: int = 1000) -> DataFrame:
    """Distinct values of the identity and other fields, in order of all of them; the limit is kept between 1 and ``most``."""
    fields = list(dict.fromkeys([identity, *others]))
    return df.select(*fields).distinct().orderBy(*fields).limit(min(max(limit, 1), most))


def top_latest(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows per key in the given order, with their rank rn from 1; the rank is pushed below the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= k)


def new_keys(observed: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return observed.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")


def first_per_key(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key; rows with a missing key part are left out."""
    for c in key:
        df = df.where(V.present(c))
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("__r")).select(*key, "__r.*")


def disambiguate(labels: DataFrame, label: str, key: str, hierarchy: list[str]) -> DataFrame:
    """Adds ``unique_label``: labels of several keys get their hierarchy appended, else their key."""
    counts = labels.groupBy(label).agg(F.count("*").alias("__n"))
    path = F.nullif(V.joined(*hierarchy), F.lit("")) if hierarchy else F.lit(None).cast("string")
    shown = F.when(F.col("__n") > 1, F.concat_ws(" — ", F.col(label), F.coalesce(path, V.text(key)))).otherwise(F.col(label))
    return labels.join(counts, label).withColumn("unique_label", shown).drop("__n")
