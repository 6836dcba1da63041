"""Population estimates, physical ordering, retrieval plans and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslake.functions import values as V
from obslake.tables import shards_for



def chao1(df: DataFrame, entity: str) -> DataFrame:
    """One row: observed entities, Chao1 estimate, singletons, doubletons, rows, unseen and confidence (3 digits)."""
    per = df.where(V.present(entity)).groupBy(V.text(entity).alias("e")).agg(F.count("*").alias("c"))
    s = per.agg(F.count("*").alias("observed"), F.count_if(F.col("c") == 1).alias("f1"), F.count_if(F.col("c") == 2).alias("f2"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    unseen = F.when(F.col("observed") == 0, 0.0).when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2.0 * F.col("f2"))).otherwise(F.col("f1") * F.greatest(F.col("f1") - 1, F.lit(0)) / 2.0)
    s = s.withColumn("unseen", unseen)
    return s.select(
        "observed",
        F.greatest(F.col("observed"), F.ceil(F.col("observed") + F.col("unseen"))).alias("estimated"),
        F.col("f1").alias("singletons"),
        F.col("f2").alias("doubletons"),
        F.col("n").alias("sample_rows"),
        F.bround("unseen", 3).alias("unseen"),
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("f1") / F.greatest(F.col("n"), F.lit(1)))), 3).alias("confidence"),
    )


def with_previous(df: DataFrame, seq: str, columns: list[str], shards: int | None = None) -> DataFrame:
    """Adds ``prev_<column>``, the values of the row before in the order of ``seq`` (a number, unique).

    The order is cut into ranges of seq, as many as the number of rows asks for, that are looked at independently; each gets its predecessor's last row from a
    table of one row per range. No range holds more than its share, unless seq is very uneven.
    """
    lo, hi, rows = df.agg(F.min(seq), F.max(seq), F.count("*")).first()
    shards = shards or shards_for(rows)
    if lo is None:
        return df.select("*", *[F.col(c).alias(f"prev_{c}") for c in columns])
    width = max((float(hi) - float(lo)) / shards, 1e-9)
    cut = df.withColumn("__s", F.floor((F.col(seq) - F.lit(lo)) / F.lit(width)).cast("int"))
    order = Window.partitionBy("__s").orderBy(seq)
    row = F.struct(*[F.col(c) for c in columns])
    last = cut.groupBy("__s").agg(F.max_by(row, seq).alias("__l"))
    before = last.select("__s", F.lag("__l").over(Window.orderBy("__s")).alias("__before"))  # one row per range
    out = cut.withColumn("__p", F.lag(row).over(order)).join(F.broadcast(before), "__s")
    prev = F.coalesce("__p", "__before")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def physical_ordering(df: DataFrame, seq: str, ts: str | None, entity: str | None) -> DataFrame:
    """One row: row count, shares of adjacent pairs, and ordering (time_ascending, time_descending, entity_grouped,
    effectively_random or unknown). Pairs without both times don't count; entities are compared over rows that have one."""
    n = df.agg(F.count("*").alias("row_count"))
    out = n
    if ts:
        pairs = with_previous(df.select(seq, ts), seq, [ts]).where(F.col(ts).isNotNull() & F.col(f"prev_{ts}").isNotNull())
        out = out.crossJoin(F.broadcast(pairs.agg(F.avg((F.col(f"prev_{ts}") <= F.col(ts)).cast("double")).alias("ascending"), F.avg((F.col(f"prev_{ts}") >= F.col(ts)).cast("double")).alias("descending"))))
    else:
        out = out.select("*", F.lit(None).cast("double").alias("ascending"), F.lit(None).cast("double").alias("descending"))
    if entity:
        own = df.where(V.present(entity)).select(seq, V.text(entity).alias("e"))
        same = with_previous(own, seq, ["e"]).where("prev_e is not null").agg(F.avg((F.col("e") == F.col("prev_e")).cast("double")).alias("adjacent_same"), (F.count("*") + 1).alias("entity_rows"))
        kinds = own.agg(F.min("e").alias("a"), F.max("e").alias("b")).select((F.col("a") != F.col("b")).alias("several"))
        out = out.crossJoin(F.broadcast(same)).crossJoin(F.broadcast(kinds))
    else:
        out = out.select("*", F.lit(None).cast("double").alias("adjacent_same"), F.lit(0).alias("entity_rows"), F.lit(False).alias("several"))
    ordering = (
        F.when(F.col("row_count") < 4, "unknown")
        .when(F.col("ascending") >= 0.9, "time_ascending")
        .when(F.col("descending") >= 0.9, "time_descending")
        .when((F.col("entity_rows") >= 4) & (F.col("adjacent_same") >= 0.6), "entity_grouped")
        .when((F.col("entity_rows") >= 4) & F.col("several") & (F.col("adjacent_same") <= 0.2), "effectively_random")
        .otherwise("unknown")
    )
    return out.select("row_count", "ascending", "descending", "adjacent_same", ordering.alias("ordering"))


def distinct_total(df: DataFrame, fields: list[str]) -> Column:
    """Sum of the distinct present values of fields, as an aggregate."""
    total = F.lit(0)
    for c in fields:
        total = total + F.count_distinct(V.present_text(c))
    return total


def retrieval_plan(df: DataFrame, entity: str, metric_dims: list[str], observation_dims: list[str], per_entity: int = 50, max_rows: int | None = 100_000) -> DataFrame:
    """One row: estimated entities, dimension multiplier, target rows, observations per entity."""
    sizes = df.agg(F.greatest(F.lit(1), distinct_total(df, metric_dims)).alias("m"), F.greatest(F.lit(1), distinct_total(df, observation_dims)).alias("o"))
    s = chao1(df, entity).select(F.greatest(F.lit(1), F.col("estimated")).alias("e")).crossJoin(sizes)
    wanted = F.col("e") * F.lit(max(1, per_entity)) * F.col("m") * F.col("o")
    target = F.least(F.lit(max(1, max_rows)), wanted) if max_rows is not None else wanted
    return s.select(F.col("e").alias("estimated_entities"), (F.col("m") * F.col("o")).alias("dimension_multiplier"), target.cast("long").alias("target_rows"), F.greatest(F.lit(1), F.ceil(target / F.col("e"))).cast("long").alias("observations_per_entity"))


def stratified_sample(df: DataFrame, entity: str, ts: str, seq: str, cap: int) -> DataFrame:
    """At most ``cap`` rows: in turn each entity's newest, oldest, second newest ... row.

    Of each entity only the first and last ``cap`` rows can be in the sample, so both ends are cut off below the shuffle.
    Rows without entity are one entity; rows without time are the newest, in the order of ``seq``.
    """
    d = df.withColumn("__e", F.coalesce(V.present_text(entity), F.lit("")))
    up = Window.partitionBy("__e").orderBy(F.asc_nulls_last(ts), F.asc(seq))
    down = Window.partitionBy("__e").orderBy(F.desc_nulls_first(ts), F.desc(seq))
    sizes = d.groupBy("__e").agg(F.count("*").alias("__n"))
    old = d.withColumn("__a", F.row_number().over(up) - 1).where(F.col("__a") <= cap).join(sizes, "__e").withColumn("__b", F.col("__n") - 1 - F.col("__a")).where("__a < __b")
    new = d.withColumn("__b", F.row_number().over(down) - 1).where(F.col("__b") <= cap).join(sizes, "__e").withColumn("__a", F.col("__n") - 1 - F.col("__b")).where("__b <= __a")
    both = old.unionByName(new)
    return both.orderBy(F.least("__a", "__b"), "__e", F.when(F.col("__b") <= F.col("__a"), 0).otherwise(1)).limit(cap).drop("__a", "__b", "__n", "__e")


def sampling_evidence(sample: DataFrame, source: DataFrame, entity: str, ts: str, requested: int) -> DataFrame:
    """One row: requested, source and sampled rows, entities, distinct times, first and last time, truncated."""
    own = sample.agg(F.count("*").alias("sampled_rows"), F.count_distinct(V.present_text(entity)).alias("entities"), F.count_distinct(ts).alias("times"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))
    total = source.agg(F.count("*").alias("source_rows"))
    return own.crossJoin(total).select(F.lit(requested).alias("requested"), "source_rows", "sampled_rows", "entities", "times", "first_time", "last_time", (F.col("source_rows") > F.col("sampled_rows")).alias("truncated"))
