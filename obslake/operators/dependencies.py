"""Approximate functional dependencies between fields and nested dimensions, in one scan.

Every row is exploded to its ordered pairs of fields; per pair and value it is enough to know the least and the greatest
partner, which partial aggregation reduces before the shuffle. How many distinct values a field has in a pair is how many
groups the reversed pair has, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslake.functions import values as V


def pair_groups(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (det, dep, v, single, only, n): per ordered pair of fields and value of the first, whether it has one partner."""
    cells = {c: V.present_text(c) for c in fields}
    pairs = F.array(*[F.struct(F.lit(a).alias("det"), F.lit(b).alias("dep"), cells[a].alias("v"), cells[b].alias("w")) for a in fields for b in fields if a != b])
    rows = df.select(*fields).select(F.inline(pairs)).where("v is not null and w is not null")
    return rows.groupBy("det", "dep", "v").agg((F.min("w") == F.max("w")).alias("single"), F.min("w").alias("only"), F.count("*").alias("n"))


def functional_dependencies(df: DataFrame, fields: list[str], least_values: int = 2, least_confidence: float = 0.95) -> DataFrame:
    """determinant, dependent, determinant_values, dependent_values, confidence: dependencies that nearly always hold and
    whose dependent varies. Rows with a missing part don't count for a pair."""
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string, determinant_values long, dependent_values long, confidence double")
    per = pair_groups(df, fields).groupBy("det", "dep").agg(F.count("*").alias("k"), F.avg(F.col("single").cast("double")).alias("confidence"))
    back = per.select(F.col("dep").alias("det"), F.col("det").alias("dep"), F.col("k").alias("kd"))  # one row per pair of fields
    out = per.join(F.broadcast(back), ["det", "dep"]).where((F.col("k") >= max(2, least_values)) & (F.col("confidence") >= least_confidence) & (F.col("kd") > 1))
    return out.select(F.col("det").alias("determinant"), F.col("dep").alias("dependent"), F.col("k").alias("determinant_values"), F.col("kd").alias("dependent_values"), "confidence")


def dimension_relationships(df: DataFrame, fields: list[str], least_confidence: float = 0.8) -> DataFrame:
    """child, parent, confidence, coverage, parent_values, child_values: direct nestings of child values in parents.

    A child field nests if nearly all its values have one parent, some parent has several such children and there are
    fewer parents than children. Nestings that go through a third field of about the same confidence are left out.
    """
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], "child string, parent string, confidence double, coverage double, parent_values long, child_values long")
    groups = pair_groups(df, fields)
    shared = groups.where("single").groupBy("det", "dep", "only").agg(F.count("*").alias("c")).groupBy("det", "dep").agg(F.max("c").alias("most"))
    per = groups.groupBy("det", "dep").agg(F.count("*").alias("k"), F.avg(F.col("single").cast("double")).alias("stability"), F.sum("n").alias("complete"))
    back = per.select(F.col("dep").alias("det"), F.col("det").alias("dep"), F.col("k").alias("kp"))
    own = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("det"), V.present_text(c).alias("v")) for c in fields]))).where("v is not null").groupBy("det").agg(F.count_distinct("v").alias("all_values"))
    rel = per.join(F.broadcast(back), ["det", "dep"]).join(F.broadcast(shared), ["det", "dep"]).join(F.broadcast(own), "det")
    coverage = F.col("k") / F.col("all_values")
    rel = rel.where((F.col("all_values") >= 2) & (F.col("complete") >= 3) & (F.col("k") >= 2) & (F.col("kp") < F.col("k")) & (F.col("most") > 1) & (F.col("stability") * coverage >= least_confidence))
    rel = rel.select(F.col("det").alias("child"), F.col("dep").alias("parent"), F.bround(F.col("stability") * coverage, 3).alias("confidence"), F.bround(coverage, 3).alias("coverage"), F.col("kp").alias("parent_values"), F.col("k").alias("child_values"))
    a = rel.select("child", F.col("parent").alias("middle"), F.col("confidence").alias("c1"))
    b = rel.select(F.col("child").alias("middle"), "parent", F.col("confidence").alias("c2"))
    through = a.join(F.broadcast(b), "middle").groupBy("child", "parent").agg(F.max(F.least("c1", "c2")).alias("via"))
    return rel.join(F.broadcast(through), ["child", "parent"], "left").where("via is null or via < confidence - 0.05").drop("via")
