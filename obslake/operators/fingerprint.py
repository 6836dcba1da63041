"""Fingerprints of a dataset's analysis and the decision to analyse it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslake.functions import values as V

VALUES_PER_DIMENSION = 64
COOLDOWN_S, BACKOFF_S = 24 * 3600, 6 * 3600


def dimension_values(df: DataFrame, fields: list[str], most: int = VALUES_PER_DIMENSION) -> DataFrame:
    """field, dimension_values: the first ``most`` canonical values of each field in order, joined by |.

    Values are made distinct before they are ordered, and only the first of each field are gathered."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(V.squeeze(c)).alias("v")) for c in fields])
    from pyspark.sql import Window

    distinct = df.select(F.inline(cells)).where("v is not null and v != ''").distinct()
    first = distinct.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy("v"))).where(F.col("rn") <= most)
    return first.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("dimension_values"))


def fingerprint(df: DataFrame, schema: list[tuple[str, str]], roles: dict[str, str], metrics: list[str], dimensions: list[str], coordinates: str = "none", ordering: str = "unknown") -> DataFrame:
    """One row: the parts of the fingerprint as texts and ``digest``, the SHA-256 over them."""
    flat = lambda pairs: "|".join(f"{a}:{b}" for a, b in sorted(pairs))
    dims = dimension_values(df, dimensions).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "dimension_values"))), ";").alias("dimensions"))
    parts = dims.select(F.lit(flat(schema)).alias("schema"), F.lit(flat(roles.items())).alias("roles"), F.lit("|".join(sorted(" ".join(m.split()).casefold() for m in metrics))).alias("metrics"), "dimensions", F.lit(coordinates).alias("coordinates"), F.lit(ordering).alias("ordering"))
    return parts.withColumn("digest", F.sha2(F.concat_ws("\n", "schema", "roles", "metrics", "dimensions", "coordinates", "ordering"), 256))


def decide(state: DataFrame, current: DataFrame, key: str, now_s: Column, manual: bool | Column = False) -> DataFrame:
    """key, should_run, reason per dataset of ``current``.

    ``state`` has key, digest, the fingerprint's parts, last_attempt_s and failed; ``current`` key, digest and the parts.
    """
    parts = [("schema", "schema_changed"), ("roles", "field_roles_changed"), ("metrics", "metric_coverage_changed"), ("dimensions", "dimension_coverage_changed"), ("coordinates", "coordinate_interpretation_changed"), ("ordering", "physical_ordering_changed")]
    old = state.select(key, *[F.col(c).alias(f"old_{c}") for c in ("digest", *(p for p, _ in parts))], "last_attempt_s", "failed")
    both = current.join(old, key, "left")
    wait = F.when(F.col("failed"), BACKOFF_S).otherwise(COOLDOWN_S)
    reason = F.when(manual if isinstance(manual, Column) else F.lit(manual), "manual_request").when(F.col("old_digest").isNull(), "initial_analysis").when(F.col("old_digest") == F.col("digest"), "unchanged").when(now_s < F.col("last_attempt_s") + wait, "cooldown")
    for p, r in parts:
        reason = reason.when(~F.col(p).eqNullSafe(F.col(f"old_{p}")), r)
    return both.withColumn("reason", reason).select(key, (~F.col("reason").isin("unchanged", "cooldown")).alias("should_run"), "reason")


STATE = "digest string, schema string, roles string, metrics string, dimensions string, coordinates string, ordering string, last_attempt_s double, failed boolean"


def dump_state(df: DataFrame, key: str) -> DataFrame:
    """key, state: the state of each dataset as JSON."""
    names = [c.split()[0] for c in STATE.split(", ")]
    return df.select(key, F.to_json(F.struct(*names)).alias("state"))


def load_state(df: DataFrame, key: str, state: str) -> DataFrame:
    """The states of dump_state(); what can't be read has no digest, as a dataset that was never analysed."""
    read = F.from_json(state, STATE, {"mode": "PERMISSIVE"})
    out = df.select(key, read.alias("s")).select(key, "s.*")
    return out.withColumn("last_attempt_s", F.coalesce("last_attempt_s", F.lit(0.0))).withColumn("failed", F.coalesce("failed", F.lit(False)))
