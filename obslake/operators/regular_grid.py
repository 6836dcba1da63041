"""Problem 6: irregular readings as one series per source on the regular grid of its nominal interval.

Sources are cut into time shards of a fixed number of slots. Each shard is summarised by its first and last reading; a
prefix scan over the summaries gives each shard the reading that precedes it (and, from the other end, the one that
follows); with these boundary states all shards are filled independently. Only summaries are ordered per source, so a
source with a third of all readings is still spread over all its shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslake.functions.timestamps import div
from obslake.tables import checkpointed, lookup_join

SHARD_SLOTS = 512


def slot_grid(deployments: DataFrame, cadence: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows (source, cadence_ms, shard, slot): every slot of every deployment once, slots counted from 1970.

    ``deployments`` has source, active_from, active_to (exclusive); ``cadence`` has source, cadence_minutes. Deployments
    without an end or a start, of unknown interval, or with an interval below a minute have no slots; overlapping
    deployments have their common slots once; of several intervals of a source the least holds. Deployments are expanded to shards first and the shards are spread before
    they are expanded to slots, so one long deployment isn't one task.
    """
    step = F.col("cadence_minutes").cast("long") * 60_000
    spans = deployments.select("source", "active_from", "active_to").join(cadence.where("cadence_minutes >= 1").groupBy("source").agg(F.min("cadence_minutes").alias("cadence_minutes")), "source").select(
        "source",
        step.alias("cadence_ms"),
        div(F.unix_micros("active_from") + 999, 1000).alias("__from"),
        div(F.unix_micros("active_to") + 999, 1000).alias("__to"),
    )
    first = F.ceil(F.col("__from") / F.col("cadence_ms")).cast("long")
    last = F.ceil(F.col("__to") / F.col("cadence_ms")).cast("long") - 1
    spans = spans.select("source", "cadence_ms", first.alias("__a"), last.alias("__b")).where("__a <= __b")
    shards = spans.select("*", F.explode(F.sequence(div(F.col("__a"), shard_slots), div(F.col("__b"), shard_slots))).alias("shard"))
    shards = shards.repartition("source", "shard")
    low = F.greatest(F.col("__a"), F.col("shard") * shard_slots)
    high = F.least(F.col("__b"), F.col("shard") * shard_slots + (shard_slots - 1))
    slots = shards.select("source", "cadence_ms", "shard", F.explode(F.sequence(low, high)).alias("slot"))
    return slots.dropDuplicates(["source", "shard", "slot"])


def regular_series(readings: DataFrame, deployments: DataFrame, cadence: DataFrame, max_fill_slots: int | None = None, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows (source, slot_ms, readings, value, last_ms, next_ms, filled, status), one per slot of every deployment.

    ``readings`` has source, utc_us and value; rows with null source or utc_us are no readings, while a null value is a
    reading without value. ``value`` is the mean of a slot's values. ``last_ms`` and ``next_ms`` are the slots of the
    nearest readings at or before and at or after the slot within the deployments. ``filled`` is the value, or carried
    forward from the last reading with one that is at most ``max_fill_slots`` slots back (any number if None).
    ``status`` is observed, filled or empty; a slot without reading is empty or filled, and then ``last_ms`` is null or
    before the slot. Repeated rows count as readings, but don't change means of equal values. Readings outside every
    deployment are left out. No column depends on ``shard_slots``.
    """
    cadence = cadence.where("cadence_minutes >= 1").groupBy("source").agg(F.min("cadence_minutes").alias("cadence_minutes"))
    known = readings.select("source", "utc_us", "value").where(F.col("source").isNotNull() & F.col("utc_us").isNotNull())
    placed = lookup_join(known, cadence, ["source"], "inner")
    step_us = F.col("cadence_minutes").cast("long") * 60_000_000
    slot = F.call_function("div", F.col("utc_us") - F.pmod(F.col("utc_us"), step_us), step_us)
    # partial sums before the shuffle: a hot source moves one row per slot and task
    per_slot = checkpointed(placed.groupBy("source", div(slot, shard_slots).alias("shard"), slot.alias("slot")).agg(F.count("*").alias("readings"), F.avg("value").alias("value")))
    grid = slot_grid(deployments, cadence, shard_slots).join(per_slot, ["source", "shard", "slot"], "left")

    seen, valued = F.when(F.col("readings").isNotNull(), F.col("slot")), F.when(F.col("value").isNotNull(), F.struct("slot", "value"))
    inside = Window.partitionBy("source", "shard")
    up = inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    grid = grid.select("*", F.last(seen, True).over(up).alias("__last"), F.first(seen, True).over(down).alias("__next"), F.last(valued, True).over(up).alias("__value"))

    # summaries of the deployments' slots alone: a reading outside of them is carried into no shard, whatever the shards' size
    shards = grid.groupBy("source", "shard").agg(F.min(seen).alias("first"), F.max(seen).alias("last"), F.max(valued).alias("lastv"))
    order = Window.partitionBy("source").orderBy("shard")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carry = shards.select("source", "shard", F.last("last", True).over(before).alias("__last0"), F.first("first", True).over(after).alias("__next0"), F.last("lastv", True).over(before).alias("__value0"))
    out = grid.join(carry, ["source", "shard"], "left")
    last, following, value = F.coalesce("__last", "__last0"), F.coalesce("__next", "__next0"), F.coalesce("__value", "__value0")
    fresh = F.lit(True) if max_fill_slots is None else F.col("slot") - value["slot"] <= max_fill_slots
    empty = last.isNull() | (last < F.col("slot"))
    out = out.select(
        "source",
        (F.col("slot") * F.col("cadence_ms")).alias("slot_ms"),
        F.coalesce("readings", F.lit(0)).alias("readings"),
        "value",
        (last * F.col("cadence_ms")).alias("last_ms"),
        (following * F.col("cadence_ms")).alias("next_ms"),
        F.when(fresh, value["value"]).alias("filled"),
        empty.alias("__empty"),
    )
    return out.withColumn("status", F.when(~F.col("__empty"), "observed").when(F.col("filled").isNotNull(), "filled").otherwise("empty")).drop("__empty")
