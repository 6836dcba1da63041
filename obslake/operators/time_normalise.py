"""Problem 1: time texts of mixed layouts, precisions and zones as single UTC instants.

The text is read by itself first (layout, stated offset). A text without zone is a local time of its source, whose zone is
estimated from the data: every candidate zone, which is a whole history of offsets, is laid over the source's local times,
and a reading violates it if it would break the order of things, that is, arrive before it was measured or much later than
readings usually arrive. Per source the sequence of zones with the fewest violations is chosen, in which a change of zone
costs as much as some violations. A table of known zones settles what violations leave open: ties and short series. Where
even the best zone is violated by most readings the zone is undecided, and if it isn't known either there is no instant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslake.functions.timestamps import DAY_US, div, local_to_utc_us, utc_text, with_parsed_time
from obslake.tables import checkpointed, lookup_join

#: Offset histories tried for a source, in order of preference on ties; zones of the table of known zones are added.
CANDIDATE_ZONES = (
    "UTC", "America/Chicago", "America/Detroit", "Etc/GMT+6", "Etc/GMT+5", "America/New_York", "America/Denver", "America/Phoenix", "America/Los_Angeles", "America/Anchorage", "Pacific/Honolulu",
    "America/Halifax", "America/St_Johns", "America/Mexico_City", "America/Bogota", "America/Sao_Paulo", "America/Santiago", "America/Argentina/Buenos_Aires", "Atlantic/Azores",
    "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Istanbul", "Europe/Moscow", "Africa/Lagos", "Africa/Johannesburg", "Africa/Cairo", "Asia/Dubai", "Asia/Tehran", "Asia/Karachi",
    "Asia/Kolkata", "Asia/Kathmandu", "Asia/Dhaka", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Adelaide", "Australia/Sydney", "Australia/Perth", "Pacific/Auckland",
)
QUARTER_US = 15 * 60 * 1_000_000
#: Length of the periods between which a source can change its zone, in days.
PERIOD_DAYS = 28
#: Violations that a change of zone costs, besides a share of the source's readings.
CHANGE_COST, CHANGE_SHARE = 20.0, 0.02
#: Violations, and share of a period's readings, by which the known zone is preferred.
KNOWN_COST, KNOWN_SHARE = 3.0, 0.05
#: Zones of the table of known zones that are tried besides.
KNOWN_ZONES = 1000
SCHEMA = "period bigint, est_zone string, violations bigint, readings bigint, decided boolean"


def best_history(bad: np.ndarray, n: np.ndarray, zones: list[str], known: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(zone of each period, violations of each period): the cheapest sequence. ``bad``: violations by period and zone."""
    cost = bad + np.arange(len(zones)) * 1e-6 - np.where(np.array(zones) == known, KNOWN_COST + KNOWN_SHARE * n[:, None], 0.0)
    change = CHANGE_COST + CHANGE_SHARE * n.sum()
    best, back = cost[0].copy(), np.zeros(bad.shape, int)
    for i in range(1, len(cost)):
        least = int(best.argmin())
        moved = best[least] + change < best
        back[i] = np.where(moved, least, np.arange(len(zones)))
        best = np.where(moved, best[least] + change, best) + cost[i]
    at = np.empty(len(cost), int)
    at[-1] = best.argmin()
    for i in range(len(cost) - 1, 0, -1):
        at[i - 1] = back[i, at[i]]
    return at, bad[np.arange(len(cost)), at]


def zone_history(df: DataFrame, source: str, local_us: str, ingested: str, known: DataFrame | None = None, candidates: tuple[str, ...] = CANDIDATE_ZONES, usual_delay_min: int = 30) -> DataFrame:
    """Rows (source, period, est_zone, violations, readings, decided): each source's zone in each period of 28 days.

    A reading violates a zone if it would have arrived more than a quarter hour before its instant, or more than
    ``usual_delay_min`` after it. ``known`` has the source column and zone_name, and settles ties and short series.
    ``decided`` is false where most readings violate even the best zone. Rows without local time or arrival don't count;
    a source without any gets no row. Readings are counted by (source, day of local time, quarter hours of delay) before
    zones are tried, and the zones' offsets are looked up per day, so a hot source costs no more than its days.
    """
    q = F.col(local_us)
    counted = df.where(q.isNotNull() & F.col(ingested).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(source), div(q, DAY_US).alias("__day"), div(F.unix_micros(F.col(ingested)) - q, QUARTER_US).alias("__late")).agg(F.count("*").alias("__n"))
    counted = checkpointed(counted)
    listed = []
    if known is not None:
        listed = sorted(r[0] for r in known.where("zone_name is not null").select("zone_name").distinct().limit(KNOWN_ZONES + 1).collect())
        if len(listed) > KNOWN_ZONES:
            raise ValueError("there are fewer than 1,000 zones")
    zones = [*candidates, *(z for z in listed if z not in candidates)]
    noon = F.col("__day") * DAY_US + DAY_US // 2
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("zone")) for i, z in enumerate(zones)])).alias("__z")
    offsets = counted.select("__day").distinct().select("__day", tries).select("__day", F.col("__z.i").alias("__i"), div(noon - local_to_utc_us(noon, F.col("__z.zone")), QUARTER_US).alias("__offset"))
    tried = lookup_join(counted, offsets, ["__day"], "inner").withColumn("period", div(F.col("__day"), PERIOD_DAYS))
    fine = F.coalesce((F.col("__late") + F.col("__offset")).between(-1, usual_delay_min // 15), F.lit(False))
    scored = tried.groupBy(source, "period", "__i").agg(F.sum(F.when(fine, 0).otherwise(F.col("__n"))).alias("violations"), F.sum("__n").alias("readings"))
    per = scored.groupBy(source, "period").agg(F.sort_array(F.collect_list(F.struct("__i", "violations"))).alias("__v"), F.max("readings").alias("readings"))
    per = per.select(source, "period", F.transform("__v", lambda x: x["violations"]).alias("violations"), "readings")
    if known is None:
        per = per.withColumn("__known", F.lit(None).cast("string"))
    else:
        per = lookup_join(per, known.where("zone_name is not null").groupBy(source).agg(F.min("zone_name").alias("__known")), [source])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        n, bad = pdf.readings.to_numpy(float), np.stack(pdf.violations.to_list()).astype(float)
        at, violations = best_history(bad, n, zones, pdf["__known"].iloc[0])
        decided = violations.sum() <= n.sum() / 2
        return pd.DataFrame({source: pdf[source], "period": pdf.period, "est_zone": [zones[i] for i in at], "violations": violations.astype(int), "readings": pdf.readings, "decided": decided})

    # one row per source and period of 28 days: a hot source has no more of them than others
    return per.groupBy(source).applyInPandas(settle, f"`{source}` {dict(df.dtypes)[source]}, {SCHEMA}")


def normalise_times(df: DataFrame, text: str, source: str | None, zones: DataFrame | None, ingested: str | None, fixed_zone: str | None = None, estimate: str | None = "unknown") -> DataFrame:
    """Adds ``utc_us``, the one instant of the time text in microseconds, or null, and ``zone_used``.

    A stated offset or zone decides; otherwise the source's zone. With ``estimate`` "all" that is the zone estimated for
    the source and time, where ``zones`` (columns <source>, zone_name) settles ties and short series, and gives the zone
    where the estimate is undecided or has no arrivals to go by. With "unknown" it is the zone in ``zones``, and sources
    that it lacks are estimated; with None they have none. ``fixed_zone`` is the zone of all else. Null, empty and
    unreadable texts, local times that the zone skips or has twice, and local times of undecided zones give null. All
    rows and columns are kept, but for columns of the new ones' names, which are replaced.
    """
    df = df.drop("utc_us", "zone_used")
    out = with_parsed_time(df, text, "__t_")
    used = F.lit(fixed_zone).cast("string")
    bare = F.col("__t_offset_min").isNull() & F.col("__t_region").isNull() & F.col("__t_local_us").isNotNull()
    known = zones.select(source, "zone_name").where("zone_name is not null").groupBy(source).agg(F.min("zone_name").alias("zone_name")) if source and zones is not None else None
    estimating = bool(source and ingested and fixed_zone is None) and (estimate == "all" or (estimate == "unknown" and (known is None or not df.select(source).where(F.col(source).isNotNull()).distinct().join(known, [source], "left_anti").isEmpty())))
    if estimating:
        # the texts are read once: the estimate and the conversion both need what they say
        out = checkpointed(out)
    if known is not None:
        out = lookup_join(out, known.withColumnRenamed("zone_name", "__known"), [source])
        used = F.coalesce(F.col("__known"), used)
    if estimating:
        history = checkpointed(zone_history(out.where(bare if estimate == "all" or known is None else bare & F.col("__known").isNull()), source, "__t_local_us", ingested, known))
        found = history.where("decided").select(source, F.col("period").alias("__period"), F.col("est_zone").alias("__est"))
        # times of periods without arrivals are in the zone that the source has most
        mostly = history.where("decided").groupBy(source, "est_zone").agg(F.sum("readings").alias("n")).groupBy(source).agg(F.max_by("est_zone", F.struct("n", "est_zone")).alias("__mostly"))
        out = lookup_join(out.withColumn("__period", div(F.col("__t_local_us"), PERIOD_DAYS * DAY_US)), found, [source, "__period"])
        out = lookup_join(out, mostly, [source])
        used = F.coalesce("__est", used, "__mostly") if estimate == "all" else F.coalesce(used, "__est", "__mostly")
    out = out.withColumn("zone_used", F.coalesce(F.col("__t_region"), used))
    stated = F.col("__t_local_us") - F.col("__t_offset_min") * F.lit(60_000_000).cast("long")
    utc = F.when(F.col("__t_offset_min").isNotNull(), stated).otherwise(local_to_utc_us(F.col("__t_local_us"), F.col("zone_used")))
    return out.select("*", F.inline(F.array(F.struct(utc.alias("utc_us"))))).drop("__t_local_us", "__t_offset_min", "__t_region", "__known", "__est", "__period", "__mostly").select(*df.columns, "zone_used", "utc_us")


def unusual_times(df: DataFrame, text: str, usual: str) -> Column:
    """Whether a non-empty text isn't exactly in the usual layout (a Java pattern), or is but denotes no instant."""
    return F.col(text).isNotNull() & (F.col(text) != "") & (~F.col(text).rlike(usual) | F.col("utc_us").isNull())


def found_text() -> Column:
    """The instant of normalise_times() as a text, empty if there is none."""
    return F.coalesce(utc_text(F.col("utc_us")), F.lit(""))


def found(df: DataFrame, table_name: str, text: str, usual: str) -> DataFrame:
    return df.where(unusual_times(df, text, usual)).select(F.lit(table_name).alias("table_name"), "row_id", found_text().alias("utc_text"))
