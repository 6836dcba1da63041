"""Problem 4: quantities in many units and scales, brought to the common unit of each quantity.

An automaton over all unit aliases reads the texts around a number: beside it in the value, the unit column, the rest of
the metric text, the end of the field name, a remark in the label, in this order; the quantity decides what an alias means,
the longest alias wins. Numbers whose row names no unit get the unit that makes the values of their stream plausible: per
stream and day, the likelihood of each unit under what is usual for the quantity, and over the days the likeliest
sequence of units, in which a change of unit has its price. What is usual is told by the values of stated units, together
with a table of priors that count as much as PRIOR_ROWS rows. Factors to the common unit are joined from a small fixed table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslake.functions.timestamps import div
from obslake.functions.units import CONVERSIONS, ContextReader
from obslake.tables import checkpointed, lookup_join, spread

#: Length of a stretch of time in which a stream has one unit, and the one of its rows without time.
STRETCH_US = 86_400_000_000
NO_TIME = -(2**40)
#: Plausible mean and deviation of quantities in their common unit; a parameter of convert_units.
PRIORS = {
    "air_temperature": (14.0, 9.0), "relative_humidity": (60.0, 18.0), "air_pressure": (1013.0, 12.0), "wind_speed": (5.0, 3.0), "precipitation": (5.0, 5.0),
    "pm2_5": (11.0, 8.0), "nitrogen_dioxide": (17.0, 9.0), "water_level": (2.4, 1.5), "streamflow": (12.0, 9.0), "pfos": (6.0, 5.0),
}
#: Rows that a prior counts as.
PRIOR_ROWS = 30.0
#: Loss of log likelihood by a change of unit from one stretch to the next.
CHANGE = 6.0
SMALL_LIST = 10_000


def small_pairs(df: DataFrame) -> list[tuple]:
    """The rows of a reference list; an error if it isn't short."""
    rows = df.distinct().limit(SMALL_LIST + 1).collect()
    if len(rows) > SMALL_LIST:
        raise ValueError("a reference list of units or labels has at most 10,000 rows")
    return sorted((tuple(r) for r in rows if None not in tuple(r)), key=str)


def read_units(observations: DataFrame, units: list[tuple[str, str]], labels: dict[str, str]) -> DataFrame:
    """Adds quantity, number, stated_unit and stated_in (value, unit, metric, source_field, record_label).

    ``observations`` has metric, value, unit, source_field and record_label. Values without a finite number have a null
    number and no unit; metrics of no known quantity have a null quantity. All rows and columns are kept.
    """
    names = observations.columns
    at = [names.index(c) for c in ("metric", "value", "unit", "source_field", "record_label")]
    schema = observations.schema.simpleString()[7:-1] + ",quantity:string,number:double,stated_unit:string,stated_in:string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ContextReader(units, labels)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = [reader.read(*x) for x in zip(*(batch.column(i).to_pylist() for i in at))]
            new = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(new[0], pa.string()), pa.array(new[1], pa.float64()), pa.array(new[2], pa.string()), pa.array(new[3], pa.string())],
                names=[*batch.schema.names, "quantity", "number", "stated_unit", "stated_in"],
            )

    return observations.mapInArrow(read, schema)


def usual_values(stated: DataFrame, quantities: list[str], priors: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows (quantity, mean, dev) in common units: the stated values and the prior, blended by their weights.

    ``stated`` has quantity and value. The prior counts as PRIOR_ROWS rows, whatever the number of stated ones; a quantity
    without prior has the stated values alone, one without either no row.
    """
    seen = stated.groupBy("quantity").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    prior = stated.sparkSession.createDataFrame([(q, *map(float, priors.get(q, (0.0, 0.0))), PRIOR_ROWS if q in priors else 0.0) for q in quantities] or [(None,) * 4], "quantity string, pm double, ps double, w double")
    n, m, v = (F.coalesce(c, F.lit(0.0)) for c in ("n", "m", "v"))
    mean = (n * m + F.col("w") * F.col("pm")) / (n + F.col("w"))
    spread_ = (n * (v + (m - mean) ** 2) + F.col("w") * (F.col("ps") ** 2 + (F.col("pm") - mean) ** 2)) / (n + F.col("w"))
    out = prior.join(F.broadcast(seen), "quantity", "left").where(n + F.col("w") > 0)
    return out.select("quantity", mean.alias("mean"), F.sqrt(spread_).alias("dev")).where("dev > 0")


def likeliest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The unit of each stretch of one stream and quantity: the likeliest sequence. Ties go to the common unit, then in
    order of code; rows without time are judged apart."""
    units = sorted(set(zip(~pdf.is_common.to_numpy(bool), pdf.unit_code)))
    codes = [u for _, u in units]
    cuts = np.sort(pdf["__cut"].unique())
    ll = np.zeros((len(cuts), len(codes)))
    ll[np.searchsorted(cuts, pdf["__cut"]), [codes.index(u) for u in pdf.unit_code]] = np.round(pdf["__ll"], 6)
    whole = int(ll.sum(0).argmax())
    if (ll.argmax(1) == whole).all():
        return pd.DataFrame({"__stream": pdf["__stream"].iloc[0], "quantity": pdf.quantity.iloc[0], "__cut": cuts, "__plausible": codes[whole]})
    back, best = np.zeros(ll.shape, int), None
    for i, row in enumerate(ll):
        if best is None or cuts[i - 1] == NO_TIME:
            back[i] = -1 if best is None else int(best.argmax())
            best = row.copy()
            continue
        top = int(best.argmax())
        moved = best[top] - CHANGE > best
        back[i] = np.where(moved, top, np.arange(len(codes)))
        best = np.where(moved, best[top] - CHANGE, best) + row
    at = np.empty(len(cuts), int)
    at[-1] = best.argmax()
    for i in range(len(cuts) - 1, 0, -1):
        at[i - 1] = back[i, at[i]]
    return pd.DataFrame({"__stream": pdf["__stream"].iloc[0], "quantity": pdf.quantity.iloc[0], "__cut": cuts, "__plausible": [codes[i] for i in at]})


def convert_units(observations: DataFrame, reference: DataFrame, metric_labels: DataFrame, priors: dict[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """Adds quantity, number, unit_code, unit_from, is_common and common_value.

    ``unit_from`` tells where the unit is stated, or ``plausible`` if it was chosen by the values; null where there is
    no number or no known quantity, and then unit_code and common_value are null too, as they are for a quantity of
    which neither a stated value nor a prior tells what is plausible. Rows without stream are judged together by
    unit_id, rows without time together. Ties between units go to the common one, then in order of code. A unit of
    ``reference`` without a known factor keeps its code and has a null common_value. Columns of the new ones' names are
    replaced.
    """
    observations = observations.drop("quantity", "number", "unit_code", "unit_from", "is_common", "common_value", "stated_unit", "stated_in", "factor", "shift")
    units = small_pairs(reference.select("quantity", "unit_code"))
    labels = dict(small_pairs(metric_labels.select("metric_label", "quantity")))
    spark = observations.sparkSession
    # read once: the texts are the costly part, and several steps need the result
    key = F.coalesce("stream_id", F.concat(F.lit("unit:"), "unit_id"), F.lit("none"))
    read = checkpointed(read_units(spread(observations), units, labels))
    common = set(small_pairs(reference.where("is_common = 1").select("quantity", "unit_code")))
    rows = [(q, u, (q, u) in common, *CONVERSIONS.get((q, u), (None, None))) for q, u in units]
    factors = spark.createDataFrame(rows or [(None,) * 5], "quantity string, unit_code string, is_common boolean, factor double, shift double")

    stated = read.withColumnRenamed("stated_unit", "unit_code").join(F.broadcast(factors), ["quantity", "unit_code"], "left")
    value = F.col("number") * F.col("factor") + F.col("shift")
    usual = usual_values(stated.where("unit_code is not null").select("quantity", value.alias("value")), sorted({q for q, _ in units}), priors)

    # rows that name no unit: sums of log likelihoods by stream and stretch, before anything is gathered per stream
    inferable = F.col("unit_code").isNull() & F.col("number").isNotNull() & F.col("quantity").isNotNull()
    stretch = F.coalesce(div(F.unix_micros("observed_at"), STRETCH_US), F.lit(NO_TIME))
    bare = stated.where(inferable).select(key.alias("__stream"), "quantity", "number", stretch.alias("__cut"))
    tried = bare.join(F.broadcast(factors.where("factor is not null")), "quantity").join(F.broadcast(usual), "quantity")
    z = F.least(F.abs(F.col("number") * F.col("factor") + F.col("shift") - F.col("mean")) / F.col("dev"), F.lit(40.0))
    sums = tried.groupBy("__stream", "quantity", "__cut", "unit_code", "is_common").agg(F.sum(-z * z / 2 + F.log(F.abs("factor"))).alias("__ll"))
    # one row per unit and day of a stream is gathered, however many readings it has
    chosen = sums.groupBy("__stream", "quantity").applyInPandas(likeliest, "__stream string, quantity string, __cut bigint, __plausible string")

    rest = stated.where(inferable).drop("is_common", "factor", "shift", "unit_code", "stated_in").withColumn("__stream", key).withColumn("__cut", stretch)
    rest = lookup_join(rest, checkpointed(chosen), ["__stream", "quantity", "__cut"]).withColumn("stated_in", F.when(F.col("__plausible").isNotNull(), F.lit("plausible"))).withColumnRenamed("__plausible", "unit_code").drop("__stream", "__cut")
    rest = rest.join(F.broadcast(factors), ["quantity", "unit_code"], "left")
    out = stated.where(~inferable).unionByName(rest)
    return out.select(*observations.columns, "quantity", "number", "unit_code", F.when(F.col("unit_code").isNotNull(), F.col("stated_in")).alias("unit_from"), "is_common", F.when(F.col("unit_code").isNotNull(), value).alias("common_value"))
