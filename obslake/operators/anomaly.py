"""Problem 3: spikes, stuck stretches and impossible readings of each series, by a hidden Markov model per series.

The model reads runs of equal values. Its states are normal, spike (of one, two or three runs), stuck and out of range.
A normal run steps from the last normal one by what is usual for its series and lasts as equal values there usually last;
a spike is off from the last normal run and returns to it; a stuck run lasts far longer than chance explains; a value
beyond the hard bounds can only come from the state out of range, so its probability is 1, and the chain passes over it as
over a null. Forward-backward probabilities decide. What is usual is fitted per series from all its readings: the gap
between readings, the step between unequal ones, how often values repeat and how often a step is far too large.

Series are cut into shards of time that hold equally many readings on average. One exchange gathers each shard's readings
as one row of arrays, with histograms of its gaps and steps and its first and last runs. Everything that crosses shards is
made of these summaries: the fitted constants are sums over them, runs that cross shards are put together by a prefix
scan, and each shard is given the neighbours' last and first runs, since what the model knows of the past fades within a
few runs. So a series with a third of all readings is as many shards as others of its size together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslake.tables import checkpointed, lookup_join, spread

SHARD_READINGS = 2048
#: Runs of a neighbouring shard that a shard is read with.
HALO = 8
GAP = 5.0
#: Probability that a normal run is followed by a spike, before a series' own large steps count, and their weight in runs.
TO_SPIKE, SPIKE_WEIGHT = 0.003, 2000.0
#: Probability that a normal run is followed by a stuck run.
TO_STUCK = 1e-4
SPIKE_MIN, SPIKE_SPAN = 2.5, 25.0
#: A stuck run is expected to be longer by this factor than the longest run by chance of STUCK_READINGS readings, however many there are.
STUCK_TIMES, STUCK_LEAST, STUCK_SCALE, STUCK_READINGS = 1.6, 6.0, 15.0, 20_000.0
#: Loss of log probability of a stuck run by every reading that it is shorter.
STUCK_SHORT = 3.0
NORMAL, STUCK, S1, S2, S3 = range(5)
BLOCK = 48
#: Widths of the histograms' bins, as logarithms.
GAP_BIN, STEP_BIN = 0.02, 0.01


def log_emissions(y: np.ndarray, t0: np.ndarray, t1: np.ndarray, length: np.ndarray, sigma: float, repeat: float, cadence: float) -> tuple[np.ndarray, np.ndarray]:
    """(steps, lasts): steps[i, k] is the log density of run i as normal after its predecessor was normal (k = 0) or the
    k-th run of a spike; steps[i, 3 + k] as the k-th run of a spike; lasts[i, s] of its length in state s."""
    m = len(y)
    steps = np.zeros((m, 7))
    # what a gap tells is nothing: the same density for all
    for k in range(4):
        back = 1 + k
        z = np.zeros(m)
        known = np.zeros(m, bool)
        if m > back:
            dt = (t0[back:] - t1[:-back]) / cadence
            near = np.ones(m - back, bool)
            for j in range(back):  # no gap between any neighbours in between
                near &= (t0[back - j : m - j] - t1[back - j - 1 : m - j - 1]) / cadence <= GAP
            z[back:] = (y[back:] - y[:-back]) / sigma
            wide = np.sqrt(np.maximum(1.0, dt - (1 if k else 0)))
            known[back:] = near
            zz = z.copy()
            zz[back:] /= wide
            dens = np.logaddexp(np.log(0.98) - zz**2 / 2, np.log(0.02 / 1.8) - (zz / 1.8) ** 2 / 2) - 0.919
            steps[:, k] = np.where(known, dens, -2.5)
        else:
            steps[:, k] = -2.5
        if k < 3:
            off = np.where(np.abs(z) < SPIKE_MIN, -12.0, -np.log(2 * SPIKE_SPAN))
            steps[:, 4 + k] = np.where(known, off, -8.0)
    p = min(max(repeat, 1e-3), 0.9)
    expect = 1 + np.log(STUCK_READINGS) / -np.log(p)
    least = max(STUCK_LEAST, STUCK_TIMES * expect)
    lasts = np.empty((m, 5))
    lasts[:, NORMAL] = (length - 1) * np.log(p) + np.log(1 - p)
    lasts[:, STUCK] = -np.log(STUCK_SCALE) - np.where(length < least, STUCK_SHORT * (least - length), (length - least) / STUCK_SCALE)
    lasts[:, S1:] = np.where(length > 3, -60.0, lasts[:, NORMAL])[:, None]
    return steps, lasts


def posteriors(steps: np.ndarray, lasts: np.ndarray, to_spike: float = TO_SPIKE, block: int = BLOCK, halo: int = 16) -> np.ndarray:
    """Probability of each state of each run. The runs are cut into blocks with halos, which are run side by side."""
    m = len(steps)
    blocks = -(-m // block)
    width = block + 2 * halo
    at = np.arange(blocks)[:, None] * block - halo + np.arange(width)[None, :]
    inside = (at >= 0) & (at < m)
    at = at.clip(0, m - 1)
    st, la = steps[at], lasts[at]
    lt = np.full((blocks, width, 5, 5), -np.inf)
    stay = np.log(1 - to_spike - TO_STUCK)
    for s in (NORMAL, STUCK):
        lt[:, :, s, NORMAL] = stay + st[:, :, 0]
        lt[:, :, s, STUCK] = np.log(TO_STUCK) - 4.0
        lt[:, :, s, S1] = np.log(to_spike) + st[:, :, 4]
    for k, s in enumerate((S1, S2, S3), 1):
        lt[:, :, s, NORMAL] = np.log(0.6 if k < 3 else 0.999) + st[:, :, k]
        lt[:, :, s, STUCK] = np.log(TO_STUCK) - 4.0
        if k < 3:
            lt[:, :, s, s + 1] = np.log(0.4) + st[:, :, 4 + k]
    lt += la[:, :, None, :]
    lt = np.where(inside[:, :, None, None], lt, np.where(np.eye(5, dtype=bool), 0.0, -np.inf))
    tr = np.exp(lt - lt.max(axis=(2, 3), keepdims=True))
    f = np.tile(np.log([0.97, 1e-4, 0.01, 0.01, 0.0098]), (blocks, 1))
    f = np.exp(f)
    forward = np.empty((blocks, width, 5))
    for j in range(width):
        f = np.einsum("bi,bij->bj", f, tr[:, j])
        f /= f.sum(1, keepdims=True) + 1e-300
        forward[:, j] = f
    b = np.ones((blocks, 5))
    post = np.empty((blocks, width, 5))
    for j in range(width - 1, -1, -1):
        g = forward[:, j] * b
        post[:, j] = g / (g.sum(1, keepdims=True) + 1e-300)
        b = np.einsum("bij,bj->bi", tr[:, j], b)
        b /= b.max(1, keepdims=True) + 1e-300
    return post[:, halo : halo + block].reshape(-1, 5)[:m]


def runs_of(t: np.ndarray, v: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, good, run, first, last, length) of readings: their order by time and value; of the ordered ones, whether
    they are in range and which run they belong to (-1 out of range); of each run, its first and last ordered reading
    and its number of distinct readings."""
    order = np.lexsort((v, t))
    ts, vs = t[order], v[order]
    good = (vs >= lo) & (vs <= hi)
    at = np.flatnonzero(good)
    run = np.full(len(t), -1)
    if len(at) == 0:
        return order, good, run, at, at, at
    new = np.r_[True, vs[at][1:] != vs[at][:-1]]
    own = np.cumsum(new) - 1
    run[at] = own
    distinct = np.r_[True, (ts[at][1:] != ts[at][:-1]) | new[1:]]
    return order, good, run, at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]], np.bincount(own, distinct).astype(np.int64)


def _scaled(v: np.ndarray, log: bool) -> np.ndarray:
    return np.log(np.maximum(v, 0.05)) if log else v


def _histogram(values: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.rint(np.log(values) / width).astype(np.int64), return_counts=True)


RUN = "struct<v:double,t0:bigint,t1:bigint,n:bigint>"
HIST = "array<struct<bin:bigint,n:bigint>>"


def _summary(table: pa.Table) -> dict[str, list]:
    """One shard's readings as arrays and its summary, as columns of one row."""
    t, v = table["t"].to_numpy(), table["v"].to_numpy()
    first = {c: table[c][0].as_py() for c in ("series", "shard", "lo", "hi", "log_scale", "cadence_us")}
    order, good, run, a, b, n = runs_of(t, v, first["lo"], first["hi"])
    ts, vs = t[order], v[order]
    gaps = np.diff(ts[good])
    gaps = gaps[gaps > 0]
    usual = max(float(first["cadence_us"]), float(np.median(gaps))) if len(gaps) else float(first["cadence_us"])
    y = _scaled(vs[a], first["log_scale"])
    step = np.abs(np.diff(y))[(ts[a[1:]] - ts[b[:-1]] < 2 * usual) & (np.diff(y) != 0)] if len(a) > 1 else np.zeros(0)
    edge = lambda part: [{"v": float(vs[i]), "t0": int(ts[i]), "t1": int(ts[j]), "n": int(k)} for i, j, k in zip(a[part], b[part], n[part])]
    bins = lambda values, width: [{"bin": int(x), "n": int(k)} for x, k in zip(*_histogram(values, width))]
    return {
        **{c: [x] for c, x in first.items()},
        "ts": [ts], "vs": [vs],
        "heads": [edge(slice(0, HALO))], "tails": [edge(slice(-HALO, None))], "runs": [len(a)], "repeated": [int((n > 1).sum())],
        "gap_bins": [bins(gaps, GAP_BIN)], "step_bins": [bins(step, STEP_BIN)],
    }


def _flagged(row: dict, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(readings, flags, probabilities) of one shard: what is flagged, by position in its arrays."""
    _, good, run, a, b, n = runs_of(t, v, row["lo"], row["hi"])
    at, flag, probability = np.flatnonzero(~good), np.full((~good).sum(), "out_of_range", object), np.ones((~good).sum())
    if len(a):
        vs, t0, t1, n = v[a], t[a].astype(float), t[b].astype(float), n.astype(float)
        before, after = row["before"] or [], row["after"] or []
        # a run that crosses the border is the neighbour's too: its parts elsewhere are added, and it is read once
        if row["n_before"]:
            before = before[:-1]
            n[0] += row["n_before"]
            t0[0] = row["t_before"]
        if row["n_after"]:
            after = after[1:]
            n[-1] += row["n_after"]
            t1[-1] = row["t_after"]
        k = len(before)
        put = lambda own, c: np.concatenate([[x[c] for x in before], own, [x[c] for x in after]])
        sigma = row["sigma"] if row["sigma"] and row["sigma"] > 0 else np.inf
        steps, lasts = log_emissions(_scaled(put(vs, "v"), row["log_scale"]), put(t0, "t0"), put(t1, "t1"), put(n, "n"), sigma, row["repeat_p"], row["usual_us"])
        post = posteriors(steps, lasts, row["to_spike"])[k : k + len(a)]
        spike, stuck = post[:, S1:].sum(1), post[:, STUCK]
        hit = (spike > 0.5) | (stuck > 0.5)
        inside = np.flatnonzero(good & (run >= 0) & hit[np.maximum(run, 0)])
        own = run[inside]
        at = np.r_[at, inside]
        flag = np.r_[flag, np.where(stuck > spike, "stuck", "spike")[own].astype(object)]
        probability = np.r_[probability, np.maximum(spike, stuck)[own]]
    return at, flag, probability


def shards(readings: DataFrame) -> DataFrame:
    """One row per series and shard: its distinct readings as arrays in order of time, and its summary.

    Copies are made one before anything is gathered, and combined before they are shuffled."""
    df = readings.where("series is not null and t is not null and v is not null and not isnan(v)").select("series", "t", "v", "lo", "hi", "log_scale", "cadence_us")
    of = df.groupBy("series").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("log_scale").alias("log_scale"), F.min("cadence_us").alias("cadence_us"), F.min("t").alias("__a"), F.max("t").alias("__b"), F.count("*").alias("__n"))
    of = of.withColumn("__width", F.greatest(F.ceil((F.col("__b") - F.col("__a") + 1) * (SHARD_READINGS / F.col("__n"))), F.lit(1)).cast("long"))
    once = df.groupBy("series", "t", "v").agg(F.count("*").alias("__copies")).drop("__copies")
    cut = lookup_join(once, of.drop("__n", "__b"), ["series"], "inner")
    cut = cut.withColumn("shard", F.call_function("div", F.col("t") - F.col("__a"), F.col("__width"))).drop("__a", "__width")
    schema = f"series string, shard bigint, lo double, hi double, log_scale boolean, cadence_us bigint, ts array<bigint>, vs array<double>, heads array<{RUN}>, tails array<{RUN}>, runs bigint, repeated bigint, gap_bins {HIST}, step_bins {HIST}"
    out = pa.schema([(f.name, t) for f, t in zip(_parsed(schema), _arrow(schema))])
    return cut.groupBy("series", "shard").applyInArrow(lambda table: pa.table(_summary(table), schema=out), schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _parsed(schema)]


def constants(blocks: DataFrame) -> DataFrame:
    """Rows (series, usual_us, sigma, repeat_p, to_spike): the model of each series, fitted from the shards' histograms.

    A series without any step between unequal neighbours has that of the series with the same bounds and scale, in their
    middle, and if there are none a null sigma, with which nothing is a spike.
    """
    whole = blocks.groupBy("series").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("log_scale").alias("log_scale"), F.min("cadence_us").alias("cadence_us"), F.sum("runs").alias("runs"), (F.sum("repeated") / F.sum("runs")).alias("repeat_p"))
    gaps = blocks.select("series", F.inline("gap_bins")).groupBy("series", "bin").agg(F.sum("n").alias("n")).groupBy("series").agg(F.exp(F.percentile("bin", 0.5, F.col("n")) * GAP_BIN).alias("__gap"))
    steps = blocks.select("series", F.inline("step_bins")).groupBy("series", "bin").agg(F.sum("n").alias("n"))
    typical = steps.groupBy("series").agg(F.percentile("bin", 0.5, F.col("n")).alias("__m"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("__bins"))
    # a spike of one reading is two steps of more than six times the usual deviation
    large = F.aggregate(F.filter("__bins", lambda x: x["bin"] > F.col("__m") + F.lit(float(np.log(6 * 1.4826) / STEP_BIN))), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    typical = typical.select("series", (F.exp(F.col("__m") * STEP_BIN) * 1.4826).alias("sigma"), large.alias("__large"))
    # merged, for the planner would take the summaries to be as small as the compressed file they come from
    of = whole.join(gaps.hint("merge"), "series", "left").join(typical.hint("merge"), "series", "left")
    pool = of.groupBy("lo", "hi", "log_scale").agg(F.percentile("sigma", 0.5).alias("__pool"))
    of = of.join(F.broadcast(pool), ["lo", "hi", "log_scale"], "left")
    return of.select(
        "series",
        F.greatest(F.col("cadence_us").cast("double"), F.coalesce("__gap", F.lit(0.0))).alias("usual_us"),
        F.coalesce("sigma", "__pool").alias("sigma"),
        F.coalesce("repeat_p", F.lit(0.0)).alias("repeat_p"),
        F.least(F.lit(0.05), (F.coalesce("__large", F.lit(0)) / 2 + TO_SPIKE * SPIKE_WEIGHT) / (F.col("runs") + SPIKE_WEIGHT)).alias("to_spike"),
    )


def carried(blocks: DataFrame) -> DataFrame:
    """Per series and shard what its neighbours tell: ``before`` and ``after``, their last and first runs, and of a run
    that goes on from the shard before (after), the readings it has there and its first (last) time.

    Shards without a reading in range, and what is beyond them, are passed over.
    """
    s = blocks.where("runs > 0").select("series", "shard", "runs", F.element_at("heads", 1).alias("h"), F.element_at("tails", -1).alias("l"))
    up, down = Window.partitionBy("series").orderBy("shard"), Window.partitionBy("series").orderBy(F.desc("shard"))
    # a shard that is one run of the value that the shard before it ends with goes on with that run
    s = s.select("*", (F.col("runs") == 1).alias("one"), (F.lag("l.v").over(up) == F.col("h.v")).alias("__up"), (F.lag("h.v").over(down) == F.col("l.v")).alias("__down"))
    new_up, new_down = ((~(F.col("one") & F.coalesce(F.col(c), F.lit(False)))).cast("int") for c in ("__up", "__down"))
    s = s.select("*", F.sum(new_up).over(up).alias("__u"), F.sum(new_down).over(down).alias("__d"))
    part_up, part_down = Window.partitionBy("series", "__u").orderBy("shard"), Window.partitionBy("series", "__d").orderBy(F.desc("shard"))
    s = s.select("*", F.sum("l.n").over(part_up).alias("__lu"), F.min("l.t0").over(part_up).alias("__tu"), F.sum("h.n").over(part_down).alias("__hd"), F.max("h.t1").over(part_down).alias("__td"))
    s = s.select(
        "series", "shard",
        F.when(F.col("__up"), F.lag("__lu").over(up)).alias("n_before"), F.when(F.col("__up"), F.lag("__tu").over(up)).alias("t_before"),
        F.when(F.col("__down"), F.lag("__hd").over(down)).alias("n_after"), F.when(F.col("__down"), F.lag("__td").over(down)).alias("t_after"),
    )
    sent = [blocks.where("runs > 0").select("series", (F.col("shard") + step).alias("shard"), F.lit(name).alias("side"), F.col(side).alias("part")) for step, name, side in ((1, "before", "tails"), (-1, "after", "heads"))]
    halo = sent[0].unionByName(sent[1]).groupBy("series", "shard").agg(*[F.first(F.when(F.col("side") == x, F.col("part")), True).alias(x) for x in ("before", "after")])
    return s.join(halo.hint("merge"), ["series", "shard"], "left")


def flag_readings(readings: DataFrame) -> DataFrame:
    """Rows (series, t, v, flag, probability): the distinct flagged readings.

    ``readings`` has series, t (microseconds), v (double), lo and hi (hard bounds), log_scale (whether steps are judged
    on the logarithm) and cadence_us. Null or NaN values and null times or series are no readings. Repeated rows count
    once. Readings out of bounds are flagged out_of_range with probability 1 and don't break runs. Gaps are judged by the
    series' own usual one where that is longer than its cadence, so sparse series are read like others. A series of one
    run is stuck if it is longer than the longest that repeating nine times in ten explains.
    """
    blocks = checkpointed(shards(readings))
    known = lookup_join(carried(blocks), constants(blocks), ["series"], "inner")
    small = ["series", "lo", "hi", "log_scale", "before", "after", "n_before", "t_before", "n_after", "t_after", "usual_us", "sigma", "repeat_p", "to_spike"]
    joined = lookup_join(spread(blocks.select("series", "shard", "lo", "hi", "log_scale", "ts", "vs")), known, ["series", "shard"], "left", salts=1).select(*small, "ts", "vs")
    schema = "series string, t bigint, v double, flag string, probability double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(small).to_pylist()):
                t, v = (batch.column(c)[i].values.to_numpy() for c in ("ts", "vs"))
                at, flag, probability = _flagged(row, t, v)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([row["series"]] * len(at), pa.string()), pa.array(t[at]), pa.array(v[at]), pa.array(flag.tolist(), pa.string()), pa.array(probability)], names=["series", "t", "v", "flag", "probability"])

    return joined.mapInArrow(judge, schema)


def flag_rows(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """The rows of all flagged readings, copies among them, with flag and probability."""
    return lookup_join(rows.drop("flag", "probability"), flagged, ["series", "t", "v"], "inner")
