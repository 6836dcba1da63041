"""Problem 7: texts in containers of a fixed number of tokens, by minimum bin slack.

Which texts go together depends on their lengths alone, so the search runs on the histogram of lengths, which has at most
as many entries as a container has tokens. Per bin, the longest text left is set, and a bitset subset-sum over the lengths
left finds the fullest feasible combination with it, which is then removed; the same combination is used for as many bins
as the lengths' counts allow, so each search uses up at least one length. The plan (intervals of ranks per length) is then
applied to all texts at once, each ranked within its length in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslake.tables import checkpointed, shards_for


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum that is at most ``room``, of long texts rather than short."""
    if room <= 0:
        return {}
    lengths = sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True)
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []  # after each (length, bundle): the sums reached
    marks = [reach]
    for n in lengths:
        left, bundle = min(counts[n], room // n), 1
        while left > 0:  # bundles of 1, 2, 4, ... copies
            k = min(bundle, left)
            reach |= (reach << (n * k)) & mask
            steps.append((n, k))
            marks.append(reach)
            left -= k
            bundle *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for i in range(len(steps) - 1, -1, -1):
        if marks[i] >> best & 1:
            continue  # reached without this bundle
        n, k = steps[i]
        out[n] = out.get(n, 0) + k
        best -= n * k
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins, combination)]: all lengths of the histogram, each 1 to ``capacity``, are used up."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        use = fullest(counts, capacity - top)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        plan.append((times, use))
    return plan


def pack(documents: DataFrame, capacity: int) -> DataFrame:
    """Rows (doc_id, piece_no, piece_tokens, container): every document once, in pieces if it alone exceeds the capacity.

    ``documents`` has doc_id and tokens. A document of more tokens than the capacity is cut into full pieces, one container
    each (f-<doc_id>-<piece>), and a rest that is packed like a text. Texts of no tokens take no room and go into p-0.
    Container names are p-<number>. Nothing is dropped; of repeated ids each row is packed for itself.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    full, rest = F.floor(tokens / capacity).cast("int"), (tokens % capacity).cast("int")
    alone = documents.where(tokens > capacity).select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no"))
    alone = alone.select("doc_id", "piece_no", F.lit(capacity).alias("piece_tokens"), F.concat_ws("-", F.lit("f"), "doc_id", "piece_no").alias("container"))
    items = documents.select(
        "doc_id",
        F.when(tokens > capacity, full).otherwise(0).alias("piece_no"),
        F.when(tokens > capacity, rest).otherwise(tokens).cast("int").alias("n"),
        (tokens > capacity).alias("cut"),
    ).where(~(F.col("cut") & (F.col("n") == 0)))
    # rank within the length: counted per chunk, the chunks' counts added up, ranked within the chunk
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(shards_for(documents.count()))).cast("int")
    items = items.withColumn("__chunk", chunk)
    sizes = items.groupBy("n", "__chunk").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("n").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n", "__chunk", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    order = Window.partitionBy("n", "__chunk").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("__r", F.row_number().over(order) - 1).join(offsets, ["n", "__chunk"]).select("doc_id", "piece_no", "n", (F.col("__r") + F.col("__off")).cast("long").alias("rank"))

    histogram = {r[0]: r[1] for r in sizes.where("n > 0").groupBy("n").agg(F.sum("__c").alias("c")).collect()}
    plan = plan_bins(histogram, capacity)
    # per length: from which rank on the texts go to the bins of which combination
    starts: list[int] = []
    first: list[int] = []
    per: list[int] = []
    base: list[int] = []
    at: dict[int, int] = {}
    bin_no, spans = 0, []
    for times, use in plan:
        for n, k in use.items():
            spans.append((n, at.get(n, 0), bin_no, k))
            at[n] = at.get(n, 0) + times * k
        bin_no += times
    for n, rank, b, k in sorted(spans):
        starts.append((n << 40) + rank)
        base.append(rank)
        first.append(b)
        per.append(k)
    table = tuple(np.array(x, np.int64) for x in (starts, base, first, per))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, b, f, k = table
        for batch in batches:
            n, rank = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (2, 3))
            bins = np.zeros(len(n), np.int64)
            some = n > 0
            if some.any():
                i = np.searchsorted(s, (n[some] << 40) + rank[some], side="right") - 1
                bins[some] = f[i] + (rank[some] - b[i]) // k[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([f"p-{x}" for x in bins.tolist()])], names=["doc_id", "piece_no", "piece_tokens", "container"])

    packed = ranked.mapInArrow(place, "doc_id long, piece_no int, piece_tokens int, container string")
    return packed.unionByName(alone)


def pack_all(documents: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """pack() for each (capacity_id, max_tokens); ``documents`` has doc_id and tokens."""
    sized = checkpointed(documents.select("doc_id", "tokens"))
    out = None
    for name, capacity in capacities:
        one = pack(sized, capacity).withColumn("capacity_id", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = sized.select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("piece_tokens"), F.lit("").alias("container"), F.lit("").alias("capacity_id")).limit(0)
    return out.select("capacity_id", "container", "doc_id", "piece_no", "piece_tokens")
