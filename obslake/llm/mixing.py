"""Problem 8: a selection of documents of several sources whose token shares meet the targets of a mixture.

The tokens of each source give its one repetition rate; a document is emitted floor(rate) times, and once more with the
probability of the fraction, decided by a hash of mixture and document, so that every run and every executor agrees and
the chance of a copy depends on nothing but its source. Sizes are heavy-tailed, so what is selected differs from the
targets by chance; the report gives the actual shares, their deviation and how much of it chance explains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslake.tables import lookup_join

#: Hexadecimal digits of the hash that make the number in [0, 1).
HEX = 13


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the key's parts, the same wherever and in whatever language it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, HEX), 16, 10).cast("double") / float(16**HEX)


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (mix_id, source, target_share, max_repeats, rate): the largest selection whose expected shares are the targets.

    ``sizes`` has source and tokens, one row per source. A mixture's total is bounded by its scarcest source, repeated as
    often as it may. Sources of positive share that have no tokens can't contribute: their rate is 0 and the rest keep
    their proportions. Shares need not add up to 1. Rows of ``targets`` with a null are ignored, repeated ones count
    once; of several rows of one mixture and source the one of the least share, then the fewest repeats, holds.
    """
    listed = targets.select("mix_id", "source", "target_share", "max_repeats").na.drop().groupBy("mix_id", "source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    own = listed.select("mix_id", "source", "t.*").join(sizes.select("source", F.col("tokens").alias("__held")), "source", "left")
    usable = (F.col("__held") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = F.min(F.when(usable, F.col("max_repeats") * F.col("__held") / F.col("target_share"))).over(Window.partitionBy("mix_id"))
    rate = F.when(usable, F.least(F.col("max_repeats").cast("double"), total * F.col("target_share") / F.col("__held"))).otherwise(0.0)
    return own.select("mix_id", "source", "target_share", "max_repeats", rate.alias("rate"))


def with_copies(documents: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows (mix_id, source, target_share, max_repeats, rate, doc_id, tokens, copies), one per mixture and document of it.

    ``documents`` has doc_id, source and tokens. Documents of null or unlisted sources are in no mixture; documents of no
    tokens are treated like others, but change no share. Repeated rows of a doc_id are copied alike.
    """
    sizes = documents.where("source is not null").groupBy("source").agg(F.sum(F.col("tokens").cast("long")).alias("tokens"))
    plan = rates(sizes, targets).groupBy("source").agg(F.collect_list(F.struct("mix_id", "target_share", "max_repeats", "rate")).alias("__mixes"))
    own = lookup_join(documents.select("doc_id", "source", "tokens"), plan, ["source"], "inner").select("doc_id", "source", "tokens", F.inline("__mixes"))
    more = uniform(F.lit(seed), F.col("mix_id"), F.col("doc_id").cast("string")) < F.col("rate") - F.floor("rate")
    return own.withColumn("copies", (F.floor("rate") + more.cast("int")).cast("int"))


def select_mix(documents: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows (mix_id, doc_id, copy_no, source, tokens), one per emitted copy."""
    chosen = with_copies(documents, targets, seed).where("copies > 0")
    return chosen.select("mix_id", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "source", "tokens")


def mix_report(documents: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Per mixture and source: the target and the actual share of tokens, the rate, what was selected, and ``deviation``,
    actual less expected tokens, beside ``chance``, the standard deviation that the Bernoulli copies give them.

    Sources without documents have no row.
    """
    size, part = F.col("tokens").cast("double"), F.col("rate") - F.floor("rate")
    per = with_copies(documents, targets, seed).groupBy("mix_id", "source", "target_share", "max_repeats", "rate").agg(
        F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("copies").cast("long") * F.col("tokens")).alias("tokens"),
        F.sum(size * (F.col("copies") - F.col("rate"))).alias("deviation"),
        F.sqrt(F.sum(size * size * part * (1 - part))).alias("chance"),
    )
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return per.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
