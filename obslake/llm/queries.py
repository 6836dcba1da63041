"""The pN_ queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslake.llm import mixing, packing, personal, tokens
from obslake.tables import checkpointed, table

#: Rows of a parameter list, and names of a list of given names, which every worker holds.
LISTED, NAMES = 10_000, 1_000_000


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, d, "documents").select("doc_id", *columns, "text"))


def _short(df: DataFrame, most: int = LISTED) -> list[tuple]:
    rows = df.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter list has at most {most} rows")
    return sorted(tuple(r) for r in rows if None not in tuple(r))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each capacity."""
    return packing.pack_all(_sized(spark, d), _short(table(spark, d, "pack_capacity").select("capacity_id", "max_tokens")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens, unused share and the least possible number of containers."""
    sizes = table(spark, d, "pack_capacity").select("capacity_id", "max_tokens")
    used = p7_packed(spark, d).groupBy("capacity_id", "container").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("c"))
    used = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("c").alias("pieces"))
    out = used.join(F.broadcast(sizes), "capacity_id")
    return out.select("capacity_id", "max_tokens", "containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("unused_share"))


def p7_length_report(spark: SparkSession, d: str) -> DataFrame:
    """Packing by characters instead of tokens, which SQL can count: pieces, characters, the least possible number of
    containers, and how many containers are overfull, documents missing or cut without need."""
    sized = checkpointed(table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("tokens")))
    sizes = table(spark, d, "pack_capacity").select("capacity_id", "max_tokens")
    packed = checkpointed(packing.pack_all(sized, _short(sizes)))
    per = packed.groupBy("capacity_id").agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("characters"))
    full = packed.groupBy("capacity_id", "container").agg(F.sum("piece_tokens").alias("n")).join(F.broadcast(sizes), "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("n") > F.col("max_tokens")).alias("overfull"))
    whole = packed.groupBy("capacity_id", "doc_id").agg(F.sum("piece_tokens").alias("n"), F.count("*").alias("k")).join(sized, "doc_id", "right").join(F.broadcast(sizes), "capacity_id")
    odd = whole.groupBy("capacity_id").agg(F.count_if(~F.col("n").eqNullSafe(F.col("tokens").cast("long"))).alias("missing"), F.count_if((F.col("k") > 1) & (F.col("tokens") <= F.col("max_tokens"))).alias("cut_whole"))
    out = per.join(full, "capacity_id").join(odd, "capacity_id").join(F.broadcast(sizes), "capacity_id")
    return out.select("capacity_id", "pieces", "characters", F.ceil(F.col("characters") / F.col("max_tokens")).alias("least_containers"), "overfull", "missing", "cut_whole")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return checkpointed(_sized(spark, d, "source")), table(spark, d, "mix_target")


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every document that a mixture selects."""
    return mixing.select_mix(*_mix(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual token shares of every mixture."""
    return mixing.mix_report(*_mix(spark, d))


def p8_length_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same by characters instead of tokens, which SQL can count."""
    sized = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("tokens"))
    out = mixing.mix_report(sized, table(spark, d, "mix_target"))
    return out.select("mix_id", "source", F.round("rate", 6).alias("rate"), "documents", "copies", F.col("tokens").alias("characters"), F.round("actual_share", 6).alias("actual_share"))


def _given(spark: SparkSession, d: str) -> set[str]:
    return {r[0] for r in _short(table(spark, d, "given_name").select("given_name"), NAMES)}


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal information."""
    return personal.find_personal(table(spark, d, "documents"), _given(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its mentions replaced."""
    return personal.redact(table(spark, d, "documents"), _given(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (p7_packed, p7_report, p7_length_report, p8_selected, p8_shares, p8_length_shares, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_length_report": """
            select capacity_id, sum(case when n > max_tokens then ceil(n / max_tokens) else 1 end)::bigint as pieces, sum(n)::bigint as characters, ceil(sum(n) / any_value(max_tokens))::bigint as least_containers,
                0 as overfull, 0 as missing, 0 as cut_whole
            from (select coalesce(length(text), 0) as n from documents), pack_capacity group by 1""",
        "p8_length_shares": """
            with s as (select source, sum(length(text)) as held from documents where source is not null group by 1),
            m as (select mix_id, t.source, target_share, max_repeats, held, min(max_repeats * held / target_share) over (partition by mix_id) as total from mix_target t join s using (source)),
            r as (select mix_id, source, least(max_repeats::double, total * target_share / held) as rate from m),
            c as (select mix_id, source, rate, length(text) as n, floor(rate)::int + (('0x' || substr(md5('mix|' || mix_id || '|' || doc_id), 1, 13))::bigint / 4503599627370496.0 < rate - floor(rate))::int as copies from documents join r using (source)),
            p as (select mix_id, source, rate, count(*) filter (copies > 0) as documents, sum(copies)::bigint as copies, sum(copies * n)::bigint as characters from c group by 1, 2, 3)
            select mix_id, source, round(rate, 6) as rate, documents, copies, characters, round(characters / sum(characters) over (partition by mix_id), 6) as actual_share from p""",
    }
