"""What an explorer shows of a table: its structure with nested dimensions and hypotheses (A24), and the evidence for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslake.functions import timestamps
from obslake.functions import values as V
from obslake.operators import dependencies, profile, sampling

SAMPLE_LIMIT = 100


def explorer_summary(df: DataFrame, structure: dict | None = None) -> dict:
    """structure, dimensions, relationships, row_count, distinct_primary_records, hypotheses, requires_confirmation.

    Every row counts. To be confirmed is a structure of a confidence under 0.85, with several identities or times, or with
    a nesting of a confidence under 0.95.
    """
    s = structure or profile.dataset_structure(df)
    dimensions = {"identity": s["identity_candidates"], "display": profile.named_like([c for c in df.columns if c not in s["ignored"]], profile.DISPLAY_TERMS), "timestamp": s["time_candidates"], "location": s["location"], "hierarchy": s["hierarchy"]}
    fields = list(dict.fromkeys(f for k in ("hierarchy", "location", "identity", "display") for f in dimensions[k]))
    relationships = dependencies.dimension_relationships(df, fields).orderBy("child", "parent").collect()  # at most a row per pair of fields
    distinct = F.count_distinct(V.present_text(s["identity"])) if s["identity"] else F.lit(0)
    size = df.agg(F.count("*").alias("n"), distinct.alias("k")).first()
    confirm = s["confidence"] < 0.85 or len(dimensions["identity"]) > 1 or len(dimensions["timestamp"]) > 1 or any(r["confidence"] < 0.95 for r in relationships)
    return {"structure": s, "dimensions": dimensions, "relationships": relationships, "row_count": size["n"], "distinct_primary_records": size["k"], "hypotheses": profile.hypotheses(s), "requires_confirmation": confirm}


def inspect_dataset(df: DataFrame, seq: str, limit: int = SAMPLE_LIMIT) -> dict:
    """The explorer's summary with historical_relationships, observation_model, sample (a DataFrame) and sampling_evidence.

    The structure (A22) gives entity and time of the stratified sample (A05); the sample is shown, all else is inferred from
    every row. ``seq`` orders rows of one time and is no field of the table's structure.
    """
    own = df.drop(seq)
    s = profile.dataset_structure(own)
    out = explorer_summary(own, s)
    fields = list(dict.fromkeys(f for k in ("identity", "display", "location", "hierarchy") for f in out["dimensions"][k]))
    timed = df.withColumn("__entity", F.col(s["identity"]) if s["identity"] else F.lit(None).cast("string"))
    if s["time"] and dict(df.dtypes)[s["time"]] == "string":
        timed = timestamps.with_parsed_time(timed, s["time"]).withColumn("__time", F.timestamp_micros("t_local_us"))
    else:
        timed = timed.withColumn("__time", F.col(s["time"]) if s["time"] else F.lit(None).cast("timestamp"))
    sample = sampling.stratified_sample(timed.select(*df.columns, "__entity", "__time"), "__entity", "__time", seq, limit)
    evidence = sampling.sampling_evidence(sample, df, "__entity", "__time", limit).first()
    related = dependencies.functional_dependencies(own, fields).orderBy("determinant", "dependent").collect()
    model = profile.observation_shape(own, own.columns, s["identity"], s["time"], s["metrics"])
    return out | {"sample": sample.drop("__entity", "__time"), "sampling_evidence": evidence, "historical_relationships": related, "observation_model": model}


def report(found: dict) -> list[tuple[str, str]]:
    """(part, found) rows of a summary or an inspection; the sample itself isn't among them."""
    shown = lambda v: "|".join(map(str, v)) if isinstance(v, list) else str(v)
    rows = [(f"structure.{k}", shown(v)) for k, v in found["structure"].items()] + [(f"dimensions.{k}", shown(v)) for k, v in found["dimensions"].items()]
    rows += [(k, str(found[k])) for k in ("row_count", "distinct_primary_records", "requires_confirmation")]
    rows += [("relationship", f"{r['child']}|{r['parent']}|{r['confidence']}|{r['coverage']}") for r in found["relationships"]]
    rows += [("hypothesis", shown(list(h))) for h in found["hypotheses"]]
    if "sampling_evidence" in found:
        rows += [(f"sample.{k}", str(v)) for k, v in found["sampling_evidence"].asDict().items()]
        rows += [("historical_relationship", f"{r['determinant']}|{r['dependent']}|{round(r['confidence'], 6)}") for r in found["historical_relationships"]]
        rows += [(f"model.{k}", shown(found["observation_model"][k])) for k in ("shape", "confidence", "metrics")]
    return rows
