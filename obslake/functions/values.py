"""Predicates and normal forms of loosely typed values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINITE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
#: Texts that stand for a missing number.
MISSING = ["", "na", "n/a", "nan", "none", "null", "nd", "-", "--"]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return _column(c).cast("string")


def present(c: Column | str) -> Column:
    """Neither null nor the empty text; a value of any type."""
    return _column(c).isNotNull() & (text(c) != "")


def present_text(c: Column | str) -> Column:
    """The value as text, null if it isn't present."""
    return F.nullif(text(c), F.lit(""))


def to_number(c: Column | str) -> Column:
    """Finite number of a value or its text, else null; booleans are no numbers."""
    t = text(c)
    n = F.when(t.rlike(FINITE), t.try_cast("double"))
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def is_number(c: Column | str) -> Column:
    """Whether a value is a number, infinite and undefined ones included."""
    t = text(c)
    return F.coalesce(t.rlike(FINITE) | t.rlike(SPECIAL), F.lit(False))


def to_dirty_number(c: Column | str) -> Column:
    """Number of a text with thousands commas or a leading < of a detection limit; null for texts that mean missing."""
    t = F.trim(text(c))
    clean = F.regexp_replace(F.regexp_replace(t, ",", ""), r"^<\s*", "")
    return F.when(~F.lower(t).isin(MISSING), to_number(clean))


def to_ts(c: Column | str) -> Column:
    """Instant of an ISO text (without zone: UTC, a date alone: its start) or of Unix seconds or milliseconds, else null."""
    t = F.trim(text(c))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ",", "."), r"\s*[Zz]$", "Z"), r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3").try_cast("timestamp"))
    n = to_number(t)
    return F.coalesce(iso, F.when(n.isNotNull(), F.timestamp_micros((F.when(n > 1e10, n * 1e3).otherwise(n * 1e6)).cast("long"))))


def looks_temporal(c: Column | str) -> Column:
    """Whether a text looks like a date: at least 8 characters, beginning with a year, month and day."""
    t = F.trim(text(c))
    return F.coalesce((F.length(t) >= 8) & t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}.*$"), F.lit(False))


def ascii_identifier(c: Column | str) -> Column:
    """Lower case, everything but ASCII letters and digits as one underscore."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def word_identifier(c: Column | str) -> Column:
    """Lower case, everything but letters and digits of any script as one underscore."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def corpus_identifier(c: Column | str) -> Column:
    """As word_identifier, but combining marks and underscores are kept."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{M}\p{N}_]+", "_"), F.lit("_"))


def folded(value: str) -> str:
    """Compatibility form, case folded, words joined by underscores."""
    t = unicodedata.normalize("NFKC", value).casefold()
    return "_".join("".join(c if c.isalnum() or unicodedata.category(c).startswith("M") else " " for c in t).split())


@F.pandas_udf(T.StringType())
def unicode_identifier(s: pd.Series) -> pd.Series:
    """folded() of a column; for names and labels, not for the rows of large tables."""
    return s.map(folded, na_action="ignore")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def canonical_text(c: Column | str) -> Column:
    """Texts that mean the same category: numbers by value (1 as 1.0), others squeezed and in lower case."""
    t = squeeze(c)
    n = to_number(t)
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string"))
    return F.when(n.isNotNull(), F.coalesce(whole, n.cast("string"))).otherwise(F.lower(t))


def joined(*parts: Column | str) -> Column:
    """Present parts joined by " / "."""
    return F.concat_ws(" / ", *[F.nullif(squeeze(p), F.lit("")) for p in parts])


def key_token(*parts: Column | str) -> Column:
    """Reversible text of a composite key: v1: and unpadded URL-safe base64 of a JSON array; null if a part is missing."""
    packed = F.translate(F.base64(F.to_json(F.array(*[text(p) for p in parts])).cast("binary")), "+/\r\n", "-_")
    ok = None
    for p in parts:
        ok = present(p) if ok is None else ok & present(p)
    return F.when(ok, F.concat(F.lit("v1:"), F.rtrim(packed, F.lit("="))))


def key_parts(token: Column | str) -> Column:
    """The parts of key_token()'s text, null if it isn't one."""
    body = F.translate(F.substring(text(token), 4, 1_000_000), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.when(text(token).startswith("v1:"), F.from_json(F.unbase64(padded).cast("string"), "array<string>"))


def stream_id(*parts: Column | str) -> Column:
    """First 20 hexadecimal digits of the SHA-1 of the parts' canonical texts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(canonical_text(p), F.lit("")) for p in parts])), 1, 20)


def entity_key(*parts: Column | str) -> Column:
    """Present parts, trimmed, joined by |; null if none is present."""
    given = F.array(*[F.trim(present_text(p)) for p in parts])
    return F.when(F.size(F.array_compact(given)) > 0, F.array_join(F.array_compact(given), "|"))


def normal_list(c: Column | str) -> Column:
    """The texts of an array trimmed, without nulls, empty and repeated ones, in order; an empty array for null."""
    trimmed = F.transform(_column(c), lambda x: F.trim(x.cast("string")))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def to_iso_ts(c: Column | str) -> Column:
    """As to_ts, but of ISO texts alone: numbers are no times."""
    return F.when(to_number(c).isNull(), to_ts(c))


def json_texts(c: Column | str) -> Column:
    """All texts among the values of a JSON text, at every depth, in order, unescaped; keys, numbers and nulls aren't among
    them. Null for what is no JSON."""
    # texts are matched together with a colon behind them, which makes them keys
    found = F.regexp_extract_all(text(c), F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), F.lit(1))
    values = F.filter(found, lambda x: ~F.endswith(x, F.lit(":")))
    return F.when(F.try_parse_json(text(c)).isNotNull(), F.transform(values, lambda x: F.try_variant_get(F.try_parse_json(F.trim(x)), "$", "string")))
