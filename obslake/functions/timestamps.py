"""Time texts of many layouts as instants, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layouts that are read, as one Java pattern: a date of five kinds (year-month-day, yyyymmdd,
# month/day/year, Month day year, day Month year; the day of the week may precede), a time of day, am or pm, a zone.
_DATES = [
    r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})",
    r"(\d{4})(\d{2})(\d{2})",
    r"(\d{1,2})/(\d{1,2})/(\d{4})",
    r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})",
    r"(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})",
]
_TIME = r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r" ?((?:[A-Za-z]{1,5})?(?:[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_/+\-]+\])?)"
LAYOUT = r"^(?:[A-Za-z]{3,9},? )?(?:" + "|".join(_DATES) + r")(?:[Tt]|,? )" + _TIME + _HALF + _ZONE + "$"
#: Year, month, day, hour, minute, second, fraction, half of the day, zone: of each kind of date the groups that hold them.
PARTS = "$1$5$10$13$16|$3$6$8$11$15|$4$7$9$12$14|$17|$18|$19|$20|$21|$22"
_EPOCH = r"^[+-]?\d{1,19}(?:\.\d{1,9})?$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
#: Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
DAY_US = 86_400_000_000
#: The layouts that are read without the pattern.
PLAIN = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{3})?Z?$"


def div(a: Column, b: int) -> Column:
    """Whole-number division without a detour over doubles, rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def with_parsed_time(df: DataFrame, text: str, prefix: str = "t_") -> DataFrame:
    """Adds what a time text says by itself: ``<prefix>local_us``, ``<prefix>offset_min``, ``<prefix>region``.

    ``local_us`` are the microseconds of its date and time of day as if it were UTC (of Unix times: of the instant,
    with offset 0); null where the text, without outer blanks, can't be read as a date and time of day. ``offset_min``
    is the stated offset, null if the text states none; ``region`` a bracketed zone name that is stated without an offset.
    An unknown zone word makes the text unreadable. Null and empty texts give nulls.
    """
    p = prefix
    t = F.trim(F.regexp_replace(F.col(text), r"[\s\u00a0]+", " "))
    # most texts are plain, and the long pattern runs over the rest alone: within a condition of its own, or the optimizer
    # would work out what both sides of it share for all texts
    df = df.select("*", F.inline(F.array(F.struct(F.coalesce(F.col(text).rlike(PLAIN), F.lit(False)).alias(f"{p}p")))))
    plain = F.col(f"{p}p")
    # a generator keeps the optimizer from copying the pattern match into every use of its parts
    split = F.when(~plain, F.when(~F.contains(t, F.lit("|")), F.split(F.regexp_replace(t, LAYOUT, PARTS), r"\|")))
    df = df.select("*", F.inline(F.array(F.struct(split.alias(f"{p}s"), F.when(~plain, F.when(t.rlike(_EPOCH), t)).alias(f"{p}e")))))
    # what the pattern doesn't match stays one part
    s = F.when(F.size(f"{p}s") == 9, F.col(f"{p}s"))
    part = [s[i] for i in range(9)]
    month = F.when(part[1].rlike(r"^\d+$"), part[1].try_cast("int")).otherwise((F.instr(F.lit(MONTHS), F.lower(F.substring(part[1], 1, 3))) + 3) / 4)
    hour = part[3].try_cast("int")
    half = F.lower(part[7])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(part[5] == "", F.lit("0")).otherwise(part[5])
    fraction = F.substring(F.concat(part[6], F.lit("000000")), 1, 6)
    ok = F.when((second.try_cast("int") < 60) & (hour < 24), F.lit(True))
    local = F.unix_micros(
        F.try_make_timestamp(part[0].try_cast("int"), F.when(month == F.floor(month), month.cast("int")), part[2].try_cast("int"), F.when(ok, hour), part[4].try_cast("int"), F.concat(second, F.lit("."), fraction).try_cast("decimal(16,6)"), F.lit("UTC"))
    )
    zone = part[8]
    word = F.lower(F.regexp_extract(zone, r"^([A-Za-z]*)", 1))
    signed = F.regexp_extract(zone, r"([+-]\d{2}):?\d{0,2}(?:\[|$)", 1)
    minutes = F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})(?:\[|$)", 1)
    offset = F.when(signed != "", signed.try_cast("int") * 60 + F.when(minutes == "", 0).otherwise(minutes.try_cast("int")) * F.when(signed.startswith("-"), -1).otherwise(1))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[word]
    region = F.nullif(F.regexp_extract(zone, r"\[(.+)\]$", 1), F.lit(""))
    # a word before an offset must be one that means UTC, as in GMT-06:00
    bad = (word != "") & (named.isNull() | (offset.isNotNull() & (named != 0)))
    digits = F.length(F.regexp_extract(F.col(f"{p}e"), r"^[+-]?(\d+)", 1))
    epoch_us = F.when(
        F.col(f"{p}e").isNotNull(),
        F.floor(
            F.col(f"{p}e").try_cast("decimal(38,9)")
            * F.when(digits <= 11, F.lit(1_000_000))
            .when(digits <= 14, F.lit(1_000))
            .when(digits <= 17, F.lit(1))
            .otherwise(F.lit(0.001).cast("decimal(4,3)"))
        ).try_cast("long"),
    )
    is_epoch = F.col(f"{p}e").isNotNull()
    stated = F.endswith(F.col(text), F.lit("Z"))
    simple = F.unix_micros(F.when(stated, F.col(text)).otherwise(F.concat(F.col(text), F.lit("Z"))).try_cast("timestamp"))
    parsed = F.struct(
        F.when(plain, simple).otherwise(F.when(is_epoch, epoch_us).when(~bad, local)).alias(f"{p}local_us"),
        F.when(plain, F.when(stated, 0)).otherwise(F.when(is_epoch, F.lit(0)).when(~bad, F.coalesce(offset, named))).alias(f"{p}offset_min"),
        F.when(~plain, F.when(~bad & offset.isNull() & (word == ""), region)).alias(f"{p}region"),
    )
    return df.select("*", F.inline(F.array(parsed))).drop(f"{p}s", f"{p}e", f"{p}p")


def local_to_utc_us(local_us: Column, zone: Column) -> Column:
    """The one instant of a local time in a zone, in microseconds; null if the zone skips the time or has it twice.

    The offsets a day before and after bound the candidates: a local time is unique if exactly one of both offsets,
    applied to it, comes back to it. Null zone or time gives null.
    """

    def offset(us: Column) -> Column:
        at = F.timestamp_micros(us)
        return F.unix_micros(F.from_utc_timestamp(at, zone)) - us

    before, after = local_us - offset(local_us - DAY_US), local_us - offset(local_us + DAY_US)
    holds = lambda us: us + offset(us) == local_us
    return F.when(before == after, before).when(holds(before) & ~holds(after), before).when(holds(after) & ~holds(before), after)


def utc_text(us: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ss.SSSZ`` of microseconds since 1970, whatever the session's zone; further digits are cut off."""
    ms = div(us, 1000)
    day, rest = div(ms, 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000))
    date = F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    return F.concat(date, F.lit("T"), two(div(rest, 3_600_000)), F.lit(":"), two(div(rest, 60_000) % 60), F.lit(":"), two(div(rest, 1000) % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))
