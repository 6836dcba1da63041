"""Problem 2: raw delimited records, those that load as typed rows and those that don't with the reason and its offset.

A finite-state machine over bytes reads the records (RFC 4180: quotes only around a whole field, doubled inside it). Each
byte is a function from the state before it to the state after it; such functions compose, so the bytes of a batch are cut
into chunks that are composed independently, the chunks' functions are combined by a prefix scan, and with the state at
every chunk's start known, all chunks are resolved independently. A record may span any number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, SEPARATOR, QUOTE, END = range(4)
#: State after a byte of each class (rows), by the state before it (columns).
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
CHUNK = 64
# A number as it may stand in a result, without outer blanks.
NUMBER = r"^<?\s*\+?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d*)?(?:[eE][+-]?\d+)?$"
HAS_DIGIT = r"^<?\s*\+?(?:\d|\.\d)"


def run_machine(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State after each byte, by chunks: compose, scan, resolve."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // chunk)
    padded = np.zeros(blocks * chunk, np.uint8)
    padded[:n] = classes
    padded = np.ascontiguousarray(padded.reshape(blocks, chunk).T)
    whole = np.tile(np.arange(5, dtype=np.uint8), (blocks, 1))
    for row in padded:
        whole = STEP[row[:, None], whole]
    reach = 1
    while reach < blocks:  # whole[i] becomes the function of all chunks up to i
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.full(blocks, START, np.uint8)
    state[1:] = whole[:-1, START]
    out = np.empty((chunk, blocks), np.uint8)
    for j, row in enumerate(padded):
        state = STEP[row, state]
        out[j] = state
    return out.T.reshape(-1)[:n]


def tokenize(records: list[bytes], n_columns: int, separator: bytes = b",") -> tuple[list, list, list]:
    """Of each record: reason or None, byte offset of the error or None, its fields or None."""
    lengths = np.fromiter(map(len, records), np.int64, len(records))
    data = np.frombuffer(b"\0".join(records) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    classes = np.zeros(len(data), np.uint8)
    classes[data == separator[0]] = SEPARATOR
    classes[data == ord('"')] = QUOTE
    bare = (data == 10) | (data == 13)
    classes[ends] = END
    state = run_machine(classes)
    before = np.empty_like(state)
    before[0], before[1:] = START, state[:-1]
    starts = ends - lengths
    last = before[ends]
    splits = np.flatnonzero((classes == SEPARATOR) & (state == START))
    first_split = np.searchsorted(splits, starts)
    n_splits = np.searchsorted(splits, ends) - first_split
    # a line break outside quotes would end the record: it's then not one record of n columns
    lines = np.flatnonzero(bare & (state != QUOTED) & (state != BROKEN))
    broken_line = np.searchsorted(lines, ends) > np.searchsorted(lines, starts)
    fails = np.flatnonzero((state == BROKEN) & (before != BROKEN))
    opens = np.flatnonzero((state == QUOTED) & (before == START))
    reasons: list = [None] * len(records)
    offsets: list = [None] * len(records)
    fields: list = [None] * len(records)
    for i, raw in enumerate(records):
        if last[i] == BROKEN:
            reasons[i], offsets[i] = "broken_quoting", int(fails[np.searchsorted(fails, starts[i])] - starts[i])
        elif last[i] == QUOTED:
            reasons[i], offsets[i] = "broken_quoting", int(opens[np.searchsorted(opens, ends[i]) - 1] - starts[i])
        elif broken_line[i] or n_splits[i] + 1 != n_columns:
            k = first_split[i] + n_columns - 1
            reasons[i], offsets[i] = "column_count", int(splits[k] - starts[i]) if n_splits[i] + 1 > n_columns else len(raw)
        else:
            at = [-1, *(splits[first_split[i] : first_split[i] + n_splits[i]] - starts[i]).tolist(), len(raw)]
            fields[i] = [x[1:-1].replace(b'""', b'"').decode() if x[:1] == b'"' else x.decode() for a, b in zip(at, at[1:]) for x in (raw[a + 1 : b],)]
    return reasons, offsets, fields


def parse_records(df: DataFrame, raw: str, columns: list[str], separator: str = ",") -> DataFrame:
    """Adds ``reason`` (broken_quoting, column_count or null), ``error_offset`` in bytes and ``fields``.

    A null record has reason column_count at offset 0, as an empty one; both have fewer fields than any table, unless the
    table has one column. Other columns are kept, but for ones of the new names, which are replaced. ``columns`` are the names
    of the table that the records belong to.
    """
    df = df.drop(*({"reason", "error_offset", "fields"} - {raw}))
    n = len(columns)
    schema = T.StructType([*df.schema.fields, T.StructField("reason", T.StringType()), T.StructField("error_offset", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType()))])
    place = df.columns.index(raw)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            reasons, offsets, fields = tokenize([x or b"" for x in texts], n, separator.encode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reasons, pa.string()), pa.array(offsets, pa.int32()), pa.array(fields, pa.list_(pa.string()))],
                names=[*batch.schema.names, "reason", "error_offset", "fields"],
            )

    return df.mapInArrow(parsed, schema)


def number(c: Column) -> Column:
    """The finite number ≥ 0 in a result's text (leading ``<`` for below a limit, thousands commas), else null."""
    t = F.trim(c)
    value = F.regexp_replace(t, r"[<,+\s]", "").try_cast("double")
    return F.when(t.rlike(NUMBER) & t.rlike(HAS_DIGIT) & (value < F.lit(float("inf"))), value)


def load_records(df: DataFrame, raw: str, columns: list[str], numeric: list[str], coded: dict[str, list[str]], separator: str = ",") -> DataFrame:
    """The records with ``reason`` and ``error_offset``, and for loadable ones the typed ``columns``.

    ``numeric`` columns must be empty or a number (see number(); ``<name>_below`` tells of a ``<``), ``coded`` ones empty
    or codes of the list separated by single blanks; other columns stay text. A record that breaks a rule has the first
    reason of broken_quoting, column_count, invalid_value, and nulls in ``columns``.
    """
    out = parse_records(df, raw, columns, separator)
    new = {"reason", "error_offset", "fields", *columns, *(f"{c}_below" for c in numeric)}
    at = {c: F.col("fields")[i] for i, c in enumerate(columns)}
    checks = [(F.trim(at[c]) != "") & number(at[c]).isNull() for c in numeric]
    for c, codes in coded.items():
        one = "(?:" + "|".join("\\Q" + x + "\\E" for x in codes) + ")" if codes else "(?!)"
        checks.append((at[c] != "") & ~at[c].rlike(f"^{one}(?: {one})*$"))
    bad = checks[0]
    for c in checks[1:]:
        bad = bad | c
    good = F.col("fields").isNotNull() & ~bad
    typed = {c: F.when(good, number(at[c]) if c in numeric else at[c]) for c in columns}
    below = {f"{c}_below": F.when(good, F.trim(at[c]).startswith("<")) for c in numeric}
    reason = F.coalesce(F.col("reason"), F.when(bad, F.lit("invalid_value")))
    return out.select(*[c for c in df.columns if c not in new], reason.alias("reason"), "error_offset", *[v.alias(k) for k, v in (typed | below).items()])
