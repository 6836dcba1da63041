import csv
import io

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from obslake.operators import raw_records as R


def plain_machine(classes):
    state, out = R.START, []
    for c in classes:
        state = int(R.STEP[c, state])
        out.append(state)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(1, 70))
def test_chunks_compose_to_the_whole(classes, chunk):
    assert R.run_machine(np.array(classes, np.uint8), chunk).tolist() == plain_machine(classes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_round_trip_of_quoted_fields(rows):
    records = []
    for row in rows:
        records.append(",".join('"' + f.replace('"', '""') + '"' for f in row).encode())
    reasons, offsets, fields = R.tokenize(records, 3)
    for row, reason, offset, got in zip(rows, reasons, offsets, fields):
        if len(row) == 3:
            assert (reason, offset, got) == (None, None, row)
        else:
            assert reason == "column_count" and got is None


def test_reasons_and_offsets():
    records = ['a,b,c', 'a,"b,c', 'a,b"x,c', '"a"x,b,c', 'a,b', 'a,b,c,d', '', '"a""b","c\nd",e', "a\nb,c,d", ",,"]
    reasons, offsets, fields = R.tokenize([x.encode() for x in records], 3)
    assert reasons == [None, "broken_quoting", "broken_quoting", "broken_quoting", "column_count", "column_count", "column_count", None, "column_count", None]
    assert offsets[1:7] == [2, 3, 3, 3, 5, 0]
    assert fields[7] == ['a"b', "c\nd", "e"] and fields[9] == ["", "", ""]


def test_typed_rows(spark):
    rows = [(1, "n,1.5,J B"), (2, 'n," <1,234.5e1 ",'), (3, "n,-1,"), (4, "n,1,X"), (5, "n,1,J  B"), (6, "n,1e999,"), (7, None), (8, "n,,j"), (9, "n,.5,"), (10, "n,1,23,"), (11, 'n,"1,23",'), (12, "n,., ")]
    df = spark.createDataFrame(rows, "record_id long, raw string").withColumnRenamed("record_id", "id")
    out = {r.id: r for r in R.load_records(df, "raw", ["name", "v", "f"], ["v"], {"f": ["J", "B"]}).collect()}
    assert (out[1].v, out[1].f, out[1].reason) == (1.5, "J B", None)
    assert (out[2].v, out[2].v_below, out[2].f) == (12345.0, True, "")
    assert out[9].v == 0.5
    assert {i for i in out if out[i].reason == "invalid_value"} == {3, 4, 5, 6, 8, 11, 12}
    assert out[7].reason == "column_count" and out[10].reason == "column_count"
    assert all(out[i].name is None for i in out if out[i].reason)
    assert R.load_records(df.limit(0), "raw", ["name", "v", "f"], ["v"], {"f": []}).count() == 0


def test_against_csv_module(spark):
    text = "x" * 200_000
    good = [["a", "b", "c"], [text, 'q"q', "l\nl"], ["", "", ""]]
    buffer = io.StringIO()
    records = []
    for row in good:
        buffer.seek(0), buffer.truncate()
        csv.writer(buffer, lineterminator="").writerow(row)
        records.append(buffer.getvalue().encode())
    assert R.tokenize(records, 3)[2] == good
