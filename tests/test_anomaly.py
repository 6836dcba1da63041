import math
import random

import pytest
from pyspark.sql import functions as F

from obslake.operators import anomaly as A

HOUR = 3_600_000_000


def series(seed=1, n=900):
    rng = random.Random(seed)
    return [(i * HOUR + rng.randrange(0, 600) * 1_000_000, round(15 + 6 * math.sin(i / 24 * 6.283) + rng.gauss(0, 0.6), 1)) for i in range(n)]


def rows(points, name="s"):
    return [(name, t, v, -60.0, 60.0, False, HOUR) for t, v in points]


SCHEMA = "series string, t long, v double, lo double, hi double, log_scale boolean, cadence_us long"


def flags(spark, data):
    return {(r.series, r.t): r.flag for r in A.flag_readings(spark.createDataFrame(data, SCHEMA)).collect()}


@pytest.mark.parametrize("shard", [64, 4096])
def test_planted(spark, monkeypatch, shard):
    monkeypatch.setattr(A, "SHARD_READINGS", shard)
    p = series()
    want = {}
    for i, d, k in ((100, 12, 1), (300, -11, 2), (500, 15, 3)):
        for j in range(k):
            p[i + j] = (p[i + j][0], round(p[i + j][1] + d, 1))
            want["s", p[i + j][0]] = "spike"
    for j in range(16):
        p[185 + j] = (p[185 + j][0], p[185][1])
        want["s", p[185 + j][0]] = "stuck"
    for i, v in ((700, 85.0), (701, -99.9)):
        p[i] = (p[i][0], v)
        want["s", p[i][0]] = "out_of_range"
    data = rows(p)
    got = flags(spark, data + data[:50] + [("s", None, 1.0, -60.0, 60.0, False, HOUR), ("s", 5, None, -60.0, 60.0, False, HOUR)])
    extra = {k: v for k, v in got.items() if k not in want}
    assert {k: got.get(k) for k in want} == want
    assert len(extra) <= 2


def test_slow_events_and_short_series_are_no_cases(spark):
    p = series(3)
    for i in range(400, 440):
        p[i] = (p[i][0], round(p[i][1] + 14 * math.sin((i - 400) / 40 * math.pi), 1))
    assert len(flags(spark, rows(p))) <= 1
    assert flags(spark, rows([(0, 1.0)], "one") + rows([(i * HOUR, 5.0) for i in range(30)], "flat")) == {}
    assert A.flag_readings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_relative_steps(spark):
    rng = random.Random(5)
    p = [(i * HOUR, round(10 * math.exp(0.4 * math.sin(i / 30) + rng.gauss(0, 0.12)), 1)) for i in range(600)]
    p[250] = (p[250][0], 95.0)
    df = spark.createDataFrame(rows(p), SCHEMA).withColumn("log_scale", F.lit(True)).withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(1000.0))
    assert {r.t for r in A.flag_readings(df).collect()} == {p[250][0]}


def test_sparse_series_are_judged_by_their_own_gap(spark):
    rng = random.Random(8)
    for times in (1, 3):
        p = [(i * times * HOUR, round(15 + rng.gauss(0, 0.6), 1)) for i in range(500)]
        for i in (120, 340):
            p[i] = (p[i][0], p[i][1] + 30)
        assert flags(spark, rows(p)) == {("s", p[i][0]): "spike" for i in (120, 340)}


def test_a_series_stuck_throughout(spark):
    assert set(flags(spark, rows([(i * HOUR, 5.0) for i in range(500)])).values()) == {"stuck"}
    assert len(flags(spark, rows([(i * HOUR, 5.0) for i in range(500)]))) == 500


def test_a_stretch_is_judged_alike_in_short_and_long_histories(spark):
    got = []
    for n in (300, 6000):
        p = series(4, n)
        for j in range(11):
            p[150 + j] = (p[150 + j][0], p[150][1])
        f = flags(spark, rows(p))
        got.append([f.get(("s", p[150 + j][0])) for j in range(11)])
    assert got[0] == got[1]


@pytest.mark.parametrize("shard", [32, 4096])
def test_runs_across_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(A, "SHARD_READINGS", shard)
    p = series(6, 600)
    for j in range(150):  # longer than several shards
        p[200 + j] = (p[200 + j][0], p[200][1])
    p[250] = (p[250][0], 99.0)
    got = flags(spark, rows(p))
    assert {p[200 + j][0] for j in range(150) if j != 50} <= {t for (_, t), f in got.items() if f == "stuck"}
    assert got["s", p[250][0]] == "out_of_range"
    assert len(got) <= 152


def test_copies_are_flagged_too(spark):
    p = series(7, 400)
    p[50] = (p[50][0], 80.0)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows(p) + rows([p[50]]) * 3)], SCHEMA + ", row_id long")
    flagged = A.flag_readings(df)
    assert flagged.where("flag = 'out_of_range'").count() == 1
    assert sorted(r.row_id for r in A.flag_rows(df, flagged).where("flag = 'out_of_range'").collect()) == [50, 400, 401, 402]
