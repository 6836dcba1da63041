import datetime as dt
import random

from obslake.operators import regular_grid as G

MIN = 60_000_000


def run(spark, readings, deployments, cadence, **kw):
    r = spark.createDataFrame(readings, "source string, utc_us long, value double")
    d = spark.createDataFrame(deployments, "source string, active_from timestamp, active_to timestamp")
    c = spark.createDataFrame(cadence, "source string, cadence_minutes int")
    return {(x.source, x.slot_ms): x for x in G.regular_series(r, d, c, **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    start = dt.datetime(2025, 1, 1, 0, 7, tzinfo=dt.UTC)
    deployments = [("a", start, start + dt.timedelta(hours=30)), ("a", start + dt.timedelta(hours=20), start + dt.timedelta(hours=40)), ("b", start, start + dt.timedelta(hours=50)), ("c", start, start), ("d", None, start)]
    cadence = [("a", 10), ("b", 60), ("c", 10), ("d", 10), ("b", 60)]
    base = int(start.timestamp() * 1e6)
    readings = [(s, base + rng.randrange(-3600, 190_000) * 1_000_000, rng.choice([1.0, 2.5, None])) for s in "aaab" for _ in range(60)] + [("a", None, 1.0), (None, base, 1.0), ("zz", base, 1.0)]
    for shard in (4, 512):
        got = run(spark, readings, deployments, cadence, shard_slots=shard, max_fill_slots=3)
        want = {}
        steps = dict(cadence)
        for s, a, b in deployments:
            if a and b:
                step = steps[s] * 60_000
                lo, hi = int(a.timestamp() * 1000), int(b.timestamp() * 1000)
                for slot in range(-(-lo // step), -(-hi // step)):
                    want[s, slot * step] = None
        assert set(got) == set(want)
        for s in ("a", "b"):
            step = steps[s] * 60_000
            seen = {}
            for src, t, v in readings:
                if src == s and t is not None:
                    seen.setdefault(t // 1000 // step * step, []).append(v)
            for (src, slot), x in got.items():
                if src != s:
                    continue
                assert x.readings == len(seen.get(slot, []))
                assert (x.status == "observed") == (slot in seen)
                inside = [k for k in seen if (s, k) in got and k <= slot]
                if inside:
                    assert x.last_ms == max(inside) or x.last_ms == max(k for k in seen if k <= slot)
                values = [v for v in seen.get(slot, []) if v is not None]
                if values:
                    assert abs(x.value - sum(values) / len(values)) < 1e-9


def test_empty_and_one_minute(spark):
    a = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    got = run(spark, [("m", int(a.timestamp() * 1e6) + MIN, 5.0)], [("m", a, a + dt.timedelta(minutes=4))], [("m", 1)])
    assert [x.status for _, x in sorted(got.items())] == ["empty", "observed", "filled", "filled"]
    assert run(spark, [], [("m", a, a + dt.timedelta(minutes=4))], [("m", 1)])
    assert run(spark, [], [], []) == {}


def test_no_column_depends_on_the_shards(spark):
    rng = random.Random(9)
    start = dt.datetime(2025, 1, 1, 10, tzinfo=dt.UTC)
    base = int(start.timestamp() * 1e6)
    deployments = [("a", start, start + dt.timedelta(hours=6)), ("b", start, start + dt.timedelta(hours=30)), ("b", start + dt.timedelta(hours=50), start + dt.timedelta(hours=90))]
    readings = [("a", base - 8 * 60 * MIN, 5.0), ("b", base + 40 * 60 * MIN, 7.0)] + [("b", base + rng.randrange(100) * 60 * MIN, rng.choice([1.0, None])) for _ in range(25)]
    for fill in (None, 3):
        all_sizes = [{k: tuple(v) for k, v in run(spark, readings, deployments, [("a", 60), ("b", 60)], shard_slots=n, max_fill_slots=fill).items()} for n in (1, 4, 512)]
        assert all_sizes[0] == all_sizes[1] == all_sizes[2]
        assert all(x[-1] == "empty" and x[4] is None for (s, _), x in all_sizes[0].items() if s == "a")
