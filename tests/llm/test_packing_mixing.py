import itertools
import random
from collections import Counter

import pytest

pytest.importorskip("tiktoken")

from obslake.llm import mixing as M  # noqa: E402
from obslake.llm import packing as P  # noqa: E402
from obslake.llm import tokens as T  # noqa: E402


def first_fit_decreasing(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        for i, r in enumerate(rooms):
            if r >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


def brute_fullest(counts, room):
    items = [n for n, c in counts.items() for _ in range(c)]
    return max(sum(x) for k in range(len(items) + 1) for x in itertools.combinations(items, k) if sum(x) <= room)


def test_fullest_combination_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 30) for _ in range(9))
        room = rng.randrange(0, 60)
        use = P.fullest(dict(counts), room)
        assert all(use[n] <= counts[n] for n in use)
        assert sum(n * k for n, k in use.items()) == brute_fullest(counts, room)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 257) for _ in range(5000))
    plan = P.plan_bins(dict(counts), 256)
    used = Counter()
    for times, use in plan:
        assert sum(n * k for n, k in use.items()) <= 256
        for n, k in use.items():
            used[n] += n and k * times
    assert used == counts
    bins, least = sum(t for t, _ in plan), -(-sum(n * c for n, c in counts.items()) // 256)
    assert least <= bins <= first_fit_decreasing(counts.elements(), 256)
    assert P.plan_bins({}, 256) == []


def test_packing_keeps_everything(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 7, 7, 7, 50, 99, 100, 101, 250, 300]) for _ in range(400)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(0, sizes[0])], "doc_id long, tokens int")
    rows = P.pack_all(df, [("c", 100)]).collect()
    per_doc, per_bin = Counter(), Counter()
    for r in rows:
        assert r.piece_tokens <= 100
        per_doc[r.doc_id] += r.piece_tokens
        per_bin[r.container] += r.piece_tokens
    want = Counter()
    for i, n in [*enumerate(sizes), (0, sizes[0])]:
        want[i] += n or 0
    assert per_doc == want and set(r.doc_id for r in rows) == set(range(401))
    assert max(per_bin.values()) <= 100
    whole = [r for r in rows if (sizes[r.doc_id] or 0) <= 100]
    assert all(r.piece_no == 0 for r in whole)
    assert P.pack_all(df.limit(0), [("c", 100)]).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, 0)


TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def test_rates(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 900), (None, 5)], "source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 3), ("m", "b", 0.5, 3), ("m", "b", 0.5, 3), ("m", "none", 0.2, 3), (None, "a", 0.1, 1)], TARGETS)
    assert {r.source: r.rate for r in M.rates(sizes, targets).collect()} == {"a": 3.0, "b": 300 / 900, "none": 0.0}


def _documents(spark, n):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), int(rng.paretovariate(1.3) * 20)) for i in range(n)] + [(90_000, "a", 0), (90_001, "a", None)]
    return docs, spark.createDataFrame(docs, "doc_id long, source string, tokens int")


def test_mix_is_off_by_chance_alone(spark):
    _, df = _documents(spark, 8000)
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 4), ("m", "c", 0.2, 4)], TARGETS)
    report = {r.source: r for r in M.mix_report(df, targets).collect()}
    assert set(report) == {"a", "b", "c"}
    for r in report.values():
        assert abs(r.deviation) <= 4 * r.chance + 1e-9
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    rows = M.select_mix(df, targets).collect()
    copies = Counter((r.doc_id, r.source) for r in rows)
    assert max(copies.values()) <= 4 and all(r.source for r in rows)
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert sorted(map(str, rows)) == sorted(map(str, M.select_mix(df.repartition(7), targets).collect()))
    assert M.select_mix(df.limit(0), targets).count() == 0
    assert M.mix_report(df, targets.limit(0)).count() == 0


def test_copies_of_every_size_class_equal_the_rate(spark):
    _, df = _documents(spark, 8000)
    targets = spark.createDataFrame([(f"m{k}", s, t, 4) for k in range(4) for s, t in (("a", 0.2), ("b", 0.5), ("c", 0.3))], TARGETS)
    seen = {}
    for r in M.with_copies(df, targets).where("tokens > 0").collect():
        assert r.copies in (int(r.rate), int(r.rate) + 1)
        n = seen.setdefault((r.source, r.tokens.bit_length(), r.rate), [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + r.copies
    checked = 0
    for (_, _, rate), (n, copies) in seen.items():
        part = rate - int(rate)
        if n >= 50:
            checked += 1
            assert abs(copies / n - rate) <= 4.5 * (part * (1 - part) / n) ** 0.5 + 1e-9
    assert checked >= 12


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "naïve " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in T.with_token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 20_000
