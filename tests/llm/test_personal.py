import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obslake.llm import personal as P
from obslake.llm.boosting import Boosted

GIVEN = {"Alice", "Martin", "Grace", "Rose", "Hugo", "Lena"}


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    heads, tails = ["Brind", "Cald", "Drum", "Fenn", "Holm", "Lund", "Morv", "Orl", "Tans", "Vant"], ["berg", "mayer", "strand", "quet", "worthy", "inski", "esco", "hausen"]
    given = [*GIVEN, "Keiko", "Tariq", "Xenia"]
    out, truth = [], []
    for _ in range(n):
        parts, spans, at = [], [], 0

        def add(s, kind=None):
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(s)))
            parts.append(s)
            at += len(s)

        for _ in range(rng.randrange(2, 6)):
            g, s = rng.choice(given), rng.choice(heads) + rng.choice(tails)
            k = rng.randrange(8)
            if k == 0:
                add("Please contact "), add(f"{g} {s}", "name"), add(" at "), add(f"{g.lower()}.{s.lower()}@post.test", "email"), add(". ")
            elif k == 1:
                add("Call "), add(rng.choice(["555-0119", "(555) 555-0196", "+1-555-555-0140", "020 7946 0186"]), "phone"), add(f" after 6 pm and ask for Dr. "), add(s, "name"), add(". ")
            elif k == 2:
                add("Driver licence "), add(f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "identity"), add(" was noted at the gate. ")
            elif k == 3:
                add("I live at "), add(f"{rng.randrange(1, 4999)} {rng.choice(['Haven', 'Iris Park', 'Rowan'])} {rng.choice(['Street', 'Lane', 'Way'])}{rng.choice(['', ', Apt 3', ' #4'])}", "address"), add(", please tell me. ")
            elif k == 4:
                add("Grace Harbor and Lake Martin are tidal. The level at Rose Island did not change. ")
            elif k == 5:
                add("The crew cleaned the inlet @ 10 m and reset logger SN 749-7473-44. Ticket 512-22 replaces ticket 67136508150. ")
            elif k == 6:
                add("According to "), add(f"{g[0]}. {s}", "name"), add(", the probe was under ice. ")
            else:
                add("Keys were left with "), add(f"{s}, {g}", "name"), add(" on 2025-11-13. ")
        out.append("".join(parts))
        truth.append(spans)
    return out, truth


@pytest.fixture(scope="module")
def finder():
    return P.fit(corpus(900, 1)[0], GIVEN)


def test_held_out_accuracy(finder):
    texts, truth = corpus(400, 2)
    found = finder.find_all(texts)
    for kind in P.KINDS:
        want = {(i, *s) for i, t in enumerate(truth) for s in t if s[0] == kind}
        got = {(i, *s) for i, f in enumerate(found) for s in f if s[0] == kind}
        hit = len(want & got)
        assert hit / len(want) > 0.95 and hit / max(len(got), 1) > 0.95, (kind, sorted(want - got)[:3], sorted(got - want)[:3])


def test_odd_texts(finder):
    long = ("The phone app reads the same table as the portal. " * 20_000) + "Write to a.b@c.test."
    got = finder.find_all([None, "", " ", "@", long, "x" * 100_000])
    assert got[:4] == [[], [], [], []] and [g[0] for g in got[4]] == ["email"] and got[5] == []
    s, e = got[4][0][1:]
    assert long[s:e] == "a.b@c.test"


def test_disguised_addresses(finder):
    for text in ("write a.b＠c.test now", "write a.b[at]c[dot]test now", "write a.b @ c.test now", "WRITE A.B+X@MAIL.C.TEST NOW", "<a_b (at) c.test>"):
        found = finder.find(text)
        assert [k for k, _, _ in found] == ["email"], text
    assert finder.find("the inlet @ 10 m and an email alert") == []


def test_positions_count_characters(finder):
    text = "😀 Grüße, x.y (at) post.test"
    assert [text[s:e] for _, s, e in finder.find(text)] == ["x.y (at) post.test"]


def test_redaction():
    assert P.redact_text("ab cd ef", [("name", 0, 2), ("email", 6, 8)]) == "[NAME] cd [EMAIL]"
    assert P.redact_text(None, []) is None and P.redact_text("", []) == ""


def test_overlaps_are_resolved():
    assert P.select([(0.9, 0, 10, "name"), (0.5, 2, 6, "email"), (0.9, 8, 12, "phone"), (0.8, 8, 14, "phone")]) == [("email", 2, 6), ("phone", 8, 14)]


def test_labels_come_from_other_documents():
    texts = corpus(300, 5)[0]
    finder = P.fit(texts, GIVEN)
    found = [P.candidates(t, finder.words) for t in texts]
    rows = P.labels(found, finder.words, finder.around)
    assert {y for f, y in rows["name"]} >= {0, 1} and {y for f, y in rows["phone"]} >= {0, 1}
    # alone, a document tells nothing of its own spans
    for kind, alone in P.labels(found[:1], finder.words, P.Surroundings().close()).items():
        assert all(y in (None, 0) for _, y in alone), kind


def test_trees_decide_where_there_is_no_label(finder):
    assert set(finder.fitted) == set(P.KINDS)
    for kind, (spans, labelled, overruled, unlabelled) in finder.fitted.items():
        assert 0 <= overruled <= labelled <= spans and unlabelled <= spans - labelled


def test_words_of_all_documents_equal_words_of_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_SHARE", 0.0)
    texts = corpus(200, 6)[0]
    a = P.corpus_words(spark.createDataFrame([(t,) for t in texts], "text string"), GIVEN)
    b = P.fit(texts, GIVEN).words
    assert (a.common, a.other, a.known, a.given, a.surname) == (b.common, b.other, b.known, b.given, b.surname)


def test_over_tables(spark):
    texts = corpus(60, 3)[0]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    rows = P.find_personal(df, GIVEN, sample=50).collect()
    assert rows and {r.kind for r in rows} <= set(P.KINDS)
    red = {r.doc_id: r for r in P.redact(df, GIVEN, sample=50).collect()}
    assert len(red) == 62 and red[900].redacted is None and red[901].redacted == ""
    assert P.find_personal(df.limit(0), GIVEN).count() == 0


def test_labels_and_surroundings_of_all_documents_equal_those_of_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_SHARE", 0.0)
    texts = corpus(150, 7)[0]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])] + [(900, None), (901, "")], "doc_id long, text string")
    words = P.corpus_titled(df, P.corpus_words(df, GIVEN))
    texts = list(dict.fromkeys(texts))
    assert words.titled == {x for x, n in words.title_counts(texts).items() if n > 0}
    found = [P.candidates(t, words) for t in texts]
    local = P.Surroundings()
    for doc in found:
        for kind in ("phone", "identity", "address", "name"):
            for _, _, _, key, strong, _ in doc[kind]:
                local.add(kind, key, strong)
    local.close()
    proposed = P.corpus_spans(df, words)
    first = proposed.groupBy("hash").agg(F.min("rid").alias("rid")).select("rid")
    rows, around = P.corpus_labels(P.checkpointed(proposed.join(first, "rid", "left_semi").select("rid", "hash", F.inline("spans"))))
    assert around.single == local.single and all(abs(around.base[k] - local.base[k]) < 1e-12 for k in ("phone", "identity", "address", "name"))
    want = Counter((k, y) for k, rs in P.labels(found, words, local).items() for _, y in rs)
    assert Counter((r.kind, r.y) for r in rows.select("kind", "y").collect()) == want and len(want) > 8


def test_every_document_is_fitted_to_whatever_the_size_of_a_round(spark):
    texts = corpus(300, 8)[0]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    few, found = P.finder(df, GIVEN, 10)
    once = sum(len(r.spans) for r in found.dropDuplicates(["hash"]).collect())
    assert sum(n for n, *_ in few.fitted.values()) == once
    assert all(len(m.trees) > 40 for k, m in few.models.items() if k == "name")


def test_boosting_learns_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    a, b = Boosted().fit(x[:2000], y[:2000]), Boosted().fit(x[:2000], y[:2000])
    p = a.predict(x[2000:])
    assert np.array_equal(p, b.predict(x[2000:])) and ((p > 0.5) == y[2000:]).mean() > 0.95
    assert abs(p[p > 0.9].mean() - y[2000:][p > 0.9].mean()) < 0.06
    assert np.allclose(Boosted().fit(x[:5], np.ones(5)).predict(x[:2]), 6 / 7) and len(Boosted().fit(x[:0], y[:0]).predict(x[:0])) == 0
