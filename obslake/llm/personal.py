"""Problem 9: personal information in free text, found and replaced by typed placeholders.

High-recall generators (spans.py) propose overlapping spans with features of their format and context; boosted trees,
trained here, give calibrated probabilities; thresholds select spans. Counts, labels, calibration and thresholds come from
all documents, and every document takes part in the trees: each round's tree is fitted to another part of them.

There are no labels, so they come from the agreement of documents, which the trees don't see: a number or an address is
labelled by what stands in the same surroundings in other documents, an email address by whether other documents write to
its domain, a name by whether other documents have its surname in an address of mail or behind many given names, or use the word for
something else. A span's own
format and words, which are the trees' features, have no part in its label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslake.llm import spans
from obslake.llm.boosting import Boosted
from obslake.llm.spans import KINDS, Words
from obslake.tables import checkpointed, lookup_join, spread

#: Parts that documents are cut into by a hash of their text: those that the trees are fitted to, one for each round, and those
#: that are held out for the calibration.
FIT_PARTS, HELD_PARTS = 60, 15
#: A round is fitted to its own part and as many of the next as make this many documents.
ROUND_DOCS = 4000
#: Bins of the log odds and significant digits of features, by which all spans are counted for thresholds and for bins.
ODDS_BIN, DIGITS = 0.01, 3
SPAN = "s int, e int, kind string, f array<double>, a string, b string, c string, strong boolean, word string, parts array<string>, thing boolean, back boolean, own_n int, own_yes int"
SPAN_NAMES = [x.split()[0] for x in SPAN.split(", ")]
#: Words that make at least this share of all words, or of those beside names, are known one by one; so there are at most
#: three times its inverse.
LEAST_SHARE = 1e-6
#: Patterns that hardly anything else is written in; they vote for their surroundings, never for themselves.
STRONG = {"phone": (0, 1, 5, 7, 9, 10), "identity": (0, 3, 4, 5, 6, 7)}
#: Spans in the same surroundings of other documents that a label needs, and the shares of strong ones that decide it.
VOTES, YES, NO = 3, 0.25, 0.04
#: Features in which the probability can't fall: the more a word looks like a surname, and the surer its given name.
INCREASING = {"name": (0, 1)}
_SEPARATED = re.compile(r"[ ()./+ -]")


class Surroundings:
    """Of each kind, how often spans in given surroundings are strong: by the three tokens around, and by each of them."""

    def __init__(self) -> None:
        self.whole: dict[str, dict] = {k: defaultdict(lambda: [0, 0]) for k in KINDS}
        self.single: dict[str, list[dict]] = {k: [defaultdict(lambda: [0, 0]) for _ in range(3)] for k in KINDS}
        self.base: dict[str, float] = dict.fromkeys(KINDS, 0.5)

    def add(self, kind: str, key: tuple[str, str, str], strong: bool) -> None:
        for table, k in ((self.whole[kind], key), *zip(self.single[kind], key)):
            table[k][0] += 1
            table[k][1] += strong

    def close(self) -> Surroundings:
        for kind in KINDS:
            n, yes = (sum(x[i] for x in self.whole[kind].values()) for i in (0, 1))
            self.base[kind] = (yes + 1) / (n + 2)
            self.single[kind] = [dict(t) for t in self.single[kind]]
            self.whole[kind] = dict(self.whole[kind])
        return self

    def features(self, kind: str, key: tuple[str, str, str], own: tuple[int, int] = (0, 0)) -> list[float]:
        """Shrunk share of strong spans beside each token, and the logarithm of how many spans tell it, without ``own``,
        the counts of the document itself."""
        out = []
        for table, t in zip(self.single[kind], key):
            n, yes = table.get(t, (0, 0))
            n, yes = max(0, n - own[0]), max(0, yes - own[1])
            out += [(max(yes, 0) + 2 * self.base[kind]) / (n + 2), float(np.log1p(n))]
        return out

    def vote(self, kind: str, key: tuple[str, str, str], own: tuple[int, int]) -> int | None:
        n, yes = self.whole[kind].get(key, (0, 0))
        n, yes = n - own[0], yes - own[1]
        return None if n < VOTES else 1 if yes >= YES * n else 0 if yes <= NO * n else None


def domain(mail: str) -> str:
    m = spans.EMAIL_PARTS.match(mail)
    return spans.DOTS.sub(".", m[2]).strip(" .").lower() if m else ""


def local_words(mail: str) -> set[str]:
    """Words of the part before the at-sign, whole and without an initial."""
    m = spans.EMAIL_PARTS.match(mail)
    own = re.split(r"\+", m[1].lower(), maxsplit=1)[0] if m else ""
    return {x for w in re.findall(spans.WORD, own) for x in (w, w[1:]) if len(x) >= 4}


def candidates(text: str, w: Words) -> dict[str, list[tuple[int, int, list[float], tuple[str, str, str], bool, str]]]:
    """Of each kind, (start, end, features, surroundings, strong, word) of its proposed spans; word is a name's surname
    or an address of mail itself."""
    out: dict[str, list] = {k: [] for k in KINDS}
    for s, e in spans.email_candidates(text):
        t = text[s:e]
        d = domain(t)
        plain = "@" in t and " " not in t and "[" not in t and "(" not in t
        last = d.rsplit(".", 1)[-1]
        out["email"].append((s, e, ["." in d and last.isalpha() and len(last) > 1, e - s, sum(map(str.isdigit, t)), t.count("."), t.count(" "), len(d), d.count("."), len(last), "@" in t, len(t) - len(d)], ("", "", ""), plain, t))
    phones, identities = spans.number_candidates(text)
    for kind, found, patterns in (("phone", phones, spans.PHONE), ("identity", identities, spans.IDENTITY)):
        for s, e, k in found:
            t = text[s:e]
            digits, letters = sum(map(str.isdigit, t)), sum(map(str.isalpha, t))
            f = [k, k < len(patterns), digits, e - s, t.startswith(("+", "00")), t.startswith("0"), t.startswith("("), letters, t.count("-"), t.count(" ") + t.count(" "), t.count("."), t.count("/"), text[s - 1 : s] in ("", "\n")]
            out[kind].append((s, e, f, spans.surroundings(text, s, e, w), k in STRONG[kind] and (letters > 0 or _SEPARATED.search(t) is not None), ""))
    lowered = text == text.lower()
    for s, e, k in spans.address_candidates(text):
        words = re.findall(spans.WORD, text[s:e])
        capital = sum(x[0].isupper() for x in words) / max(len(words), 1)
        first = words[0].lower() in w.common if words else False
        f = [k, e - s, len(words), capital, lowered, sum(map(str.isdigit, text[s:e])), first and k == 0, "\n" in text[s:e], text[s - 1 : s] in ("", "\n")]
        out["address"].append((s, e, f, spans.surroundings(text, s, e, w), capital == 1 or (k > 0 and capital > 0), ""))
    out["name"] = [(s, e, f, spans.surroundings(text, s, e, w), surname in w.known, surname) for s, e, f, surname in spans.name_candidates(text, w)]
    return out


class Finder:
    """The fitted generators, trees and thresholds. ``fitted`` tells, per kind, of the spans fitted to: how many there are,
    how many have a label, how many labels the trees overrule, and how many spans without a label they accept."""

    def __init__(self, words: Words, around: Surroundings, models: dict[str, Boosted], thresholds: dict[str, float], fitted: dict[str, tuple[int, int, int, int]]):
        self.words, self.around, self.models, self.thresholds, self.fitted = words, around, models, thresholds, fitted

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text's mentions, in order. Null and empty texts have none."""
        pools: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                for kind, found in candidates(text, self.words).items():
                    pools[kind] += [(i, s, e, f, key) for s, e, f, key, _, _ in found]
        return self.choose(pools, len(texts))

    def choose(self, pools: dict[str, list[tuple[int, int, int, list[float], tuple[str, str, str]]]], n: int) -> list[list[tuple[str, int, int]]]:
        """The mentions of each of n texts, of its proposed spans: of each kind (text, start, end, features, surroundings)."""
        chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in range(n)]
        for kind, pool in pools.items():
            if pool:
                beside = {} if kind == "email" else {key: self.around.features(kind, key) for key in {x[4] for x in pool}}
                p = self.models[kind].predict(np.array([[*f, *beside.get(key, ())] for _, _, _, f, key in pool], float))
                for (i, s, e, f, _), q in zip(pool, p):
                    if q >= self.thresholds[kind]:
                        # of two kinds for one number, the one whose own pattern it has goes before one that it merely may be
                        chosen[i].append((q if kind not in STRONG or f[1] else q / 2, s, e, kind))
        return [select(x) for x in chosen]


#: On overlap the kinds that are told by their format go before the others.
RANK = {"email": 0, "address": 1, "identity": 2, "phone": 2, "name": 4}


def select(found: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int]]:
    """A set of spans without overlaps: by kind, then the longer, then the more probable."""
    taken: list[tuple[int, int, str]] = []
    for _, s, e, kind in sorted(found, key=lambda x: (RANK[x[3]], -(x[2] - x[1]), -x[0], x[1])):
        if all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, kind))
    return [(k, s, e) for s, e, k in sorted(taken)]


def labels(found: list[dict[str, list]], w: Words, around: Surroundings) -> dict[str, list[tuple[list[float], int | None]]]:
    """Of each kind, (features, label) of the documents' spans; the label is what other documents tell, or None."""
    domains: dict[str, set[int]] = defaultdict(set)
    written: dict[str, set[int]] = defaultdict(set)
    behind: dict[str, set[int]] = defaultdict(set)
    for i, doc in enumerate(found):
        for _, _, _, _, plain, t in doc["email"]:
            d = domain(t)
            if plain and "." in d:
                domains[".".join(d.split(".")[-2:])].add(i)
            for x in local_words(t):
                written[x].add(i)
        for _, _, f, _, _, surname in doc["name"]:
            if f[1] == 2 or f[4]:
                behind[surname].add(i)
    elsewhere = lambda table, key, i: len(table.get(key, ())) > (i in table.get(key, ()))
    out: dict[str, list] = {k: [] for k in KINDS}
    for i, doc in enumerate(found):
        for _, _, f, _, _, t in doc["email"]:
            out["email"].append((f, int(elsewhere(domains, ".".join(domain(t).split(".")[-2:]), i))))
        for kind in ("phone", "identity", "address", "name"):
            own: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for _, _, _, key, strong, _ in doc[kind]:
                own[key][0] += 1
                own[key][1] += strong
            if kind == "name":
                break
            for _, _, f, key, _, _ in doc[kind]:
                out[kind].append(([*f, *around.features(kind, key, tuple(own[key]))], around.vote(kind, key, tuple(own[key]))))
        for _, _, f, key, _, surname in doc["name"]:
            parts = [p for p in surname.split("-") if len(p) >= 4 and p not in w.listed and p not in w.given]
            mailed = any(elsewhere(written, p, i) for p in parts) and surname not in w.common
            named = surname in w.known and elsewhere(behind, surname, i)
            # a word that documents hardly ever put behind a given name, or that they write in small letters, is none
            thing = surname in w.other or surname in w.common or surname in w.listed or surname in w.given
            out["name"].append(([*f, *around.features("name", key, tuple(own[key]))], 0 if thing else 1 if mailed or named else None))
    return out


def fit_trees(texts: list[str], words: Words) -> Finder:
    """Trees and thresholds from texts alone, all at once; copies of a text count once, or they would vote for themselves."""
    texts = [t for t in dict.fromkeys(texts) if t]
    words.fit_titled(texts)
    found = [candidates(t, words) for t in texts]
    around = Surroundings()
    for doc in found:
        for kind in ("phone", "identity", "address", "name"):
            for _, _, _, key, strong, _ in doc[kind]:
                around.add(kind, key, strong)
    around.close()
    models, thresholds, fitted = {}, {}, {}
    for kind, rows in labels(found, words, around).items():
        known = [(f, y) for f, y in rows if y is not None]
        x = np.array([f for f, _ in known], float).reshape(len(known), len(known[0][0]) if known else 0)
        y = np.array([y for _, y in known], float)
        models[kind] = Boosted(increasing=INCREASING.get(kind, ())).fit(x, y)
        p = models[kind].predict(x)
        thresholds[kind] = best_threshold(p, y)
        rest = np.array([f for f, y in rows if y is None], float)
        accepted = int((models[kind].predict(rest) >= thresholds[kind]).sum()) if len(rest) else 0
        fitted[kind] = (len(rows), len(known), int(((p >= thresholds[kind]) != (y > 0)).sum()), accepted)
    return Finder(words, around, models, thresholds, fitted)


def _by_word(rows) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for y, n, kinds in rows:
        a, b = out.get(y, (0, 0))
        out[y] = (a + n, b + kinds)
    return out


def fit(texts: list[str], given: set[str]) -> Finder:
    """Words, trees and thresholds from texts alone; deterministic."""
    words = Words(given)
    small, capital, seeds, pairs, inside = spans.word_counts(texts, words.opening)
    words.fit(small, capital, _by_word((y, n, 1) for (_, y), n in seeds.items()))
    follow: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for (x, y), n in pairs.items():
        tells = words.speaks(x, y)
        if tells:
            follow[x] = [a + b for a, b in zip(follow[x], (n, inside[x, y], 1, 0) if tells > 0 else (0, 0, 0, n))]
    return fit_trees(texts, words.fit_given(follow))


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of the best F1, of nearly equal ones the one next to a half; a half where there is nothing to choose by.
    Each row counts n times, once without n."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    n = np.ones(len(y)) if n is None else n
    order = np.argsort(-p)
    q = p[order]
    f1 = 2 * np.cumsum((n * y)[order]) / (np.cumsum(n[order]) + (n * y).sum())
    cut = (q + np.r_[q[1:], 0.0]) / 2
    good = np.flatnonzero((f1 >= f1.max() - 0.002) & (np.r_[q[1:], -1.0] < q))
    return float(cut[good[np.abs(cut[good] - 0.5).argmin()]]) if len(good) else 0.5


def corpus_words(documents: DataFrame, given: set[str]) -> Words:
    """The words of all documents: counted in every text, summed up by word and by pair, and of these tables only words
    of at least LEAST_SHARE of all words, of all behind given names or of all before surnames are brought to the driver."""
    words = Words(given)
    opening = words.opening

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small, capital, seeds, pairs, inside = spans.word_counts(batch.column(0).to_pylist(), opening)
            rows = [(w, None, small[w], capital[w], 0) for w in {*small, *capital}] + [(x, y, pairs[x, y], inside[x, y], seeds[x, y]) for x, y in {*pairs, *seeds}]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["a", "b", "n", "m", "k"])

    counted = spread(documents.select("text")).mapInArrow(count, "a string, b string, n long, m long, k long")
    counted = checkpointed(counted.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in "nmk"]))
    single = counted.where("b is null")
    least = (single.agg(F.sum(F.col("n") + F.col("m"))).first()[0] or 0) * LEAST_SHARE
    behind = counted.where("b is not null and k > 0").groupBy("b").agg(F.sum("k").alias("n"), F.count("*").alias("kinds"))
    behind = behind.where(F.col("n") >= (behind.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE)
    seeds = behind.collect()
    asked = single.join(behind.select(F.col("b").alias("a"), F.lit(True).alias("seed")), "a", "left")
    known = asked.where((F.col("n") + F.col("m") >= least) | F.col("seed")).select("a", "n", "m").collect()
    words.fit({r[0]: r[1] for r in known if r[1]}, {r[0]: r[2] for r in known if r[2]}, {r[0]: (r[1], r[2]) for r in seeds})

    def tells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [words.speaks(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(told, pa.int32())], names=["a", "n", "m", "told"])

    told = counted.where("b is not null and n > 0").select("a", "b", "n", "m").mapInArrow(tells, "a string, n long, m long, told int")
    of = lambda v, c: F.sum(F.when(F.col("told") == v, F.col(c)).otherwise(0))
    told = checkpointed(told.where("told <> 0"))
    least = (told.where("told > 0").agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE
    follow = told.withColumn("one", F.lit(1)).groupBy("a").agg(of(1, "n").alias("n"), of(1, "m").alias("m"), of(1, "one").alias("kinds"), of(-1, "n").alias("given")).where((F.col("n") >= 2) & (F.col("n") >= least)).collect()
    return words.fit_given({r[0]: (r[1], r[2], r[3], r[4]) for r in follow})


def corpus_titled(documents: DataFrame, words: Words) -> Words:
    """Words behind which a title stands more often than a given name in all documents, copies of a text counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = words.title_counts([t for t in batch.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["a", "n"])

    counted = spread(documents.select("text").distinct()).mapInArrow(count, "a string, n long").groupBy("a").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted.where("n > 0"))
    least = (counted.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE
    words.titled = {r[0] for r in counted.where(F.col("n") >= least).select("a").collect()}
    return words


def corpus_spans(documents: DataFrame, words: Words) -> DataFrame:
    """Rows (rid, doc_id, hash, spans): every document with its proposed spans and what they tell other documents."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, docs, ends = [], [], [0]
            for i, text in enumerate(batch.column(3).to_pylist()):
                for kind, found in candidates(text, words).items():
                    own: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
                    for _, _, _, key, strong, _ in found:
                        own[key][0] += 1
                        own[key][1] += strong
                    for s, e, f, key, strong, word in found:
                        parts, thing = [], False
                        if kind == "email":
                            d = domain(word)
                            strong, parts, word = strong and "." in d, sorted(local_words(word)), ".".join(d.split(".")[-2:])
                        elif kind == "name":
                            thing = word in words.other or word in words.common or word in words.listed or word in words.given
                            parts = [p for p in word.split("-") if len(p) >= 4 and p not in words.listed and p not in words.given]
                        out.append((s, e, kind, [float(x) for x in f], *key, bool(strong), word, parts, thing, kind == "name" and bool(f[1] == 2 or f[4]), *own[key]))
                if len(out) > ends[-1]:
                    docs.append(i)
                    ends.append(len(out))
            span = schema.field("spans").type.value_type
            columns = zip(*out) if out else [()] * len(SPAN_NAMES)
            flat = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, span)], fields=list(span))
            own = batch.take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(3)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=schema.field("spans").type)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    texts = documents.where("text is not null and text != ''").select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    texts = spread(texts.select("rid", "doc_id", F.md5("text").alias("hash"), "text"))
    span = ",".join(x.replace(" ", ":", 1) for x in SPAN.split(", "))
    kind = f"rid long, doc_id {dict(documents.dtypes)['doc_id']}, hash string, spans array<struct<{span}>>"
    empty = documents.sparkSession.createDataFrame([], kind)
    schema = to_arrow_schema(empty.schema)
    return checkpointed(texts.mapInArrow(propose, empty.schema))


def corpus_labels(rows: DataFrame) -> tuple[DataFrame, Surroundings]:
    """The spans ``rows`` (of each text once) with ``y``, their label by what other documents tell or null, and the counts of
    their surroundings. The same as labels() of all texts, in aggregates and joins."""
    numbers = rows.where("kind != 'email'")
    whole = checkpointed(numbers.groupBy("kind", "a", "b", "c").agg(F.count("*").alias("n"), F.sum(F.col("strong").cast("long")).alias("yes")))
    around = Surroundings()
    # tokens are ordinary words, which are known one by one, and single signs
    for kind, k, token, n, yes in whole.select("kind", "n", "yes", F.posexplode(F.array("a", "b", "c"))).groupBy("kind", "pos", "col").agg(F.sum("n"), F.sum("yes")).collect():
        around.single[kind][k][token] = [n, yes]
    shares = {r[0]: (r[2] + 1) / (r[1] + 2) for r in whole.groupBy("kind").agg(F.sum("n"), F.sum("yes")).collect()}
    around.close()
    around.base |= shares
    told = lambda df, key: df.groupBy(key).agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    elsewhere = F.coalesce((F.col("lo") != F.col("rid")) | (F.col("hi") != F.col("rid")), F.lit(False))
    mails = lookup_join(rows.where("kind = 'email'"), told(rows.where("kind = 'email' and strong"), "word"), ["word"]).withColumn("y", elsewhere.cast("int"))
    n, yes = F.col("n") - F.col("own_n"), F.col("yes") - F.col("own_yes")
    vote = F.when(n < VOTES, None).when(yes >= YES * n, 1).when(yes <= NO * n, 0)
    others = lookup_join(rows.where("kind in ('phone', 'identity', 'address')"), whole, ["kind", "a", "b", "c"]).withColumn("y", vote)
    names = rows.where("kind = 'name'")
    written = told(rows.where("kind = 'email'").select("rid", F.explode("parts").alias("part")), "part")
    mailed = lookup_join(names.where("not thing").select("rid", "word", F.explode("parts").alias("part")).distinct(), written, ["part"], "inner").where(elsewhere).select("rid", "word", F.lit(1).alias("mailed")).distinct()
    named = lookup_join(names, told(names.where("back"), "word"), ["word"]).withColumn("named", F.col("strong") & elsewhere).drop("lo", "hi")
    named = lookup_join(named, mailed, ["rid", "word"], salts=1).withColumn("y", F.when(F.col("thing"), 0).when(F.col("mailed").isNotNull() | F.col("named"), 1))
    columns = ["rid", "hash", *SPAN_NAMES, "y"]
    return mails.select(columns).unionByName(others.select(columns)).unionByName(named.select(columns)), around


def fit_corpus(found: DataFrame, words: Words, least_docs: int) -> Finder:
    """Trees, calibration and thresholds from the spans of all documents; copies of a text count once.

    Each round's tree is fitted to another part of the documents, which alone is brought to the driver, so every one of them
    takes part; the held out ones calibrate, and thresholds are chosen by all labelled spans, counted by bins of their odds.
    """
    first = found.groupBy("hash").agg(F.min("rid").alias("rid")).select("rid")
    once = checkpointed(lookup_join(found, first, ["rid"], "left_semi", salts=1).select("rid", "hash", F.inline("spans")))
    labelled, around = corpus_labels(once)

    def with_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            asked = list(zip(r["kind"], zip(r["a"], r["b"], r["c"]), zip(r["own_n"], r["own_yes"])))
            beside = {x: [] if x[0] == "email" else around.features(*x) for x in set(asked)}
            f = [[*f, *beside[x]] for f, x in zip(r["f"], asked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "part", "y")), pa.array(f, pa.list_(pa.float64()))], names=["kind", "part", "y", "f"])

    part = F.pmod(F.xxhash64("hash"), F.lit(FIT_PARTS + HELD_PARTS)).cast("int").alias("part")
    rows = labelled.select("kind", part, "y", "f", "a", "b", "c", "own_n", "own_yes").mapInArrow(with_surroundings, "kind string, part int, y int, f array<double>")
    rows = checkpointed(rows.repartition("part").sortWithinPartitions("part"))
    known = rows.where("y is not null")
    docs = once.agg(F.count_distinct("rid")).first()[0]
    window = FIT_PARTS if docs <= least_docs else max(1, min(FIT_PARTS, -(-least_docs * (FIT_PARTS + HELD_PARTS) // docs)))
    models = {k: Boosted(rounds=FIT_PARTS, increasing=INCREASING.get(k, ())) for k in KINDS}
    tally = {(r[0], r[1]): r[2] for r in known.groupBy("kind", "y").agg(F.count("*")).collect()}
    # bins by the quantiles of all features of all labelled spans, counted by their first digits
    v = F.col("v")
    digits = F.when(v == 0, 0.0).otherwise(F.round(v / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (DIGITS - 1))) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (DIGITS - 1)))
    counted: dict[tuple, list] = defaultdict(list)
    for kind, j, y, value, n in known.select("kind", "y", F.posexplode("f").alias("j", "v")).groupBy("kind", "j", "y", digits).agg(F.count("*")).collect():
        counted[kind, j].append((value, y, n))
    both = {k for k in KINDS if (k, 0) in tally and (k, 1) in tally}
    held: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {}

    def load(k: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        t = known.where(F.col("part") == k).select("kind", "y", "f").toArrow()
        kinds, y, f = np.array(t["kind"].to_pylist(), object), np.array(t["y"].to_pylist(), float), pa.concat_arrays(t["f"].chunks) if len(t) else None
        return {kind: (_matrix(f.filter(pa.array(kinds == kind))), y[kinds == kind]) for kind in both if (kinds == kind).any()}

    def rows_of(kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [held[i % FIT_PARTS][kind] for i in range(k, k + window) if kind in held[i % FIT_PARTS]]
        return (np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])) if parts else (np.zeros((0, 0)), np.zeros(0))

    for kind in KINDS:
        yes, no = tally.get((kind, 1), 0), tally.get((kind, 0), 0)
        models[kind].start([weighted_edges(counted[kind, j], models[kind].bins) for j in range(sum(1 for x in counted if x[0] == kind))] if kind in both else [], (yes + 1) / (yes + no + 2))
    for k in range(FIT_PARTS if both else 0):
        for i in {i % FIT_PARTS for i in range(k, k + window)} - set(held):
            held[i] = load(i)
        for kind in both:
            models[kind].add_tree(*rows_of(kind, k))
        if window < FIT_PARTS:
            held.pop(k)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, f = np.array(batch.column(0).to_pylist(), object), batch.column(3)
            at = np.zeros(len(kinds), np.int64)
            for kind in set(kinds):
                own = kinds == kind
                at[own] = np.rint(models[kind].raw(_matrix(f.filter(pa.array(own)))) / ODDS_BIN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((batch.column(1).to_numpy() >= FIT_PARTS)), batch.column(2), pa.array(at)], names=["kind", "held", "y", "bin"])

    told: dict[str, list] = defaultdict(list)
    for kind, *r in rows.mapInArrow(odds, "kind string, held boolean, y int, bin long").groupBy("kind", "held", "y", "bin").agg(F.count("*")).orderBy("kind", "held", "y", "bin").collect():
        told[kind].append(r)
    thresholds, fitted = {}, {}
    for kind in KINDS:
        own = [r for r in told[kind] if r[1] is not None]
        column = lambda i, rs=own: np.array([r[i] for r in rs], float)
        out, y, f, n = column(0) > 0, column(1), column(2) * ODDS_BIN, column(3)
        if kind in both:
            models[kind].calibrate(f[out], y[out], n[out])
        p = models[kind].odds_to_p(f)
        thresholds[kind] = best_threshold(p, y, n)
        rest = [r for r in told[kind] if r[1] is None]
        taken = models[kind].odds_to_p(column(2, rest) * ODDS_BIN) >= thresholds[kind]
        fitted[kind] = (int(n.sum() + column(3, rest).sum()), int(n.sum()), int(n[(p >= thresholds[kind]) != (y > 0)].sum()), int(column(3, rest)[taken].sum()))
    return Finder(words, around, models, thresholds, fitted)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def weighted_edges(counted: list[tuple[float, int, int]], bins: int) -> np.ndarray:
    """Borders of bins by quantiles of (value, class, count) rows, of all and of each class."""
    value, y, n = (np.array(c, float) for c in zip(*sorted(counted)))
    at = np.linspace(0, 1, bins + 1)

    def quantiles(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.cumsum(n[own])
        return value[own][np.searchsorted(total, at * total[-1]).clip(0, len(total) - 1)] if len(total) else np.zeros(0)

    return np.unique(np.r_[quantiles(y >= 0, at[1:-1]), quantiles(y > 0, at), quantiles(y == 0, at)])


def finder(documents: DataFrame, given: set[str], sample: int = ROUND_DOCS) -> tuple[Finder, DataFrame]:
    """Words, trees and thresholds from all documents, and the proposed spans of each; ``sample`` documents make a round."""
    words = corpus_titled(documents, corpus_words(documents, given))
    found = corpus_spans(documents, words)
    return fit_corpus(found, words, sample), found


def find_personal(documents: DataFrame, given: set[str], sample: int = ROUND_DOCS) -> DataFrame:
    """Rows (doc_id, kind, start_pos, end_pos): every mention in every document, without overlaps.

    Positions count characters (code points) from 0, the end is exclusive. Null and empty texts have no mentions; repeated
    rows give repeated mentions. All documents are counted and fitted to, each tree to about ``sample`` of them or a
    sixtieth; every document is searched whole.
    """
    fitted, found = finder(documents, given, sample)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pools, flat = batch.column(0).to_pylist(), {k: [] for k in KINDS}, batch.column(1).flatten()
            at = np.repeat(np.arange(len(ids)), np.diff(batch.column(1).offsets.to_numpy())).tolist()
            c = {name: flat.field(name).to_pylist() for name in ("s", "e", "kind", "a", "b", "c")}
            ends, values = flat.field("f").offsets.to_pylist(), flat.field("f").values.to_numpy().tolist()
            for i, k, s, e, x, y, key in zip(at, c["kind"], c["s"], c["e"], ends, ends[1:], zip(c["a"], c["b"], c["c"])):
                pools[k].append((i, s, e, values[x:y], key))
            rows = [(i, *m) for i, own in zip(ids, fitted.choose(pools, len(ids))) for m in own]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "kind", "start_pos", "end_pos"])

    shown = F.transform("spans", lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "kind", "f", "a", "b", "c")])).alias("spans")
    return spread(found.select("doc_id", shown)).mapInArrow(search, "doc_id long, kind string, start_pos int, end_pos int")


def redact_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each mention replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, given: set[str], sample: int = ROUND_DOCS) -> DataFrame:
    """The documents (doc_id, redacted, mentions): the whole text with placeholders; null stays null."""
    fitted = finder(documents, given, sample)[0]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = fitted.find_all(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact_text(t, f) for t, f in zip(texts, found)], pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["doc_id", "redacted", "mentions"])

    return spread(documents.select("doc_id", "text")).mapInArrow(replace, "doc_id long, redacted string, mentions int")
