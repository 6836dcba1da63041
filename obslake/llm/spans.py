"""Generators of problem 9: every span of a text that may be personal information, with features of its format and place.

Each generator first looks for what its kind can't do without (an at-sign, seven digits close together, a word for a road,
a word that looks like a surname) and matches its patterns only there. Which words look like surnames, given names or
ordinary words is counted over all documents; no list of places, cues or codes takes part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

KINDS = ("email", "phone", "identity", "address", "name")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CAPITAL = "A-ZÀ-ÖØ-Þ"
WORD = f"[{LETTER}]+"

# Generators of emails. A separator may be spelled out or bracketed.
_AT = r"(?:\s?[@＠﹫]\s?|\s?[\[({]\s?(?:at|[@＠]|arroba|arobase)\s?[\])}]\s?)"
_DOT = r"(?:[.．]|\s?[\[({]\s?(?:dot|\.|punto|punkt|point|ponto)\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w.+%'-]*[\w]{_AT}[\w-]+(?:{_DOT}[\w-]+)*|(?<![\w.+%-])[\w.+%-]+\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", re.I)
EMAIL_PARTS = re.compile(rf"(.*?)(?:{_AT}|\s+at\s+)(.*)", re.I | re.S)
DOTS = re.compile(rf"{_DOT}|\s+dot\s+", re.I)
AT_SIGNS = re.compile(r"[@＠﹫]|[\[({]\s?(?:at|arroba|arobase)\s?[\])}]| at (?=\S+ dot )", re.I)

# Ways to write telephone numbers.
_S = r"[  ]"
PHONES = [
    rf"(?:\+?1[-.]|\+?1{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}[-.]|\d{{3}}{_S}(?:/{_S})?)\d{{3}}[-.  ]\d{{4}}",
    rf"(?:\+?1[-.]|\+?1{_S})?\d{_S}\d{_S}\d{_S}-{_S}\d{_S}\d{_S}\d{_S}-{_S}\d{_S}\d{_S}\d{_S}\d",
    r"\d{3}-\d{4}",
    r"(?:\+1)?\d{10}",
    rf"(?:\+44{_S}?(?:\(0\))?|0)\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}",
    rf"(?:\+|00)34[-  ]?\d{{3}}[-  ]?\d{{2,3}}[-  ]?\d{{2,3}}(?:[-  ]?\d{{2}})?",
    rf"\d{{3}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}|\d{{3}}{_S}\d{{3}}{_S}\d{{3}}",
    rf"(?:\+|00)49{_S}?(?:\(0\){_S}?)?\d{{2,5}}[-/  ]?\d{{3,8}}(?:[-  ]\d{{1,5}})?",
    rf"0\d{{2,4}}(?:/|{_S}|{_S}?/{_S}?|-)\d{{3,8}}(?:[-  ]\d{{2,5}})?",
    rf"(?:(?:\+|00)33{_S}?(?:\(0\))?[1-9]|0[1-9])(?:[.  -]?\d{{2}}){{4}}",
    rf"(?:(?:\+|00)(?:55|351){_S}?)?(?:\(\d{{2}}\){_S}?|\d{{2}}{_S})\d{{4,5}}[-  ]\d{{4}}",
]
PHONE = [re.compile(rf"(?<![\w+.,/#-])(?<!\d[  ])(?:{p})(?![\w/]|[-.,:]\w)") for p in PHONES]
PHONE_ANY = re.compile(r"(?<![\w.+/-])(?:\+|\(?)\d[\d() ./ -]{5,22}\d(?![\w/]|[-.,:]\w)")

# Ways to write identity numbers.
IDENTITIES = [
    r"\d{3}[-  ]\d{2}[-  ]\d{4}",
    r"\d{9}",
    r"[A-Z]{2}\d{7}",
    r"[A-Z]\d{3}-\d{4}-\d{4}",
    r"\d{8}[- ]?[A-Z]|\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]",
    r"[A-Z]\d{2}[A-Z]\d{5}|[A-Z]\d{2} \d{3} \d{3}|[A-Z]\d{8}",
    r"[12][  ]?\d{2}[  ]?\d{2}[  ]?\d{2}[  ]?\d{3}[  ]?\d{3}(?:[  ]?\d{2})?",
    r"\d{3}\.\d{3}\.\d{3}-\d{1,2}[A-Z]?|\d{11}",
]
IDENTITY = [re.compile(rf"(?<![\w./+-])(?<!\d[  ])(?:{p})(?![\w/]|[-.]\w)", re.I) for p in IDENTITIES]
IDENTITY_ANY = re.compile(r"(?<![\w./-])[A-Z]?(?=[A-Z0-9]*\d)[A-Z0-9]{7,12}(?![\w/]|[-.]\w)", re.I)
#: Stretches of digits with at most three other signs between them, and dates, which no number begins with.
DIGITS = re.compile(r"\d(?:[\d() ./ -]{0,3}[A-Za-z]?\d)+")
DATE = re.compile(r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d-])")
FEWEST_DIGITS = 7

# Kinds of roads and of parts of a house, by language, and what a text must hold to have one.
_CAP = f"[{LETTER}][{LETTER}'’-]*"
_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Way|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Terrace|Highway|Hwy|Crescent|Close|Parkway|Circle|Trail|Row"
_PART = r"(?:,?[ ](?:Apt|Apartment|Flat|Unit|Suite|Ste|Floor|Room|No)\.?[ ]?(?:\d+[A-Z]?|[A-Z])\b|,?[ ]?\#[ ]?\d+\w?)"
ADDRESSES = [
    rf"(?<![\w.,/:-])\d{{1,5}}[A-Z]?[ ](?:{_CAP}[ ]){{1,3}}?(?:{_EN})(?![{LETTER}])(?:[ ](?:{_EN})(?![{LETTER}]))?(?:(?<=[ ]Rd)\.|\.(?=[ ]?[,\#]|[ ](?:Apt|Unit|Flat|Suite)))?{_PART}?",
    rf"(?<![\w])(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Camino|Paseo|Ronda|Carrera)[ ]?(?:de[ ](?:la[ ]|los[ ]|las[ ]|el[ ])?|del[ ])?(?:{_CAP}[ ]){{1,3}}?(?:n\.?º[ ]?)?\d{{1,4}}[a-z]?(?:,[ ](?:\d+\.?[ºª](?:[ ][A-Z]\b(?=[ ]?[^ ]|$)|[ ](?:izq|dcha)\w*\.?)?|bajo|ático|piso[ ]\d+|esc\.[ ]?\w+))?(?![\w])",
    rf"(?<![\w])(?:[{LETTER}]{{2,20}}(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm)|(?-i:Am|An[ ]der|Im|In[ ]der|Auf[ ]dem|Zum|Zur)[ ](?-i:[A-ZÄÖÜ][{LETTER}]+)(?:[ ](?-i:[A-ZÄÖÜ][{LETTER}]+))?|(?:(?<=,[ ])|(?<=von[ ])|(?<=\n))(?-i:am|an[ ]der|im)[ ](?-i:[a-zäöüß]+)(?:[ ](?-i:[a-zäöüß]+))?)[ ]\d{{1,4}}[ ]?[a-z]?(?![\w])(?:,[ ](?:\d+\.[ ]?(?:OG|Stock|Etage)|EG|DG|Whg\.?[ ]?\d+|Hinterhaus))?",
    rf"(?<![\w.,/:-])\d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|av\.|chemin|quai|bd|boulevard|place|allée|impasse|route|cours|square|passage)[ ](?:de[ ]la[ ]|de[ ]l['’]|des[ ]|du[ ]|de[ ]|d['’])?{_CAP}(?:[ ](?!et\b|a\b|où\b|est\b)[A-ZÀ-Ý]{_CAP[len(LETTER) + 2:]})?(?:,[ ](?:appt?\.?[ ]?\w+|apt\.?[ ]?\w+|bât\.?[ ]?\w+|\d+(?:er|e|ème)[ ]étage))?",
    rf"(?<![\w])(?:Rua|Av\.|Avenida|Largo|Travessa|Tv\.|Praça|Alameda|Estrada)[ ](?:da[ ]|do[ ]|das[ ]|dos[ ]|de[ ])?(?:{_CAP}[ ])?{_CAP},?[ ](?:n\.?º[ ]?)?\d{{1,4}}[A-Z]?(?![\w])(?:,[ ](?:\d+\.?º(?:[ ]?(?:Esq|Dto|Dir|Fte|[A-Z])\b\.?)?|apto?\.?[ ]?\w+|r/c(?:[ ](?:Esq|Dto)\.?)?|bloco[ ]\w+))?",
]
ADDRESS = [re.compile(p, re.I) for p in ADDRESSES]
ROADS = [
    (),
    ("calle", "c/", "avda", "avenida", "av.", "plaza", "pza.", "camino", "paseo", "ronda", "carrera"),
    ("straße ", "strasse ", "str. ", "gasse ", "weg ", "allee ", "platz ", "ufer ", "damm ", " am ", " an der ", " im ", " in der ", " auf dem ", " zum ", " zur "),
    (" rue ", " avenue ", " av. ", " chemin ", " quai ", " bd ", " boulevard ", " place ", " allée ", " impasse ", " route ", " cours ", " square ", " passage "),
    ("rua ", "av. ", "avenida ", "largo ", "travessa ", "tv. ", "praça ", "alameda ", "estrada "),
]

# Titles before names.
TITLE_WORDS = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "herr", "herrn", "frau", "sr", "sra", "srta", "dra", "don", "doña", "señor", "señora", "senhor", "senhora", "dona", "mme",
    "mlle", "m", "monsieur", "madame", "eng",
)
TITLES = frozenset(TITLE_WORDS)
TOKEN = re.compile(rf"[{LETTER}]+(?:-[{LETTER}]+)*")
#: Two words that both begin with a capital, the first perhaps with a point.
PAIR = re.compile(rf"(?<![{LETTER}-])([{CAPITAL}][{LETTER}-]*)(?: |\. )(?=([{CAPITAL}][{LETTER}-]*)(,? [{CAPITAL}])?)")
BEFORE_NAME = re.compile(rf"({WORD}) ({WORD})\.? (?=[{CAPITAL}])")
OPENS = re.compile(r"[\w,;:(] ?$")


def grams(token: str) -> list[str]:
    """Beginnings and endings of a word, by which surnames are told from other words."""
    t = token.lower()
    return [*(f"^{t[:k]}" for k in (3, 4) if len(t) > k), *(f"{t[-k:]}$" for k in (3, 4, 5) if len(t) > k)]


def word_counts(texts: list[str | None], opening: set[str]) -> tuple[Counter, Counter, Counter, Counter, Counter]:
    """(small, capital, seeds, pairs, inside) of the texts in mixed case: words in small letters and with a capital;
    pairs of one of ``opening`` (given names, titles) and a word with a capital before no other capital; pairs of words
    with capitals side by side, and those of them that don't open a sentence. Addresses of mail are left out, as names
    in them are in small letters."""
    tokens: Counter = Counter()
    stands: Counter = Counter()
    seeds: Counter = Counter()
    pairs: Counter = Counter()
    inside: Counter = Counter()
    for t in texts:
        if not t or t == t.lower() or t == t.upper():
            continue
        for a, b in reversed(email_candidates(t)):
            t = f"{t[:a]} {t[b:]}"
        tokens.update(TOKEN.findall(t))
        for m in PAIR.finditer(t):
            stands[m[1], m[2], t[m.end(1)], m[3] is None, OPENS.search(t[max(0, m.start() - 2) : m.start()]) is not None] += 1
    small: Counter = Counter()
    capital: Counter = Counter()
    for w, n in tokens.items():
        (capital if w[0].isupper() else small)[w.lower()] += n
    for (x, y, gap, last, within), n in stands.items():
        x, y = x.lower(), y.lower()
        if last and x in opening:
            seeds[x, y] += n
        if gap == " ":
            pairs[x, y] += n
            inside[x, y] += n * within
    return small, capital, seeds, pairs, inside


class Words:
    """What all documents tell of words: which are ordinary, which look like surnames, and which are given names."""

    def __init__(self, given: set[str]):
        self.listed = {g.lower() for g in given}
        self.surname: dict[str, float] = {}
        self.given: set[str] = set()
        self.common: set[str] = set()
        self.other: set[str] = set()
        self.known: set[str] = set()
        self.titled: set[str] = set()
        self.scores: dict[str, float] = {}
        self.kinds: dict[str, int] = {}

    @property
    def opening(self) -> set[str]:
        return self.listed | (TITLES - {"m"})

    def fit(self, small: dict[str, int], capital: dict[str, int], seeds: dict[str, tuple[int, int]]) -> Words:
        """Ordinary words and looks of surnames from counts of words; ``seeds`` are how often a word stands behind given
        names and titles, and behind how many different ones. Deterministic."""
        self.common = {w for w, n in small.items() if (n - 1) / (n + capital.get(w, 0) + 2) >= 0.12}
        size = max(len(self.opening), 1)
        # a surname goes with about as many given names as chance has it, the word of a place with one or two
        fixed = {w for w, (n, kinds) in seeds.items() if kinds < 0.2 * size * (1 - (1 - 1 / size) ** n)}
        good = {w: n for w, (n, _) in seeds.items() if w not in fixed and w not in self.common and w not in TITLES and w not in self.listed and len(w) >= 4}
        # a word that stands often, but hardly ever behind a given name or title, is that of a place or thing
        self.other = fixed | {w for w, n in capital.items() if (good.get(w, 0) + 2) / (n + 10) < 0.09}
        self.known = {w for w, n in good.items() if n and (n + 2) / (capital.get(w, 0) + 10) >= 0.12}
        own = {p for w in self.known for p in w.split("-") if len(p) >= 5 and p not in self.common}
        rest = {w for w in {*small, *capital} if w not in good and len(w) >= 4 and "-" not in w}
        yes: Counter = Counter()
        no: Counter = Counter()
        for w in own:
            yes.update(set(grams(w)))
        for w in rest:
            no.update(set(grams(w)))
        a, b = len(own) + 1.0, len(rest) + 1.0
        self.surname = {g: math.log((yes[g] + 0.3) / a / ((no[g] + 1.5) / b)) for g in yes if yes[g] >= 2}
        self.scores, self.kinds = {}, {}
        return self

    def speaks(self, x: str, y: str) -> int:
        """What a pair of words tells of the first: 1 if the second looks like a surname, -1 if it's a given name."""
        if x in self.common or x in TITLES or len(x) < 2:
            return 0
        return -1 if y in self.listed else int(self.score(y) > 2)

    def fit_given(self, follow: dict[str, tuple[int, int, int, int]]) -> Words:
        """Given names beside the listed ones: ``follow`` has how often a word stands before words that look like
        surnames, how often of these it doesn't open a sentence, before how many different ones, and how often it
        stands before a given name."""
        size = max(len(self.known), 1)
        self.given = {x for x, (n, inside, kinds, given) in follow.items() if n >= 2 and inside > 0.2 * n and given <= 0.1 * n and kinds >= 0.2 * size * (1 - (1 - 1 / size) ** n)}
        self.other -= self.given
        self.scores, self.kinds = {}, {}
        return self

    def fit_titled(self, texts: list[str]) -> Words:
        """Words behind which a title stands more often than a given name."""
        self.titled = {x for x, n in self.title_counts(texts).items() if n > 0}
        return self

    def title_counts(self, texts: list[str]) -> Counter:
        """Of words, how much more often a title stands behind them than a given name."""
        titled: Counter = Counter()
        for t in texts:
            for m in BEFORE_NAME.finditer(t):
                x = m[2].lower()
                n = (x in TITLES and x != "m") - (x in self.listed or x in self.given)
                if n:
                    titled[m[1].lower()] += n
        return titled

    def score(self, token: str) -> float:
        """Log likelihood ratio of a word being a surname; of a compound, that of its least part."""
        t = token.lower()
        s = self.scores.get(t)
        if s is None:
            s = min(self._part(p) for p in t.split("-"))
            if len(self.scores) < 300_000:
                self.scores[t] = s
        return s

    def _part(self, t: str) -> float:
        return -4.0 if len(t) < 5 or t in self.common or t in self.other else self.shape(t)

    def shape(self, t: str) -> float:
        """The same by the word's beginning and ending alone, whatever documents tell of the word itself."""
        return max(self.surname.get(f"^{t[:k]}", -1.5) for k in (3, 4)) + max(self.surname.get(f"{t[-k:]}$", -1.5) for k in (3, 4, 5))

    def kind(self, token: str) -> int:
        """1 if the word looks like a surname, 2 if a name may stand behind it, 3 if both, else 0."""
        k = self.kinds.get(token)
        if k is None:
            t = token.lower()
            k = (self.score(token) > 0) + 2 * (t in TITLES or t in self.listed)
            if len(self.kinds) < 500_000:
                self.kinds[token] = k
        return k

    def is_given(self, token: str, capital: bool) -> bool:
        t = token.lower()
        return t in self.listed or t in self.given or (capital and t not in self.common and t not in self.other and t not in TITLES and len(t) > 1 and self.score(t) < 2)


def _gap(text: str, a: int, b: int) -> str:
    return text[a:b].replace(" ", " ")


NAME_FEATURES = ("shape", "given", "initial", "inverted", "title", "next_other", "next_common", "next_capital", "lowered", "upper", "line", "mail", "end", "length", "parts", "prev_capital", "prev_score", "next_score")


def name_candidates(text: str, w: Words) -> list[tuple[int, int, list[float], str]]:
    """(start, end, features, surname) of spans that may be names: around words that look like surnames, after titles,
    after listed given names."""
    known = w.kinds
    toks = [(*m.span(), m[0]) for m in TOKEN.finditer(text)]
    kinds = [known[t] if t in known else w.kind(t) for _, _, t in toks]
    hot = [i for i, k in enumerate(kinds) if k]
    hot = sorted({i for i in hot if kinds[i] & 1} | {i + 1 for i in hot if kinds[i] & 2 and i + 1 < len(kinds)})
    if not hot:
        return []
    lowered = text == text.lower()
    out = []
    for i in hot:
        s, e, tok = toks[i]
        score = w.score(tok)
        capital = tok[0].isupper()
        prev = toks[i - 1] if i else None
        gap = _gap(text, prev[1], s) if prev else ""
        low = tok.lower()
        title = prev is not None and prev[2].lower() in TITLES and gap in (" ", ". ")
        after_given = prev is not None and gap == " " and prev[2].lower() in w.listed
        if not (score > 0 and (capital or lowered)) and not (capital and (title or after_given) and low not in w.common):
            continue
        start, end, given, initial, inverted = s, e, 0, 0, 0
        j = i - 1
        if prev and gap == ". " and len(prev[2]) == 1 and (prev[2].isupper() or lowered):
            before = toks[i - 2] if i > 1 else None
            # M. may be the French title, where titles rather than given names are usual
            is_title = prev[2].lower() == "m" and before is not None and before[2].lower() in w.titled and _gap(text, before[1], prev[0]) == " "
            if not is_title:
                start, initial, j = prev[0], 1, i - 2
        if j >= 0 and len(toks[j][2]) > 1:
            g = toks[j]
            cap = g[2][0].isupper() and not lowered
            # a word that opens a sentence is a given name only if it is known as one
            cap_only = cap and not initial and OPENS.search(text[max(0, g[0] - 2) : g[0]]) is not None
            if _gap(text, g[1], start) == " " and g[2].lower() not in TITLES and w.is_given(g[2], cap_only) and (cap or lowered):
                start, given = g[0], 1 + (g[2].lower() in w.listed)
        nxt = toks[i + 1] if i + 1 < len(toks) else None
        next_gap = _gap(text, e, nxt[0]) if nxt else ""
        if given == 1 and not initial and toks[j][2].lower() not in w.given and nxt and next_gap == ", " and (nxt[2].lower() in w.listed or nxt[2].lower() in w.given):
            start, given = s, 0  # a word that opens a sentence, before a name with the given name behind
        if not given and not initial and nxt and next_gap == ", " and (nxt[2][0].isupper() or lowered) and nxt[2].lower() not in TITLES:
            known = nxt[2].lower() in w.listed or nxt[2].lower() in w.given
            after = toks[i + 2] if i + 2 < len(toks) else None
            own = after is not None and w.score(after[2]) > 2 and _gap(text, nxt[1], after[0]) in (" ", ". ")
            if (known or (w.is_given(nxt[2], not lowered) and len(nxt[2]) > 2)) and not own and not text[nxt[1] : nxt[1] + 1].isdigit():
                end, given, inverted = nxt[1], 1 + known, 1
                m = re.match(r" [A-Z]\.(?!\w)", text[end:])
                if m:
                    end += m.end()
        nl = nxt[2].lower() if nxt else ""
        beside = next_gap == " "
        at = text[start - 1 : start]
        f = (
            min(map(w.shape, low.split("-"))), given, initial, inverted,
            title or (start != s and _title_before(text, start)),
            beside and nl in w.other, beside and nl in w.common, beside and nxt[2][0].isupper(), lowered, tok.isupper(),
            at in ("", "\n"), text[end : end + 1] in ("@", "_") or at in ("@", ".", "_", "+", "-"), text[end : end + 1] in ".,;:|(\n'’", end - start, tok.count("-"),
            prev is not None and gap == " " and prev[2][0].isupper(), w.score(prev[2]) if prev and gap == " " else -4.0, w.score(nl) if beside else -4.0,
        )
        out.append((start, end, [float(x) for x in f], low))
    return out


def _title_before(text: str, start: int) -> bool:
    m = re.search(rf"({WORD})\.? $", text[max(0, start - 12) : start].replace(" ", " "))
    return bool(m) and m[1].lower() in TITLES


def email_candidates(text: str) -> list[tuple[int, int]]:
    found = {}
    until = -1
    for m in AT_SIGNS.finditer(text):
        if m.start() < until:
            continue
        a = m.start()
        while a and not text[a - 1].isspace():
            a -= 1
        if a == m.start() and a:  # a blank before the sign
            a -= 1
            while a and not text[a - 1].isspace():
                a -= 1
        for x in EMAIL.finditer(text, a, min(len(text), m.end() + 300)):
            if x.start() > m.start():
                break  # another address, which may reach beyond this window
            if x.end() > m.start():
                found[x.span()] = None
                until = max(until, x.end())
    return list(found)


def number_candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, end, pattern) of spans that may be telephone and identity numbers; loose ones have the pattern after the last."""
    phones: dict[tuple[int, int], int] = {}
    identities: dict[tuple[int, int], int] = {}
    for m in DIGITS.finditer(text):
        a, b = m.span()
        if b - a < FEWEST_DIGITS:
            continue
        d = DATE.match(text, a)
        while d and d.end() <= b:  # dates, and times of day behind them
            a = d.end()
            while a < b and not text[a].isdigit():
                a += 1
            d = DATE.match(text, a)
        if sum(map(str.isdigit, text[a:b])) < FEWEST_DIGITS:
            continue
        a, b = max(0, a - 3), min(len(text), b + 3)
        for found, patterns, loose in ((phones, PHONE, PHONE_ANY), (identities, IDENTITY, IDENTITY_ANY)):
            for k, p in enumerate((*patterns, loose)):
                for x in p.finditer(text, a, b):
                    found.setdefault(x.span(), k)
    return [(s, e, k) for (s, e), k in phones.items()], [(s, e, k) for (s, e), k in identities.items()]


def address_candidates(text: str) -> list[tuple[int, int, int]]:
    low = f" {text.lower()}".replace("\n", " ")
    out = {}
    for k, (p, needs) in enumerate(zip(ADDRESS, ROADS)):
        if not needs or any(map(low.__contains__, needs)):
            for m in p.finditer(text):
                out.setdefault(m.span(), k)
    return [(s, e, k) for (s, e), k in out.items()]


_LEFT = re.compile(rf"[{LETTER}]+|\d+|[^\s ]|\n")


def surroundings(text: str, start: int, end: int, w: Words) -> tuple[str, str, str]:
    """The two tokens before a span and the one behind it; words that aren't ordinary as <w>, numbers as <9>."""

    def normal(t: str) -> str:
        return "<9>" if t[0].isdigit() else t if not t[0].isalpha() else t.lower() if t.lower() in w.common else "<w>"

    left = _LEFT.findall(text[max(0, start - 32) : start])[-2:]
    if left and left[-1].isalnum() and start >= 32 and len(left) == 1:
        left = left[-1:]
    right = _LEFT.search(text[end : end + 16])
    return normal(left[-2]) if len(left) > 1 else "", normal(left[-1]) if left else "", normal(right[0]) if right else ""
