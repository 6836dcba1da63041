"""Unit aliases in texts: an automaton over all aliases, longest match, ambiguity resolved by the quantity measured."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import ahocorasick

# Spellings of each unit code of the reference table.
ALIASES = {
    "degC": ["°C", "degC", "deg C", "C", "Celsius", "degrees Celsius"],
    "degF": ["°F", "degF", "deg F", "F", "Fahrenheit", "degrees Fahrenheit"],
    "kelvin": ["K", "°K", "Kelvin"],
    "percent": ["%", "percent", "pct", "% RH"],
    "fraction": ["fraction", "frac", "ratio", "0-1", "share of 1"],
    "hPa": ["hPa", "hectopascal", "hectopascals", "mbar", "mb", "millibar", "millibars"],
    "kPa": ["kPa", "kilopascal", "kilopascals"],
    "Pa": ["Pa", "pascal", "pascals"],
    "inHg": ["inHg", "in Hg", '"Hg', "inches of mercury"],
    "mmHg": ["mmHg", "mm Hg", "torr", "millimetres of mercury"],
    "m_s": ["m/s", "m s-1", "m·s-1", "mps", "metres per second", "meters per second"],
    "km_h": ["km/h", "kmh", "kph", "km h-1", "kilometres per hour", "kilometers per hour"],
    "mph": ["mph", "mi/h", "miles per hour"],
    "knot": ["kn", "kt", "kts", "knot", "knots"],
    "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters", "l/m2"],
    "inch": ["in", "in.", "inch", "inches"],
    "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters"],
    "ug_m3": ["ug/m3", "mcg/m3", "micrograms per cubic metre", "micrograms per m3", "micrograms/m3"],
    "mg_m3": ["mg/m3", "milligrams per cubic metre", "milligrams per m3", "milligrams/m3"],
    "ng_m3": ["ng/m3", "nanograms per cubic metre", "nanograms per m3", "nanograms/m3"],
    "ppb": ["ppb", "parts per billion"],
    "ppm": ["ppm", "parts per million"],
    "metre": ["m", "metre", "metres", "meter", "meters", "mtr"],
    "foot": ["ft", "ft.", "foot", "feet"],
    "m3_s": ["m3/s", "cumecs", "cms", "cubic metres per second", "cubic meters per second"],
    "cfs": ["cfs", "ft3/s", "cu ft/s", "cubic feet per second"],
    "l_s": ["l/s", "litres per second", "liters per second"],
    "ng_l": ["ng/l", "nanograms per litre", "nanograms per liter"],
    "ug_l": ["ug/l", "mcg/l", "micrograms per litre", "micrograms per liter"],
}
# The common unit's value is value * factor + offset.
CONVERSIONS = {
    ("air_temperature", "degC"): (1.0, 0.0), ("air_temperature", "degF"): (5 / 9, -160 / 9), ("air_temperature", "kelvin"): (1.0, -273.15),
    ("relative_humidity", "percent"): (1.0, 0.0), ("relative_humidity", "fraction"): (100.0, 0.0),
    ("air_pressure", "hPa"): (1.0, 0.0), ("air_pressure", "kPa"): (10.0, 0.0), ("air_pressure", "Pa"): (0.01, 0.0), ("air_pressure", "inHg"): (33.8638866667, 0.0), ("air_pressure", "mmHg"): (1.33322387415, 0.0),
    ("wind_speed", "m_s"): (1.0, 0.0), ("wind_speed", "km_h"): (1 / 3.6, 0.0), ("wind_speed", "mph"): (0.44704, 0.0), ("wind_speed", "knot"): (1.852 / 3.6, 0.0),
    ("precipitation", "mm"): (1.0, 0.0), ("precipitation", "inch"): (25.4, 0.0), ("precipitation", "cm"): (10.0, 0.0),
    ("pm2_5", "ug_m3"): (1.0, 0.0), ("pm2_5", "mg_m3"): (1000.0, 0.0), ("pm2_5", "ng_m3"): (0.001, 0.0),
    ("nitrogen_dioxide", "ppb"): (1.0, 0.0), ("nitrogen_dioxide", "ppm"): (1000.0, 0.0),
    ("water_level", "metre"): (1.0, 0.0), ("water_level", "foot"): (0.3048, 0.0), ("water_level", "cm"): (0.01, 0.0),
    ("streamflow", "m3_s"): (1.0, 0.0), ("streamflow", "cfs"): (0.028316846592, 0.0), ("streamflow", "l_s"): (0.001, 0.0),
    ("pfos", "ng_l"): (1.0, 0.0), ("pfos", "ug_l"): (1000.0, 0.0),
}
NUMBER = re.compile(r"[-+−]?(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
THOUSANDS = re.compile(r"\d{1,3}(?:,\d{3})+")
CONNECTIVE = re.compile(r"^[\s,;:]*(?:(?:values?|units?|given|measured|recorded|expressed|reported)\s+)?(?:in|en)\s+(?=\S)", re.I)
STATED = re.compile(r"(?:values?|units?|given|measured|recorded|expressed|reported)\s+(?:are\s+)?in\s+(.+)$|[\[(]([^\])]+)[\])]\s*$", re.I)


def normal(text: str) -> str:
    """Compatibility form, lower case, single blanks; micro signs as u, minus signs as -."""
    t = unicodedata.normalize("NFKC", text).lower().replace("μ", "u").replace("−", "-").replace("‐", "-")
    return " ".join(t.split())


def squeezed(text: str) -> str:
    return "".join(c for c in normal(text) if c.isalnum())


class UnitFinder:
    """Finds the unit code of a quantity in a text. ``units``: (quantity, unit_code) pairs that exist."""

    def __init__(self, units: list[tuple[str, str]]):
        self.by_alias: dict[str, dict[str, str]] = {}
        self.by_squeezed: dict[tuple[str, str], str] = {}
        for quantity, code in units:
            for alias in [*ALIASES.get(code, []), code]:
                self.by_alias.setdefault(normal(alias), {})[quantity] = code
                if squeezed(alias):
                    self.by_squeezed.setdefault((quantity, squeezed(alias)), code)
        self.automaton = ahocorasick.Automaton()
        for alias, codes in self.by_alias.items():
            self.automaton.add_word(alias, (alias, codes))
        if self.by_alias:
            self.automaton.make_automaton()
        self.find = lru_cache(200_000)(self._find)

    def _find(self, text: str, quantity: str) -> str | None:
        """The longest alias of the quantity in the text that stands by itself, the first of equally long ones."""
        t = normal(text)
        exact = self.by_alias.get(t, {}).get(quantity)
        if exact or not t or not self.by_alias:
            return exact
        best, where = "", 0
        for end, (alias, codes) in self.automaton.iter(t):
            start = end - len(alias) + 1
            if quantity not in codes or (alias[0].isalnum() and start and t[start - 1].isalpha()) or (alias[-1].isalnum() and end + 1 < len(t) and t[end + 1].isalnum()):
                continue
            if len(alias) > len(best) or (len(alias) == len(best) and start < where):
                best, where = alias, start
        return self.by_alias[best][quantity] if best else None


def read_number(text: str | None) -> tuple[float | None, str]:
    """The first number of a text, and the text around it. Commas are thousands separators if a point follows or all
    groups have three digits, else a decimal comma. Non-finite numbers are none."""
    if not text:
        return None, ""
    m = NUMBER.search(text)
    if not m:
        return None, text
    digits = m[0].replace("−", "-")
    if "," in digits:
        body = digits.lstrip("+-")
        digits = digits.replace(",", "") if "." in digits or THOUSANDS.fullmatch(body.rstrip(",")) or digits.count(",") > 1 else digits.replace(",", ".")
    try:
        value = float(digits.rstrip("."))
    except ValueError:
        return None, text
    return (value, text[: m.start()] + " " + text[m.end() :]) if math.isfinite(value) else (None, text)


class ContextReader:
    """Reads an observation's quantity, number and stated unit. ``labels``: normal base label to quantity."""

    def __init__(self, units: list[tuple[str, str]], labels: dict[str, str]):
        self.finder = UnitFinder(units)
        self.labels = {normal(k): v for k, v in labels.items()}
        self.slugs = sorted(((re.sub(r"[^a-z0-9]+", "_", normal(k)).strip("_"), v) for k, v in labels.items()), key=lambda x: -len(x[0]))
        self.automaton = ahocorasick.Automaton()
        for label in self.labels:
            if label:
                self.automaton.add_word(label, label)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.metric = lru_cache(100_000)(self._metric)
        self.field = lru_cache(100_000)(self._field)
        self.label = lru_cache(100_000)(self._label)

    def _metric(self, metric: str) -> tuple[str | None, str | None]:
        """Quantity and unit of a metric text: the longest base label it begins with (or holds), the unit in the rest."""
        t = normal(metric)
        best: tuple[bool, int, int, str] | None = None
        for end, label in self.automaton.iter(t) if len(self.automaton) else ():
            at = end - len(label) + 1
            if (end + 1 < len(t) and t[end + 1].isalnum()) or (at and t[at - 1].isalnum()):
                continue
            # one that the text begins with goes before others, then the longest, then the first
            rank = (at == 0, len(label), -at, label)
            best = max(best, rank) if best else rank
        if best is None:
            return None, None
        quantity = self.labels[best[3]]
        return quantity, self.finder.find(CONNECTIVE.sub("", t[-best[2] + best[1] :]), quantity)

    def _field(self, field: str, quantity: str) -> str | None:
        """Unit in what a field name has after a base label of the quantity."""
        t = re.sub(r"[^a-z0-9]+", "_", normal(field)).strip("_")
        for slug, q in self.slugs:
            if q == quantity and t.startswith(slug + "_"):
                code = self.finder.by_squeezed.get((quantity, t[len(slug) :].replace("_", "")))
                if code:
                    return code
        return None

    def _label(self, label: str, quantity: str) -> str | None:
        m = STATED.search(label)
        return self.finder.find(m[1] or m[2], quantity) if m else None

    def read(self, metric: str | None, value: str | None, unit: str | None, field: str | None, label: str | None) -> tuple[str | None, float | None, str | None, str | None]:
        """(quantity, number, unit code, where it is stated): beside the number, else in unit, metric, field or label."""
        quantity, in_metric = self.metric(metric) if metric else (None, None)
        number, rest = read_number(value)
        if quantity is None or number is None:
            return quantity, number, None, None
        if rest.strip() and (code := self.finder.find(rest, quantity)):
            return quantity, number, code, "value"
        if unit and (code := self.finder.find(unit, quantity)):
            return quantity, number, code, "unit"
        if in_metric:
            return quantity, number, in_metric, "metric"
        if field and (code := self.field(field, quantity)):
            return quantity, number, code, "source_field"
        if label and (code := self.label(label, quantity)):
            return quantity, number, code, "record_label"
        return quantity, number, None, None
