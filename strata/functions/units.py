"""Numbers and unit expressions in text.

A unit is a factor, an offset and a vector of exponents over the base dimensions. Unit expressions are parsed by a
small grammar over tokens:

    unit   := scales? 'of'? term below*  |  term scale? below*  |  term ',' 'not scaled'
    below  := ('per' | '/') term  |  'per' word
    term   := ('square' | 'cubic')? name power?
    power  := '²' | '³' | '2' | '3' right after the name  |  '^' digit
    scales := 'thousand' | 'million' | ... | '(in millions)' | 'whole' | 'single units of'

Money is one dimension; its currency is kept, and the conversion to US dollars is left to the caller, who knows the year. What is counted ('per share') has
no dimension and is kept by name. A number whose unit begins but can't be read to its end, or that stands behind an unknown currency code, is found
without a unit: it is reported as unread and never booked as something else.

Symbols of SI units are told by their case (MJ, mJ) and built from prefixes by rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

DIMENSIONS = ("money", "length", "mass", "time", "temperature")
Vector = tuple[int, int, int, int, int]
_ZERO: Vector = (0, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    """canonical = (amount + offset) * factor, in SI base units (or in `currency`)."""

    factor: float = 1.0
    dims: Vector = _ZERO
    offset: float = 0.0
    currency: str | None = None
    #: the currency of money below the line ('per euro')
    below: str | None = None
    #: what is counted below the line ('per share')
    each: str | None = None

    def times(self, other: Unit, sign: int = 1) -> Unit:
        dims = tuple(a + sign * b for a, b in zip(self.dims, other.dims))
        above, below = (self.currency or other.currency, self.below) if sign > 0 else (self.currency, self.below or other.currency)
        return Unit(self.factor * other.factor**sign, dims, 0.0, above, below, self.each)

    def power(self, n: int) -> Unit:
        return Unit(self.factor**n, tuple(d * n for d in self.dims), 0.0, self.currency, self.below, self.each)

    def scaled(self, by: float) -> Unit:
        return Unit(self.factor * by, self.dims, self.offset / by if by else 0.0, self.currency, self.below, self.each)


def _dim(**exponents: int) -> Vector:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


MONEY, LENGTH, MASS, TIME, TEMPERATURE = (_dim(**{d: 1}) for d in DIMENSIONS)
AREA, VOLUME, ENERGY, POWER = _dim(length=2), _dim(length=3), _dim(mass=1, length=2, time=-2), _dim(mass=1, length=2, time=-3)
#: The canonical unit of each kind of quantity.
KINDS: dict[Vector, tuple[str, str]] = {
    MONEY: ("money", "USD"), LENGTH: ("length", "m"), AREA: ("area", "m2"), VOLUME: ("volume", "m3"), MASS: ("mass", "kg"),
    TIME: ("time", "s"), TEMPERATURE: ("temperature", "K"), ENERGY: ("energy", "J"), POWER: ("power", "W"),
}
_BASE = ("USD", "m", "kg", "s", "K")


def kind_and_unit(unit: Unit) -> tuple[str, str]:
    """The name and canonical unit of a kind of quantity; beyond KINDS spelled from the exponents: ('length/time', 'm/s')."""

    def spelled(names: tuple[str, ...], one: str) -> str:
        above = ["*".join(f"{n}{abs(d) if abs(d) > 1 else ''}" for n, d in zip(names, unit.dims) if d * sign > 0) for sign in (1, -1)]
        return (above[0] or "1") + (f"/{above[1]}" if above[1] else "") if any(unit.dims) else one

    kind, name = KINDS.get(unit.dims) or (spelled(DIMENSIONS, "ratio"), spelled(_BASE, "1"))
    return (f"{kind}/{unit.each}", f"{name}/{unit.each}") if unit.each else (kind, name)


SCALES = {
    "hundred": 1e2, "hundreds": 1e2, "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "'000s": 1e3, "000": 1e3, "000s": 1e3, "k": 1e3,
    "million": 1e6, "millions": 1e6, "m": 1e6, "mm": 1e6, "mn": 1e6, "mil": 1e6, "mio": 1e6, "mln": 1e6,
    "billion": 1e9, "billions": 1e9, "b": 1e9, "bn": 1e9, "bln": 1e9, "trillion": 1e12, "trillions": 1e12, "t": 1e12, "tn": 1e12,
}
_LETTERS = {"k", "m", "mm", "mn", "mil", "mio", "mln", "b", "bn", "bln", "t", "tn", "'000", "'000s", "000", "000s"}  # only right after a currency or number

CURRENCIES = {
    "usd": "USD", "us$": "USD", "u.s.$": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "us dollar": "USD", "us dollars": "USD", "u.s. dollar": "USD", "u.s. dollars": "USD",
    "eur": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR",
    "gbp": "GBP", "£": "GBP", "pound sterling": "GBP", "pounds sterling": "GBP", "british pound": "GBP", "british pounds": "GBP", "sterling": "GBP",
    "jpy": "JPY", "¥": "JPY", "yen": "JPY", "japanese yen": "JPY",
    "cad": "CAD", "c$": "CAD", "ca$": "CAD", "cdn$": "CAD", "canadian dollar": "CAD", "canadian dollars": "CAD",
    "chf": "CHF", "franc": "CHF", "francs": "CHF", "swiss franc": "CHF", "swiss francs": "CHF",
    "aud": "AUD", "a$": "AUD", "au$": "AUD", "australian dollar": "AUD", "australian dollars": "AUD", "nzd": "NZD", "nz$": "NZD", "new zealand dollar": "NZD", "new zealand dollars": "NZD",
    "cny": "CNY", "rmb": "CNY", "yuan": "CNY", "renminbi": "CNY", "inr": "INR", "₹": "INR", "rupee": "INR", "rupees": "INR", "krw": "KRW", "₩": "KRW", "brl": "BRL", "r$": "BRL",
    "sek": "SEK", "kronor": "SEK", "nok": "NOK", "dkk": "DKK", "mxn": "MXN", "zar": "ZAR", "pln": "PLN", "zloty": "PLN", "czk": "CZK", "huf": "HUF", "ils": "ILS",
    "sgd": "SGD", "s$": "SGD", "singapore dollar": "SGD", "singapore dollars": "SGD", "hkd": "HKD", "hk$": "HKD", "hong kong dollar": "HKD", "hong kong dollars": "HKD",
}

_KWH = 3.6e6
NAMES: dict[str, Unit] = {
    **{n: Unit(1.0, LENGTH) for n in ("m", "metre", "metres", "meter", "meters")},
    **{n: Unit(1000.0, LENGTH) for n in ("km", "kilometre", "kilometres", "kilometer", "kilometers")},
    **{n: Unit(0.01, LENGTH) for n in ("cm", "centimetre", "centimetres", "centimeter", "centimeters")},
    **{n: Unit(1609.344, LENGTH) for n in ("mile", "miles", "mi")},
    **{n: Unit(0.9144, LENGTH) for n in ("yard", "yards", "yd")},
    **{n: Unit(0.3048, LENGTH) for n in ("foot", "feet", "ft")},
    **{n: Unit(0.0254, LENGTH) for n in ("inch", "inches")},
    **{n: Unit(1e4, AREA) for n in ("ha", "hectare", "hectares")},
    **{n: Unit(4046.8564224, AREA) for n in ("acre", "acres")},
    **{n: Unit(1e-3, VOLUME) for n in ("litre", "litres", "liter", "liters")},
    **{n: Unit(3.785411784e-3, VOLUME) for n in ("gallon", "gallons", "gal")},
    **{n: Unit(0.158987294928, VOLUME) for n in ("barrel", "barrels", "bbl")},
    **{n: Unit(1.0, MASS) for n in ("kg", "kilogram", "kilograms")},
    **{n: Unit(1e-3, MASS) for n in ("gram", "grams")},
    **{n: Unit(1000.0, MASS) for n in ("tonne", "tonnes", "metric ton", "metric tons")},
    **{n: Unit(907.18474, MASS) for n in ("short ton", "short tons", "ton", "tons")},
    **{n: Unit(1016.0469088, MASS) for n in ("long ton", "long tons")},
    **{n: Unit(0.45359237, MASS) for n in ("pound", "pounds", "lb", "lbs")},
    **{n: Unit(0.028349523125, MASS) for n in ("ounce", "ounces")},
    **{n: Unit(_KWH, ENERGY) for n in ("kwh", "kilowatt-hour", "kilowatt-hours")},
    **{n: Unit(_KWH * 1e3, ENERGY) for n in ("mwh", "megawatt-hour", "megawatt-hours")},
    **{n: Unit(_KWH * 1e6, ENERGY) for n in ("gwh", "gigawatt-hour", "gigawatt-hours")},
    **{n: Unit(_KWH * 1e9, ENERGY) for n in ("twh", "terawatt-hour", "terawatt-hours")},
    **{n: Unit(1055.05585262, ENERGY) for n in ("btu",)},
    **{n: Unit(1e3, POWER) for n in ("kw", "kilowatt", "kilowatts")},
    **{n: Unit(1e6, POWER) for n in ("mw", "megawatt", "megawatts")},
    **{n: Unit(1e9, POWER) for n in ("gw", "gigawatt", "gigawatts")},
    **{n: Unit(1.0, TIME) for n in ("second", "seconds", "sec")},
    **{n: Unit(60.0, TIME) for n in ("minute", "minutes")},
    **{n: Unit(3600.0, TIME) for n in ("hour", "hours", "hr", "hrs")},
    **{n: Unit(86400.0, TIME) for n in ("day", "days")},
    **{n: Unit(7 * 86400.0, TIME) for n in ("week", "weeks")},
    **{n: Unit(365.25 * 86400.0 / 12, TIME) for n in ("month", "months")},
    **{n: Unit(365.25 * 86400.0, TIME) for n in ("year", "years", "annum")},
    **{n: Unit(1.0, TEMPERATURE, 273.15) for n in ("°c", "degrees celsius")},
    **{n: Unit(5 / 9, TEMPERATURE, 459.67) for n in ("°f", "degrees fahrenheit")},
}
#: symbols as they are written: every prefix with every base symbol
_SI = {"": 1.0, "n": 1e-9, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
_FORCE, _PRESSURE, _FREQUENCY = _dim(mass=1, length=1, time=-2), _dim(mass=1, length=-1, time=-2), _dim(time=-1)
_BASES = {
    "m": Unit(1.0, LENGTH), "g": Unit(1e-3, MASS), "s": Unit(1.0, TIME), "J": Unit(1.0, ENERGY), "W": Unit(1.0, POWER), "Wh": Unit(3600.0, ENERGY), "L": Unit(1e-3, VOLUME), "l": Unit(1e-3, VOLUME),
    "N": Unit(1.0, _FORCE), "Pa": Unit(1.0, _PRESSURE), "Hz": Unit(1.0, _FREQUENCY),
}
SYMBOLS: dict[str, Unit] = {"h": Unit(3600.0, TIME), "min": Unit(60.0, TIME), "t": Unit(1000.0, MASS), **{p + n: u.scaled(f) for p, f in _SI.items() for n, u in _BASES.items()}}
_ALONE = {"s", "l", "n", "t"}
_POWERS = {"square": 2, "sq": 2, "cubic": 3, "cu": 3}
_DIGIT_POWERS = {"²": 2, "³": 3, "2": 2, "3": 3}
_TOKEN = re.compile(r"us\$|u\.s\.\$|ca\$|cdn\$|au\$|nz\$|hk\$|[acsr]\$|[€£¥$₹₩]|u\.s\.|'000s?|\b000s?\b|°[cf]|[²³]|kilowatt-hours?|megawatt-hours?|gigawatt-hours?|terawatt-hours?|[a-zµμ]+|[(),/]|\S", re.IGNORECASE)
Token = tuple[str, int, int, str]


class _Tokens:
    """Tokens (lower case, start, end, as written) of a stretch of text, read only as far as they are asked for."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        self.start, self._read = start, []
        self._more = _TOKEN.finditer(text, start, len(text) if end is None else end)

    def get(self, i: int) -> Token | None:
        while len(self._read) <= i:
            m = next(self._more, None)
            if m is None:
                return None
            self._read.append((m.group().lower().replace("’", "'").replace("‘", "'"), m.start(), m.end(), m.group()))
        return self._read[i] if i >= 0 else None

    def all(self) -> list[Token]:
        while self.get(len(self._read)) is not None:
            pass
        return self._read


class Unread(Exception):
    """A unit begins here but can't be read to its end."""


class _Parser:
    def __init__(self, tokens: _Tokens, at: int, after_number: bool):
        self.tokens, self.at, self.after_number = tokens, at, after_number

    def peek(self, k: int = 0) -> str:
        t = self.tokens.get(self.at + k)
        return t[0] if t else ""

    def dots(self) -> None:
        if self.peek() == ".":
            self.at += 1

    def end(self) -> int:
        """Where the last token read ends."""
        return self.tokens.get(self.at - 1)[2] if self.at else self.tokens.start

    def touches(self, k: int = 0) -> bool:
        """Whether token k follows the one before it without a blank."""
        t, before = self.tokens.get(self.at + k), self.tokens.get(self.at + k - 1)
        return t is not None and t[1] == (before[2] if before else self.tokens.start)

    def power(self, k: int = 0) -> tuple[int, int]:
        """(power, tokens read) of an exponent at token k; (1, 0) where there is none."""
        word = self.peek(k)
        if word in _DIGIT_POWERS and self.touches(k) and not (self.touches(k + 1) and (self.peek(k + 1).isdigit() or (self.peek(k + 1) in ".," and self.touches(k + 2) and self.peek(k + 2).isdigit()))):
            return _DIGIT_POWERS[word], 1
        if word == "^" and self.peek(k + 1).isdigit():
            return int(self.peek(k + 1)), 2
        return 1, 0

    def currency(self) -> Unit | None:
        for n in (3, 2, 1):
            name = " ".join(self.peek(k) for k in range(n))
            # a currency right before a number belongs to that number
            if name in CURRENCIES and not (self.after_number and self.peek(n).isdigit()):
                self.at += n
                return Unit(1.0, MONEY, 0.0, CURRENCIES[name])
        return None

    def scale(self, tight: bool) -> float | None:
        """A scale word; letters and '000 only where `tight`."""
        word = self.peek()
        if word in _LETTERS and (word in NAMES or word in SYMBOLS) and (self.power(1)[1] or self.peek(1) == "/"):
            return None  # 'm2', 't/ha'
        if word in SCALES and (tight or word not in _LETTERS):
            self.at += 1
            if word in ("mil", "mio", "mln"):
                self.dots()
            return SCALES[word]
        if word == "(" and self.peek(1) == "in" and self.peek(2) in SCALES and self.peek(3) == ")":
            self.at += 4
            return SCALES[self.peek(-2)]
        return None

    def term(self) -> Unit | None:
        money = self.currency()
        if money:
            return money
        start, power = self.at, 1
        if self.peek() in _POWERS:
            power = _POWERS[self.peek()]
            self.at += 1
            self.dots()
        for n in (2, 1):
            name = " ".join(self.peek(k) for k in range(n))
            unit = SYMBOLS.get(self.tokens.get(self.at)[3]) if n == 1 and self.tokens.get(self.at) else None
            unit = unit or NAMES.get(name)
            if unit is not None:
                self.at += n
                if name in ("ft", "mi", "yd", "gal", "lb", "lbs", "bbl") and self.peek() == ".":
                    self.dots()
                raised, read = self.power()
                self.at += read
                power = raised if read else power
                return unit.power(power) if power > 1 else unit
        self.at = start
        return None

    def unit(self) -> Unit | None:
        """The unit expression at this place; None where there is none. self.at ends after it."""
        factor, scaled = 1.0, False
        if self.peek() == "whole":
            self.at += 1
            scaled = True
        elif self.peek() == "single" and self.peek(1) == "units":
            self.at += 2
            scaled = True
        else:
            while (s := self.scale(tight=self.after_number and not scaled)) is not None:
                factor, scaled = factor * s, True
        mark = self.at
        if scaled and self.peek() == "of":
            self.at += 1
        term = self.term()
        if term is None:
            self.at = mark
            # a bare scale is a number of US dollars; a letter may also be a unit's name
            return Unit(factor, MONEY, 0.0, "USD") if scaled else None
        if term.currency and not scaled:
            while (s := self.scale(tight=True)) is not None:
                factor, scaled = factor * s, True
        if self.peek() == "," and self.peek(1) == "not" and self.peek(2) == "scaled":
            self.at += 3
        return self.quotient(term).scaled(factor)

    def quotient(self, unit: Unit) -> Unit:
        """The unit over what follows as 'per term', '/ term' or 'per word'."""
        while self.peek() in ("per", "/") and self.peek(1):
            by = self.peek()
            mark = self.at
            self.at += 1
            below = self.term()
            if below is not None and not (below.currency and unit.below):
                unit = unit.times(below, -1)
            elif by == "per" and self.peek().isalpha() and unit.each is None:
                self.at += 1
                unit = replace(unit, each=self.peek(-1))
            elif by == "/" and not (self.touches() and self.touches(-1)):
                self.at = mark  # a slash between blanks parts phrases
                break
            else:
                raise Unread
        return unit


def parse_unit(text: str, start: int = 0, end: int | None = None) -> tuple[Unit, int] | None:
    """(unit, where it ends) of the unit expression that begins at `start`, right after a number."""
    tokens = _Tokens(text, start, end)
    first = tokens.get(0)
    if first is None or text[start : first[1]].strip(" \t\u00a0\u202f-"):
        return None
    p = _Parser(tokens, 0, True)
    unit = p.unit()
    return (unit, p.end()) if unit is not None and p.at else None


def find_money_unit(text: str) -> Unit | None:
    """The first money unit named in a phrase (a bare scale after 'in' counts as US dollars), outside single amounts."""
    lazy = _Tokens(text)
    tokens = lazy.all()
    for i, (word, *_) in enumerate(tokens):
        p = _Parser(lazy, i, False)
        try:
            unit = p.unit()
        except Unread:
            continue
        if unit is None or unit.dims != MONEY:
            continue
        named = any(t[0] in CURRENCIES or " ".join(x[0] for x in tokens[j : j + 2]) in CURRENCIES for j, t in enumerate(tokens[i : p.at], i))
        before = tokens[i - 1][0] if i else ""
        following = p.peek()
        if before.isdigit() or (following.isdigit() and following not in SCALES):
            continue  # a single amount
        if named or (word in SCALES and before in ("in", ":", "[", "(")):
            return unit
    return None


_CODES = "|".join(sorted(re.escape(n) for n in CURRENCIES if re.fullmatch("[a-z]{3}", n) and n.upper() in CURRENCIES.values()))
_PREFIX = rf"(?P<cur>(?:US|U\.S\.|CA|CDN|AU|NZ|HK)\$|(?<![A-Za-z])[ACSR]\$|[€£¥$₹₩]|\b(?:{_CODES})\b)"
#: plain, with commas or no-break blanks between thousands, or with points between thousands and a decimal comma
_NUMBER = r"\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}(?![\d.])|\d{1,3}(?:[,\u00a0\u202f]\d{3})+(?:\.\d+)?|\d+,\d{1,2}(?![\d,])|\d+(?:\.\d+)?"
_AMOUNT = re.compile(rf"(?P<neg>\(|(?<![\w.)%°])-)?(?:{_PREFIX}\s?)?(?<![\d.,A-Za-z])(?P<num>{_NUMBER})(?!\d)", re.IGNORECASE)
_UNKNOWN_CODE = re.compile(r"(?<![A-Za-z])[A-Z]{3}\s?$")
_COMMA = re.compile(r"\d+(?:\.\d{3})*,\d{1,2}|\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}")


def read_number(digits: str) -> float:
    """1,234.5, 1.234,5, 466,7 or 1234.5."""
    if _COMMA.fullmatch(digits):
        digits = digits.replace(".", "").replace(",", ".")
    return float(re.sub("[,\u00a0\u202f]", "", digits))


@dataclass(frozen=True)
class Quantity:
    """unit is None where the amount was found but can't be read; status says why."""

    start: int
    raw: str
    amount: float
    unit: Unit | None
    status: str = "ok"

    @property
    def kind(self) -> str | None:
        return self.unit and kind_and_unit(self.unit)[0]

    def canonical(self) -> float | None:
        """In SI base units, or in the currency."""
        return self.unit and (self.amount + self.unit.offset) * self.unit.factor


def find_quantities(text: str) -> list[Quantity]:
    """All amounts of money and physical quantities of a text, in order. Bare numbers are none."""
    out: list[Quantity] = []
    read_to = 0
    for m in _AMOUNT.finditer(text):
        # a currency read as the unit of the number before isn't read again
        currency = m.group("cur") if m.start("cur") >= read_to else None
        amount, end, status = read_number(m.group("num")), m.end("num"), "ok"
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        unit: Unit | None
        try:
            if currency:
                unit = Unit(1.0, MONEY, 0.0, CURRENCIES[currency.lower()])
                p = _Parser(_Tokens(text, end, stop), 0, True)
                first = p.tokens.get(0)
                if first and not text[end : first[1]].strip(" \u00a0\u202f"):
                    if (s := p.scale(tight=True)) is not None:
                        unit = unit.scaled(s)
                    unit = p.quotient(unit)
                    end = p.end()
            else:
                got = parse_unit(text, end, stop)
                if got is None:
                    continue
                unit, after = got
                word = text[end:after].strip().lower()
                if word in _ALONE or (word in SYMBOLS and len(word) == 1 and text[end : end + 1] == word):
                    continue  # "1990s", "5g", "3 t": a single letter is no unit by itself
                if unit.currency and (word in _LETTERS or text[after : after + 1].isalpha()):
                    continue  # a letter after a bare number ("10-K", "2024 B...") is no scale
                if unit.currency == "USD" and word in SCALES and _UNKNOWN_CODE.search(text, max(0, m.start() - 5), m.start()) and any(c.islower() for c in text[max(0, m.start() - 40) : m.start()]):
                    unit, status = None, "unknown currency"
                end = after
        except Unread:
            unit, status = None, "unread unit"
        money = unit is not None and unit.dims == MONEY
        bracketed = m.group("neg") == "(" and text[end : end + 1] == ")" and money
        # in '5 million euros ($6 million)' the brackets hold a conversion
        converted = bracketed and out and out[-1].unit != unit and not text[read_to : m.start()].strip(" ")
        negative = m.group("neg") == "-" or (bracketed and not converted)
        start = m.start("cur") if currency else m.start("num")
        out.append(Quantity(start, text[start:end], -amount if negative else amount, unit, status))
        read_to = end
    return out


_PER_SHARE = re.compile(r"[,;(]?\s*(?:except|other than|excluding|apart from)?\s*(?:for\s+)?per[- ]share\s+(?:data|amounts|figures)(?:\s+left out)?", re.IGNORECASE)
_STATEMENT_SIDE = re.compile(r"\b(?:statements?|stmt|lines?|columns?|printed)\b", re.IGNORECASE)
_VALUE_SIDE = re.compile(r"\b(?:values?|getter|tagged|extracted|taken over|reported)\b", re.IGNORECASE)


@lru_cache(maxsize=100_000)
def note_units(note: str | None) -> tuple[Unit | None, Unit | None]:
    """(unit of the value, unit of the statement value) as far as a free-text note gives them."""
    value = statement = None
    for part in re.split(r"[;\n]|(?<![A-Z])\.\s", _PER_SHARE.sub("", note or "")):
        if re.search(r"\bshares?\b", part, re.IGNORECASE):
            continue
        unit = find_money_unit(part)
        if unit is None:
            continue
        if _STATEMENT_SIDE.search(part):
            statement = statement or unit
        elif _VALUE_SIDE.search(part):
            value = value or unit
    return value, statement


#: A line speaks of the statements as a whole.
STATEMENT_LINE = r"(?i)\b(statements?|balance sheets?)\b"


@lru_cache(maxsize=100_000)
def statement_line_unit(line: str) -> Unit | None:
    """The unit that a line states for the statements as a whole, if it does."""
    plain = _PER_SHARE.sub("", line)
    if re.search(r"\bshare counts?\b|\bnumbers? of shares\b", plain, re.IGNORECASE) or not re.search(STATEMENT_LINE[4:], plain, re.IGNORECASE):
        return None
    return find_money_unit(plain)
