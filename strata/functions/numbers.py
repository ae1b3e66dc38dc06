"""Numbers in answers and how retrieved evidence supports them, as array expressions (one row per answer, no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a number in an answer, and the scale words
NUMBER = r"(?i)(\(|-)?\$?\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+)\)?\s*(billion|bn|b\b|million|mm|m\b|thousand|k\b|trillion|tn|t\b)?(\s*%|\s*percent)?"
_SCALE = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "t": 1e12}


def _scale(word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in _SCALE.items() for x in pair]), word), F.lit(1.0))


def extract_numbers(text: Column) -> Column:
    """array<struct<raw, value, candidates, is_pct, is_year>> in order of appearance; empty for null.

    candidates: the scaled and the plain reading where a scale word is there, else one.
    """

    def one(raw: Column) -> Column:
        # the match holds nothing but sign, digits, scale word and percent sign, so its parts are told by simple means
        low = F.lower(F.trim(raw))
        digits = F.regexp_extract(raw, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)
        year = digits.rlike(r"^(19|20)\d\d$")
        plain = F.replace(digits, F.lit(","), F.lit("")).cast("double") * F.when(F.substring(raw, 1, 1).isin("(", "-"), F.lit(-1.0)).otherwise(F.lit(1.0))
        by = F.when(year, F.lit(1.0)).otherwise(_scale(F.regexp_extract(low, "[a-z]+", 0)))
        return F.struct(
            F.trim(raw).alias("raw"), (plain * by).alias("value"), F.when(by == 1.0, F.array(plain)).otherwise(F.array(plain * by, plain)).alias("candidates"),
            (F.endswith(low, F.lit("%")) | F.endswith(low, F.lit("percent"))).alias("is_pct"), year.alias("is_year"),
        )

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), one)


def trivial(number: Column, largest: int = 12) -> Column:
    """Years, and whole numbers up to `largest` that are no percentages."""
    v = number["value"]
    return number["is_year"] | (~number["is_pct"] & (v == F.floor(v)) & (F.abs(v) <= largest))


def mantissa(value: Column, digits: int = 3) -> Column:
    """The first significant digits, cut off; 0 for 0. Read from the decimal form, so powers of ten are exact."""
    rounded = F.regexp_replace(F.format_string("%.12e", F.abs(value.cast("double"))), r"[.]", "")
    return F.when(value == 0, F.lit(0)).otherwise(F.substring(rounded, 1, digits).cast("int"))


def close(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def pct_close(a: Column, b: Column) -> Column:
    return (F.abs(a - b) <= 0.1) | close(a, b)


def largest_distinct(values: Column, limit: int = 60) -> Column:
    """The `limit` largest distinct non-zero values by magnitude; of equal magnitudes the positive first."""
    order = lambda x, y: F.when(F.abs(x) > F.abs(y), F.lit(-1)).when(F.abs(x) < F.abs(y), F.lit(1)).when(x > y, F.lit(-1)).when(x < y, F.lit(1)).otherwise(F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != 0))), order), 1, limit)


def derivation(target: Column, is_pct: Column, values: Column, limit: int = 60) -> Column:
    """How two of the largest values give the target: as difference, sum, percentage change, share or ratio; null if they don't. The first pair by size counts."""
    pool = largest_distinct(values, limit)
    near = lambda x: F.when(is_pct, pct_close(target, x)).otherwise(close(target, x))

    def pair(a: Column, b: Column) -> Column:
        told = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        x, y = a.cast("string"), b.cast("string")
        return (
            F.when(close(target, a - b), told(x, " - ", y)).when(close(target, b - a), told(y, " - ", x)).when(close(target, a + b), told(x, " + ", y))
            .when(near((a - b) / F.abs(b) * 100), told("change from ", y, " to ", x, " in %")).when(near(F.abs(a - b) / F.abs(b) * 100), told("change between ", y, " and ", x, " in %"))
            .when(near(a / b * 100), told(x, " / ", y, " in %")).when(close(target, a / b), told(x, " / ", y))
        )

    pairs = F.transform(pool, lambda a, i: F.get(F.filter(F.transform(F.slice(pool, i + 2, F.lit(limit)), lambda b: pair(a, b)), lambda x: x.isNotNull()), F.lit(0)))
    return F.get(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0))


def support(number: Column, grounded: Column, limit: int = 60) -> Column:
    """struct<kind, reason>: exact, rescaled, derived or invented, and by which value or pair."""
    first = lambda test: F.get(F.flatten(F.transform(number["candidates"], lambda c: F.filter(grounded, lambda g: test(c, g)))), F.lit(0))
    exact, same = first(close), F.when(~number["is_pct"], first(lambda c, g: mantissa(c) == mantissa(g)))
    derived = F.get(F.filter(F.transform(number["candidates"], lambda c: derivation(c, number["is_pct"], grounded, limit)), lambda x: x.isNotNull()), F.lit(0))
    as_struct = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    return (
        F.when(exact.isNotNull(), as_struct("exact", exact.cast("string"))).when(same.isNotNull(), as_struct("rescaled", same.cast("string")))
        .when(derived.isNotNull(), as_struct("derived", derived)).otherwise(as_struct("invented", F.lit(None).cast("string")))
    )


def classify(number: Column, grounded: Column, limit: int = 60) -> Column:
    """exact, rescaled, derived or invented."""
    return support(number, grounded, limit)["kind"]
