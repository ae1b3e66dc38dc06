"""Arguments of a search call against the corpus: names to symbols, years into range, with a note of every change."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import dims
from strata.settings import Settings


def _fuzzy(names: dict[str, str], cutoff: float):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        memo: dict[str, str | None] = {}
        for x in s.dropna().unique():
            near = difflib.get_close_matches(x, list(names), n=1, cutoff=cutoff)
            memo[x] = names[near[0]] if near else None
        return pd.Series([memo.get(x) if isinstance(x, str) else None for x in s], dtype=object)

    return run


def validate(calls: DataFrame, cfg: Settings = Settings(), aliases: dict[str, list[str]] = dims.ALIASES) -> DataFrame:
    """Adds used_ticker, used_year, adjustments to (ticker string, year string). Blank means not given, without a note.

    A name is looked up as it is, then as the longest alias in it, then by similarity; an unknown one is dropped with a note. A year may be written like FY2023; it is moved into range.
    """
    names = {**{a: t for t, own in aliases.items() for a in own}, **{t.lower(): t for t in aliases}}
    given = F.lower(F.trim(F.coalesce("ticker", F.lit(""))))
    exact = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), given)
    inside = F.lit(None).cast("string")
    for a in sorted(names, key=lambda a: (len(a), a)):
        from strata.operators.questions import _bounded

        inside = F.when(given.rlike(_bounded(a)), F.lit(names[a])).otherwise(inside)
    close = _fuzzy(names, cfg.fuzzy_cutoff)(F.when(exact.isNull() & inside.isNull() & (given != ""), given))
    df = calls.withColumn("used_ticker", F.coalesce(exact, inside, close))
    digits = F.regexp_extract(F.coalesce(F.col("year").cast("string"), F.lit("")), r"(?:19|20)\d{2}", 0).try_cast("int")
    low, high = min(cfg.years), max(cfg.years)
    df = df.withColumn("used_year", F.when(digits.isNotNull(), F.least(F.greatest(digits, F.lit(low)), F.lit(high))))
    note = lambda field, proposed, used, why: F.struct(F.lit(field).alias("field"), proposed.cast("string").alias("proposed"), used.cast("string").alias("used"), F.lit(why).alias("reason"))
    raw_year = F.trim(F.coalesce(F.col("year").cast("string"), F.lit("")))
    notes = F.array(
        F.when((given != "") & F.col("used_ticker").isNull(), note("ticker", F.col("ticker"), F.lit(None), "unknown company")),
        F.when((given != "") & F.col("used_ticker").isNotNull() & (F.upper(given) != F.col("used_ticker")), note("ticker", F.col("ticker"), F.col("used_ticker"), "company name read as its symbol")),
        F.when((raw_year != "") & digits.isNull(), note("year", F.col("year"), F.lit(None), "not a year")),
        F.when(digits.isNotNull() & (digits != F.col("used_year")), note("year", F.col("year"), F.col("used_year"), "outside the corpus")),
        F.when(digits.isNotNull() & (digits == F.col("used_year")) & (raw_year != F.col("used_year").cast("string")), note("year", F.col("year"), F.col("used_year"), "read as a year")),
    )
    df = df.withColumn("adjustments", F.filter(notes, lambda x: x.isNotNull()))
    return df.withColumn("adjusted", F.when(F.size("adjustments") == 0, "none").otherwise(F.concat_ws("; ", F.transform("adjustments", lambda a: F.concat_ws(" ", a["field"], a["proposed"], F.lit("->"), F.coalesce(a["used"], F.lit("none")))))))
