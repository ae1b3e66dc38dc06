"""Rule-based reading of questions: company, year, section and the text without them. Expressions only; one pass over any number of questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import dims
from strata.settings import Settings

# fixed values: forms in which a question names a filing, a fiscal label, a year or a relative year
FILING = r"(?i)\b((?:19|20)\d{2})\s+(?:(?:form\s+)?10-?k|annual\s+report)\b"
FISCAL = r"(?i)(?:fiscal(?:\s+year)?|fy)\s*((?:19|20)\d{2})"
YEAR = r"\b((?:19|20)\d{2})\b"
RELATIVE = r"(?i)\b(last|prior|previous|this|current)\s+year\b"
ITEM = r"(?i)\bitem\s+(\d{1,2}\s*[a-c]?)\b"


def _bounded(phrase: str) -> str:
    return r"\b" + re.sub(r"([^\w\s'])", r"\\\1", phrase) + r"\b"


def ticker_expr(text: Column, aliases: dict[str, list[str]]) -> Column:
    """struct(ticker, alias): the longest name that occurs as a word, then the earliest, then the first listed."""
    names = [(a, t) for t, own in aliases.items() for a in own] + [(t.lower(), t) for t in aliases]
    low = F.lower(text)
    found = F.array(*[
        F.when(low.rlike(_bounded(a)), F.struct((-F.lit(len(a))).alias("n"), F.regexp_instr(low, F.lit(_bounded(a))).alias("at"), F.lit(i).alias("i"), F.lit(t).alias("ticker"), F.lit(a).alias("alias")))
        for i, (a, t) in enumerate(names)
    ])
    return F.array_min(F.filter(found, lambda s: s.isNotNull()))


def year_expr(text: Column, ticker: Column, cfg: Settings, today: int, offsets: dict[str, int]) -> tuple[Column, Column]:
    """(year before clamping, where it comes from): filing named > fiscal label (with the company's offset) > bare year > relative phrase."""
    ints = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda y: y.cast("int"))
    filing = F.nullif(F.regexp_extract(text, FILING, 1), F.lit("")).cast("int")
    fiscal, bare = F.array_max(ints(FISCAL)), F.array_max(ints(YEAR))
    offset = F.lit(0)
    for t, by in offsets.items():
        offset = F.when(ticker == t, F.lit(by)).otherwise(offset)
    word = F.lower(F.regexp_extract(text, RELATIVE, 1))
    relative = F.when(word.isin("this", "current"), F.lit(today)).when(word != "", F.lit(today - 1))
    year = F.coalesce(filing, fiscal + offset, bare, relative)
    source = F.when(filing.isNotNull(), "filing").when(fiscal.isNotNull(), "fiscal").when(bare.isNotNull(), "bare").when(relative.isNotNull(), "relative")
    return year, source


def section_expr(text: Column) -> Column:
    """An item named outright, if it exists, else the longest phrase; of equally long ones the first listed."""
    named = F.concat(F.lit("Item "), F.upper(F.regexp_replace(F.regexp_extract(text, ITEM, 1), r"\s+", "")))
    low = F.lower(text)
    phrases = F.array(*[F.when(low.rlike(_bounded(p)), F.struct(F.lit(-len(p)).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("section"))) for i, (p, s) in enumerate(dims.SECTION_PHRASES)])
    return F.when(named.isin(*[s[0] for s in dims.SECTIONS]), named).otherwise(F.array_min(F.filter(phrases, lambda s: s.isNotNull()))["section"])


#: stands for what is taken out of a question
_GONE = "\u0001"


def clean_expr(text: Column, ticker: Column, aliases: dict[str, list[str]]) -> Column:
    """The question without the names of its company, years and filings; the question itself if nothing is left.

    What is taken out leaves a mark. A mark goes with the possessive behind it, and at the end of a question with the preposition before it.
    """
    patterns = {t: r"(?i)\b(?:" + "|".join(_bounded(n)[2:-2] for n in sorted([*own, t.lower()], key=len, reverse=True)) + r")\b" for t, own in aliases.items()}
    of_ticker = F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair]) if patterns else F.lit(None).cast("map<string,string>")
    pattern = F.coalesce(F.try_element_at(of_ticker, F.coalesce(ticker, F.lit(""))), F.lit("(?!)"))
    marked = F.regexp_replace(text, pattern, F.lit(_GONE))
    for p in (FILING, FISCAL, YEAR, RELATIVE):
        marked = F.regexp_replace(marked, p, _GONE)
    at_end = rf"(?i)(?:\b(?:at the end of|during|for|in|of)(?:\s+the)?\s+)?(?:{_GONE}(?:'s)?\s*)+([?])"
    bare = F.regexp_replace(F.regexp_replace(marked, at_end, "$1"), rf"{_GONE}(?:'s)?", " ")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r" ([?.,])", "$1"))
    return F.when(tidy == "", text).otherwise(tidy)


def parse_questions(questions: DataFrame, cfg: Settings = Settings(), today: int = 2025, aliases: dict[str, list[str]] = dims.ALIASES, offsets: dict[str, int] = dims.FISCAL_OFFSET) -> DataFrame:
    """Adds p_ticker, p_year, p_section, clean_query, year_source, year_clamped_from to (query). Null questions read as empty."""
    text = F.coalesce(F.col("query"), F.lit(""))
    read = questions.withColumn("_t", ticker_expr(text, aliases)).withColumn("p_ticker", F.col("_t.ticker")).withColumn("ticker_matched", F.col("_t.alias")).drop("_t")
    year, source = year_expr(text, F.col("p_ticker"), cfg, today, offsets)
    low, high = min(cfg.years), max(cfg.years)
    return (
        read.withColumn("_y", year).withColumn("year_source", source).withColumn("p_year", F.when(F.col("_y").isNotNull(), F.least(F.greatest(F.col("_y"), F.lit(low)), F.lit(high))))
        .withColumn("year_clamped_from", F.when(F.col("_y") != F.col("p_year"), F.col("_y"))).drop("_y")
        .withColumn("p_section", section_expr(text)).withColumn("clean_query", clean_expr(text, F.col("p_ticker"), aliases))
    )


def merged_spans(spans: DataFrame) -> DataFrame:
    """(id, start, end): overlapping or touching spans of each id joined."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return island.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
