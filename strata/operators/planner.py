"""Which tool calls a question needs: a rule planner in place of a language model.

One call for each company and year that the question names. Without a year the newest one is taken; words of change over time ask for all years, the
newest first. Questions for one of the reported figures go to the figures tool, and to the search as well; without a company the corpus is listed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import dims
from strata.operators.questions import YEAR, _bounded
from strata.settings import Settings

TREND = r"(?i)\b(?:trends?|over (?:time|the years)|changed?|evol\w+|since|growth|grew|compared?|year[- ]over[- ]year)\b"
FIGURES = r"(?i)\b(?:revenues?|net income|operating income|total assets|total liabilities|(?:share|stock)holders'? equity|operating cash flow|capital expenditures?|capex)\b"


def plan_calls(questions: DataFrame, cfg: Settings = Settings(), aliases: dict[str, list[str]] = dims.ALIASES) -> DataFrame:
    """(query_id, step, tool, query, ticker, year) of (query_id, query); steps count from 1. A null question needs no call."""
    text = F.coalesce(F.col("query"), F.lit(""))
    low = F.lower(text)
    named = F.filter(F.array(*[F.when(low.rlike("|".join(_bounded(n) for n in [*own, t.lower()])), F.lit(t)) for t, own in aliases.items()]), lambda t: t.isNotNull())
    held = F.array(*[F.lit(y) for y in sorted(cfg.years, reverse=True)])
    asked = F.filter(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.isin(*cfg.years))
    years = F.when(F.size(asked) > 0, F.reverse(F.array_sort(F.array_distinct(asked)))).when(text.rlike(TREND), held).otherwise(F.slice(held, 1, 1))
    tools = F.when(text.rlike(FIGURES), F.array(F.lit("get_financials"), F.lit("search"))).otherwise(F.array(F.lit("search")))
    no_name = F.lit(None).cast("string")
    calls = F.when(
        F.size(named) == 0, F.array(F.struct(F.lit("list_corpus").alias("tool"), no_name.alias("ticker"), F.lit(None).cast("int").alias("year")), F.struct(F.lit("search").alias("tool"), no_name.alias("ticker"), F.when(F.size(asked) > 0, F.array_max(asked)).alias("year")))
    ).otherwise(F.flatten(F.flatten(F.transform(named, lambda t: F.transform(years, lambda y: F.transform(tools, lambda tool: F.struct(tool.alias("tool"), t.alias("ticker"), y.alias("year"))))))))
    planned = questions.where("query is not null").select("query_id", "query", F.posexplode(calls).alias("step", "c"))
    return planned.select("query_id", (F.col("step") + 1).alias("step"), "c.tool", "query", "c.ticker", "c.year")
