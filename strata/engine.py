"""One object for the whole engine: search, tools, checks and evaluation over a table of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import dims
from strata.operators import corpus, evaluate, fusion, guard, lexical, planner, predicates, questions, reconcile, validation
from strata.settings import Settings
from strata.sources import io

#: What a search tool says when there is nothing to show.
NO_MATCH = "No filing text matched these filters. Say that nothing was found; do not answer from memory."
BELOW_FLOOR = "Text was found, but none of it is relevant enough. Say so; do not answer from it."


@dataclass
class Engine:
    """chunks: (key, text, ticker, year, section, is_sparse, incorporated_by_reference, embedding, optional chunk_index, company, period_of_report, record_id)."""

    chunks: DataFrame
    figures: DataFrame | None = None
    settings: Settings = Settings()
    aliases: dict[str, list[str]] = field(default_factory=lambda: dims.ALIASES)
    scorer: Callable[[], fusion.Scorer] | None = None
    today: int = 2025
    index: lexical.Index | None = None

    def warm_up(self, path: str) -> Engine:
        """Writes the lexical index (with the vectors, if the chunks have them) under `path` and searches it from now on."""
        self.index = lexical.write(self.chunks, path, self.settings)
        return self

    def parse(self, queries: DataFrame) -> DataFrame:
        return questions.parse_questions(queries, self.settings, self.today, self.aliases)

    def search(self, queries: DataFrame, version: str = "v1", top_k: int | None = None, candidates: int | None = None, **flags: bool) -> DataFrame:
        """(query_id, key, rank, score, ...) with the chunks' columns."""
        found = fusion.search(self.chunks, queries, version, top_k, self.settings, self.scorer, candidates, self.parse, self.index, **flags)
        own = [c for c in self.chunks.columns if c not in ("embedding", "key", *found.columns)]
        return fusion.with_columns_of(found, self.chunks, own)

    def search_tool(self, calls: DataFrame) -> DataFrame:
        """(query_id, status, kept, dropped, adjusted, rendered) of calls (query_id, query, query_vector, ticker string, year string, section).

        Names and years are validated first; results below the relevance floor are left out; a call without results says what to do.
        """
        used = validation.validate(calls, self.settings, self.aliases)
        # the section may be written without the word Item
        section = F.when(F.col("section").rlike(r"(?i)^\s*\d{1,2}[a-c]?\s*$"), F.concat(F.lit("Item "), F.upper(F.trim("section")))).otherwise(F.trim("section"))
        q = used.select("query_id", "query", "query_vector", "adjusted", F.col("used_ticker").alias("q_ticker"), F.col("used_year").alias("q_year"), F.nullif(section, F.lit("")).alias("q_section"))
        found = self.search(q.drop("adjusted"), "v4")
        status = predicates.floor_status(found, q, self.settings.relevance_floor)
        if "chunk_index" not in found.columns:
            found = found.withColumn("chunk_index", F.lit(None).cast("int"))
        text = io.tool_text(found.where(predicates.above_floor(self.settings.relevance_floor)))
        told = F.when(F.col("status") == "none", NO_MATCH).when(F.col("status") == "below_floor", BELOW_FLOOR).otherwise(F.col("rendered"))
        return q.select("query_id", "adjusted").join(status, "query_id").join(text, "query_id", "left").withColumn("rendered", told)

    def list_corpus(self) -> DataFrame:
        """Chunks, sections, company and period per ticker and year; companies of the list without chunks come with zero."""
        held = corpus.inventory(self.chunks)
        names = self.chunks.sparkSession.createDataFrame([(t,) for t in self.aliases], "ticker string")
        return names.join(held, "ticker", "full_outer").na.fill(0, ["chunks", "sections"])

    def fiscal_notes(self) -> DataFrame:
        """(ticker, year, note): which fiscal label a year tag of a shifted company stands for."""
        rows = [(t, y, f"{t} labels the year tagged {y} as fiscal {y - by}") for t, by in dims.FISCAL_OFFSET.items() for y in self.settings.years]
        return self.chunks.sparkSession.createDataFrame(rows, "ticker string, year int, note string")

    def financials_tool(self, calls: DataFrame) -> DataFrame:
        """(query_id, rendered) of calls (query_id, ticker string, year string): needs both; unknown ones and missing filings are told."""
        used = validation.validate(calls, self.settings, self.aliases).select("query_id", F.col("used_ticker").alias("ticker"), F.col("used_year").alias("year"), "adjusted")
        told = used.join(io.financials_text(self.get_financials()), ["ticker", "year"], "left")
        needed = F.when(F.col("ticker").isNull() | F.col("year").isNull(), F.concat(F.lit("Both a company and a year are needed: "), F.col("adjusted")))
        return told.select("query_id", F.coalesce(needed, F.col("rendered"), F.format_string("No figures of %s FY%d are on file.", F.col("ticker"), F.col("year"))).alias("rendered"))

    def get_financials(self) -> DataFrame:
        """(ticker, year, metrics, unavailable) in millions; only reconciled figures are given."""
        if self.figures is None:
            raise ValueError("this engine was made without figures")
        return reconcile.financials(reconcile.reconcile(self.figures, self.settings))

    def plan(self, queries: DataFrame) -> DataFrame:
        """Tool calls that questions need, by rule."""
        return planner.plan_calls(queries, self.settings, self.aliases)

    def check_questions(self, queries: DataFrame) -> DataFrame:
        return guard.check_questions(queries, self.settings, self.aliases)

    def check_answers(self, answers: DataFrame) -> DataFrame:
        return guard.check_answers(answers, self.settings)

    def evaluate(self, queries: DataFrame, labelled: DataFrame, version: str = "v2", top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(records, report) of a whole question set in one job."""
        scored = evaluate.records(self.search(lexical.with_scope(queries), version, top_k), labelled)
        return scored, evaluate.report(scored)
