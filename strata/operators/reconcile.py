"""Reported figures against statement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import dims
from strata.functions.numbers import close
from strata.settings import Settings


def first_number(line: Column) -> Column:
    """The first number of a line; in parentheses it is negative. Null where none can be read."""
    tail = F.regexp_extract(line, r"[$\d(].*$", 0)
    m = r"(\(?)\$?\s*(-?[\d,]+(?:\.\d+)?)(\)?)"
    value = F.regexp_replace(F.regexp_extract(tail, m, 2), ",", "").try_cast("double")
    return F.when((F.regexp_extract(tail, m, 1) != "") & (F.regexp_extract(tail, m, 3) != ""), -value).otherwise(value)


def statement_lines(statements: DataFrame) -> DataFrame:
    """(filing_id, statement, line_no, line) of rendered statements (filing_id, statement, text); a missing statement has no lines."""
    return statements.select("filing_id", "statement", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "line"))


def line_values(lines: DataFrame) -> DataFrame:
    """(filing_id, metric, line_value): patterns in order, then lines in order; the first with a readable number counts.

    The patterns are a fixed dimension of some twenty rows, broadcast to the lines.
    """
    p = F.broadcast(dims.line_patterns(lines.sparkSession).join(F.broadcast(dims.metrics(lines.sparkSession).select("metric", "statement")), "metric"))
    hit = lines.join(p, "statement").where(F.expr("line rlike concat('(?i)', pattern)"))
    return hit.withColumn("v", first_number(F.col("line"))).where("v is not null").groupBy("filing_id", "metric").agg(F.min_by("v", F.struct("pat_no", "line_no")).alias("line_value"))


def status(value: Column, line: Column, mode: Column, prefer_statement: Column, cfg: Settings = Settings()) -> tuple[Column, Column]:
    """(status, usable value): absent, no_line, ok (the extracted value with its sign), statement (the line's, scaled) or unreconciled."""
    got = value / cfg.statement_scale
    agree = F.when(mode == "abs", close(F.abs(got), F.abs(line), cfg.tolerance)).otherwise(close(got, line, cfg.tolerance))
    s = F.when(value.isNull() | F.isnan(value), "absent").when(line.isNull(), "no_line").when(agree, "ok").when(prefer_statement, "statement").otherwise("unreconciled")
    return s, F.when(s == "ok", value).when(s == "statement", line * cfg.statement_scale)


def reconcile(extracted: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Adds new_status and usable_value to (metric, value, statement_value); unknown metrics compare exactly."""
    d = F.broadcast(dims.metrics(extracted.sparkSession).select("metric", "mode", "prefer_statement"))
    s, v = status(F.col("value"), F.col("statement_value"), F.coalesce("mode", F.lit("exact")), F.coalesce("prefer_statement", F.lit(False)), cfg)
    return extracted.join(d, "metric", "left").withColumn("new_status", s).withColumn("usable_value", v).drop("mode", "prefer_statement")


def financials(reconciled: DataFrame) -> DataFrame:
    """(ticker, year, metrics, unavailable): usable figures in millions by name, and the names of the rest; none usable gives an empty map."""
    usable = F.col("new_status").isin(*dims.USABLE)
    one = reconciled.groupBy("ticker", "year", "metric").agg(F.max_by(F.when(usable, F.col("usable_value") / 1e6), F.struct("extracted_at", "figure_id")).alias("v"))
    pairs = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("metric", "v")))
    return one.groupBy("ticker", "year").agg(F.map_from_entries(F.array_sort(pairs)).alias("metrics"), F.array_sort(F.collect_list(F.when(F.col("v").isNull(), F.col("metric")))).alias("unavailable"))
