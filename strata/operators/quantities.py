"""Quantities in one unit per kind: figures in US dollars, and the amounts inside texts.

Cases: a null value stays null; a null or empty note names no unit; an unknown currency, or a currency without a rate for the
year, gives null. Null text holds no amount. Repeated rows each come out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import units
from strata.session import small_side


@F.pandas_udf(T.StructType([T.StructField("vf", T.DoubleType()), T.StructField("vc", T.StringType()), T.StructField("sf", T.DoubleType()), T.StructField("sc", T.StringType())]))
def _note_units(notes: pd.Series) -> pd.DataFrame:
    rows = []
    for note in notes:
        v, s = units.note_units(note)
        rows.append((v and v.factor, v and v.currency, s and s.factor, s and s.currency))
    return pd.DataFrame(rows, columns=["vf", "vc", "sf", "sc"])


@F.pandas_udf(T.StructType([T.StructField("f", T.DoubleType()), T.StructField("c", T.StringType())]))
def _line_unit(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        u = units.statement_line_unit(line)
        rows.append((u and u.factor, u and u.currency))
    return pd.DataFrame(rows, columns=["f", "c"])


def statement_units(texts: DataFrame) -> DataFrame:
    """(filing_id, f, c): the unit stated for the statements in the Item 8 texts of each filing; the most frequent one, then the first."""
    hint = r"(?i)thousand|million|billion|units|whole|scaled|[$€£¥]|\b(usd|eur|gbp|jpy|cad|yen|euros?|dollars?)\b"
    lines = (
        texts.where("filing_id is not null and text is not null").where(F.lower(F.trim("section")) == "item 8")
        .select("filing_id", "record_id", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(units.STATEMENT_LINE) & x.rlike(hint))).alias("line"))
        .withColumn("u", _line_unit("line")).where("u.f is not null")
    )
    counted = lines.groupBy("filing_id", "u.f", "u.c").agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    best = F.max_by(F.struct("f", "c"), F.struct("n", -F.col("first"))).alias("u")
    return counted.groupBy("filing_id").agg(best).select("filing_id", "u.f", "u.c")


def figures_in_dollars(figures: DataFrame, texts: DataFrame, rates: DataFrame) -> DataFrame:
    """(figure_id, value_usd, statement_usd). rates: (currency, year, usd_per_unit), one row each.

    value: the note's unit, else dollars. statement_value: the note's, else the one its filing states, else millions of dollars.
    """
    stated = statement_units(texts).select("filing_id", F.col("f").alias("lf"), F.col("c").alias("lc"))
    noted = figures.select("figure_id", "filing_id", "year", "value", "statement_value", _note_units("note").alias("u"))
    joined = noted.join(stated, "filing_id", "left")
    rate = small_side(rates.select("currency", F.col("year").alias("_y"), "usd_per_unit").dropDuplicates(["currency", "_y"]))

    def with_rate(df: DataFrame, currency: str, out: str) -> DataFrame:
        r = rate.select(F.col("currency").alias("_c"), "_y", F.col("usd_per_unit").alias(out))
        return df.join(r, (F.col(currency) == F.col("_c")) & (F.col("year") == F.col("_y")), "left").drop("_c", "_y").withColumn(out, F.when(F.col(currency) == "USD", F.lit(1.0)).otherwise(F.col(out)))

    sized = joined.select(
        "figure_id", "year", "value", "statement_value",
        F.coalesce("u.vf", F.lit(1.0)).alias("vf"), F.coalesce("u.vc", F.lit("USD")).alias("vc"),
        F.coalesce("u.sf", "lf", F.lit(1e6)).alias("sf"),
        F.when(F.col("u.sf").isNotNull(), F.col("u.sc")).when(F.col("lf").isNotNull(), F.col("lc")).otherwise(F.lit("USD")).alias("sc"),
    )
    rated = with_rate(with_rate(sized, "vc", "vr"), "sc", "sr")
    return rated.select("figure_id", (F.col("value") * F.col("vf") * F.col("vr")).alias("value_usd"), (F.col("statement_value") * F.col("sf") * F.col("sr")).alias("statement_usd"))


def disagreeing(converted: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Figures whose two values, without sign, differ by more than `tolerance` of the larger."""
    a, b = F.abs("value_usd"), F.abs("statement_usd")
    return converted.where(F.abs(a - b) > F.lit(tolerance) * F.greatest(a, b))


AMOUNTS = "record_id bigint, year int, seq int, start int, raw string, kind string, amount double, currency string, below string, unit string, status string"


def amounts_in_texts(texts: DataFrame, rates: DataFrame) -> DataFrame:
    """(record_id, seq, start, raw, kind, amount, unit, status): every amount and physical quantity in (record_id, year, text), in the canonical unit of its kind.

    Money below the line ('per euro') is converted as well. status: ok, no rate (of that currency and year), unknown currency or unread unit; the amount is null unless ok."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for record, year, text in zip(pdf["record_id"], pdf["year"], pdf["text"]):
                year = None if year is None or year != year else int(year)
                for seq, q in enumerate(units.find_quantities(text)):
                    u = q.unit
                    rows.append((record, year, seq, q.start, q.raw, q.kind, q.canonical(), u and u.currency, u and u.below, u and units.kind_and_unit(u)[1], q.status))
            got = pd.DataFrame(rows, columns=["record_id", "year", "seq", "start", "raw", "kind", "amount", "currency", "below", "unit", "status"])
            yield got.astype({"year": "Int32", "amount": "float64"})

    found = texts.select("record_id", "year", "text").where(F.col("text").rlike("[0-9]")).mapInPandas(run, AMOUNTS)
    rate = small_side(rates.select("currency", "year", "usd_per_unit").dropDuplicates(["currency", "year"]))
    divisor = rate.select(F.col("currency").alias("below"), "year", F.col("usd_per_unit").alias("usd_below"))

    def factor(currency: str, rate: str) -> Column:
        return F.when(F.col(currency).isNull() | (F.col(currency) == "USD"), F.lit(1.0)).otherwise(F.col(rate))

    converted = found.join(rate, ["currency", "year"], "left").join(divisor, ["below", "year"], "left").withColumn("by", factor("currency", "usd_per_unit") / factor("below", "usd_below"))
    status = F.when((F.col("status") == "ok") & F.col("by").isNull(), "no rate").otherwise(F.col("status"))
    return converted.select("record_id", "seq", "start", "raw", "kind", (F.col("amount") * F.col("by")).alias("amount"), "unit", status.alias("status"))
