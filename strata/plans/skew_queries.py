"""Queries of the skew operator over the ingest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import skew
from strata.session import cut, table

KEYS = ["filing_id", "section"]


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = skew.balanced_counts(table(spark, sf, "ingest"), KEYS, "chunk_index", F.length("text"))
    return counts.select(*KEYS, "rows", F.col("distinct_values").alias("chunks"), F.col("size").alias("chars"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = cut(skew.balanced_counts(table(spark, sf, "ingest"), KEYS, "chunk_index"))  # one row a key, read twice
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.where("filing_id is not null and section is not null and rows >= 6").join(F.broadcast(total), F.expr("rows >= 0.01 * total")).select(*KEYS)


def p3_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each ingest row with the listings of its filing; the hot filing's listings are copied to its shards."""
    rows = table(spark, sf, "ingest").select("filing_id", "record_id", "section")
    listed = table(spark, sf, "filings").select("filing_id", "listing_id", "form", "filing_date")
    return skew.balanced_join(rows, listed, ["filing_id"]).select("record_id", "filing_id", "section", "listing_id", "form", "filing_date")


QUERIES = {"p3_counts": p3_counts, "p3_found": p3_found, "p3_join": p3_join}
_COUNTS = """SELECT filing_id, section, count(*) AS rows, count(DISTINCT chunk_index) AS chunks,
    CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM ingest GROUP BY filing_id, section"""
SQL = {
    "p3_counts": _COUNTS,
    "p3_found": f"""SELECT filing_id, section FROM ({_COUNTS}) WHERE filing_id IS NOT NULL AND section IS NOT NULL
        AND rows >= 6 AND rows >= 0.01 * (SELECT count(*) FROM ingest)""",
    "p3_join": "SELECT record_id, filing_id, section, listing_id, form, filing_date FROM ingest JOIN filings USING (filing_id)",
}
