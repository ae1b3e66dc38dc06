"""Filters shared by every search arm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(ticker: str | None = None, year: int | None = None, section: str | None = None, exclude_sparse: bool = True, exclude_by_reference: bool = True) -> Column:
    """Conjunction of the given equalities; None sets no condition. A missing flag doesn't exclude a row."""
    conds = [F.col(c) == v for c, v in (("ticker", ticker), ("year", None if year is None else int(year)), ("section", section)) if v is not None]
    conds += [~F.col(c).eqNullSafe(True) for c, on in (("is_sparse", exclude_sparse), ("incorporated_by_reference", exclude_by_reference)) if on]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def describe_filters(ticker: str | None = None, year: int | None = None, section: str | None = None, exclude_sparse: bool = True, exclude_by_reference: bool = True) -> dict[str, object]:
    """The filters in force by name, for logs and span records."""
    return {"ticker": ticker, "year": year, "section": section, "exclude_sparse": exclude_sparse, "exclude_by_ref": exclude_by_reference}


def row_scope(prefix: str = "q_", exclude_sparse: bool = True, exclude_by_reference: bool = True) -> Column:
    """scope() with each query row's own ticker, year and section (columns with the prefix; null sets no condition)."""
    conds = [F.col(prefix + c).isNull() | (F.col(c) == F.col(prefix + c)) for c in ("ticker", "year", "section")]
    return reduce(lambda a, b: a & b, conds) & scope(exclude_sparse=exclude_sparse, exclude_by_reference=exclude_by_reference)


def above_floor(floor: float = 0.3) -> Column:
    return F.coalesce(F.col("rerank_score"), F.col("score")) >= floor


def floor_status(results: DataFrame, queries: DataFrame, floor: float = 0.3) -> DataFrame:
    """(query_id, kept, dropped, status): none when nothing matched, below_floor when all were dropped, else results."""
    ok = above_floor(floor)
    counted = results.groupBy("query_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
    return queries.select("query_id").join(counted, "query_id", "left").na.fill(0, ["kept", "dropped"]).withColumn(
        "status", F.when(F.col("kept") > 0, "results").when(F.col("dropped") > 0, "below_floor").otherwise("none")
    )
