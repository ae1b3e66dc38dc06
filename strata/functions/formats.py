"""Cells of printed reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(rate: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", rate * 100)


def delta(change: Column, as_pct: bool = True) -> Column:
    """A signed change, in percentage points or plain; -- where there is none."""
    return F.when(F.abs(change) < 1e-9, F.lit("--")).otherwise(F.format_string("%+.1fpp", change * 100) if as_pct else F.format_string("%+.3f", change))
