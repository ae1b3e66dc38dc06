"""Deterministic identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "strata:chunk")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Name-based UUID, version 5, of a string column; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    joined = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), joined)


def point_id(filing_id: Column, section: Column, chunk_index: Column) -> Column:
    """Key of a chunk: the same chunk gets the same key at every ingestion."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return uuid5(F.concat_ws("|", part(filing_id), part(section), part(chunk_index)))
