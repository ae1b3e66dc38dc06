"""From filings to sections and back to chunks: listing, sections, numbering, inventory, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import dims
from strata.functions import text as tx
from strata.settings import Settings


def latest_filings(listing: DataFrame, years: list[int] | None = None, form: str = "10-K") -> DataFrame:
    """The newest filing of each (ticker, year): exact form only, year from the period, first seen wins ties (by listing_id). A null or odd period is skipped."""
    year = F.col("period_of_report").substr(1, 4).try_cast("int")
    rows = listing.where(F.col("form") == form).withColumn("year", year).where("year is not null")
    if years is not None:
        rows = rows.where(F.col("year").isin(*years))
    w = Window.partitionBy("ticker", "year").orderBy(F.col("filing_date").desc_nulls_last(), "listing_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_filings(latest: DataFrame, tickers: DataFrame, years: list[int]) -> DataFrame:
    """(ticker, year) asked for but not listed; years is a short list."""
    wanted = tickers.select("ticker").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return wanted.join(latest.select("ticker", "year"), ["ticker", "year"], "left_anti")


def _order() -> dict[str, int]:
    return {s[0]: i for i, s in enumerate(dims.SECTIONS)}


def extract_sections(raw: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(filing_id, item, text) -> cleaned sections with label, part, is_sparse, incorporated_by_reference, in the form's order; empty ones drop out."""
    d = F.broadcast(dims.sections(raw.sparkSession))
    plain = raw.select("filing_id", "item", tx.clean_text(F.col("text")).alias("text"))
    cleaned = plain.withColumn("text", tx.truncate_at_next_item(F.col("text"), F.col("item"), _order())).join(d, "item").where(F.length(F.trim("text")) > 0)
    flagged = cleaned.withColumn("is_sparse", tx.is_sparse(F.col("text"), cfg.sparse_chars, cfg.single_sentence_chars))
    return flagged.withColumn("incorporated_by_reference", tx.by_reference(F.col("text"), cfg.reference_window)).select("filing_id", "ord", "item", "label", "part", "text", "is_sparse", "incorporated_by_reference")


def missing_sections(sections: DataFrame, filings: DataFrame, item: str = "item") -> DataFrame:
    """(filing_id, item): required items that a filing lacks."""
    every = filings.select("filing_id").distinct().withColumn("item", F.explode(F.array(*[F.lit(s[0]) for s in dims.SECTIONS if not s[3]])))
    return every.join(sections.select("filing_id", F.col(item).alias("item")).distinct(), ["filing_id", "item"], "left_anti")


def recover_by_reference(sections: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Items 7 and 8 that only point elsewhere get their text from the filing's longest other section, if that holds a financial section and an audit report after it."""
    w = Window.partitionBy("filing_id")
    stub = F.max(F.col("item").isin("Item 7", "Item 8") & F.col("incorporated_by_reference")).over(w)
    donor = F.max_by(F.col("item"), F.when(~F.col("item").isin("Item 7", "Item 8"), F.struct(F.length("text").alias("n"), (-F.col("ord")).alias("o")))).over(w)
    donor_text = F.max(F.when(F.col("item") == F.col("_donor"), F.col("text"))).over(w)
    marked = sections.withColumn("_stub", stub).withColumn("_donor", donor).withColumn("_text", donor_text)
    start = F.regexp_instr("_text", F.lit(r"(?m)^[ \t]*FINANCIAL SECTION[ \t]*$"))
    rest = F.expr("substring(_text, _a)")
    audit = F.regexp_instr("_rest", F.lit(r"(?im)^[ \t]*report of independent registered public accounting firm"))
    cutting = marked.withColumn("_a", start).withColumn("_rest", F.when(F.col("_a") > 0, rest)).withColumn("_b", F.coalesce(audit, F.lit(0)))
    strip = lambda e: F.regexp_replace(F.expr(e), r"^\s+|\s+$", "")
    seven, eight = strip("substring(_rest, 1, _b - 1)"), strip("substring(_rest, _b)")
    ok = F.col("_stub") & (F.col("_a") > 0) & (F.col("_b") > 1) & (F.length(seven) > 0) & (F.length(eight) > 0)
    text = F.when(ok & (F.col("item") == "Item 7"), seven).when(ok & (F.col("item") == "Item 8"), eight).when(ok & (F.col("item") == F.col("_donor")), strip("substring(_text, 1, _a - 1)")).otherwise(F.col("text"))
    changed = cutting.withColumn("_ok", F.coalesce(ok & (F.col("item").isin("Item 7", "Item 8") | (F.col("item") == F.col("_donor"))), F.lit(False))).withColumn("text", text)
    sparse = F.when(F.col("_ok"), tx.is_sparse(F.col("text"), cfg.sparse_chars, cfg.single_sentence_chars)).otherwise(F.col("is_sparse"))
    by_ref = F.when(F.col("_ok") & F.col("item").isin("Item 7", "Item 8"), F.lit(False)).when(F.col("_ok"), tx.by_reference(F.col("text"), cfg.reference_window)).otherwise(F.col("incorporated_by_reference"))
    return changed.withColumn("is_sparse", sparse).withColumn("incorporated_by_reference", by_ref).select(*sections.columns)


def renumbered(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """chunk_index and total_chunks_in_section of rows already cut, in the order of `order` (unique in a key).

    Positions are counted on two levels: rows of one key fall into buckets of equal ranges of `order`, and a window only sees one key's bucket, so that no key is numbered in one task.
    """
    span = chunks.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"))
    ranged = chunks.join(F.broadcast(span)).withColumn("_b", F.floor((F.col(order) - F.col("low")) / F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / 100_000)))).drop("low", "high", "n")
    counts = ranged.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    base = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("total_chunks_in_section", F.sum("_n").over(w).cast("int")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(order))
    return ranged.withColumn("_i", inside).join(base, [*key, "_b"]).withColumn("chunk_index", (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_b", "_i", "_before")


def inventory(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct sections, period and company per (ticker, year), from five narrow columns; first seen is the smallest record_id."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id")))
    return chunks.select("ticker", "year", "section", "company", "period_of_report", "record_id").groupBy("ticker", "year").agg(
        F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"), first("company").alias("company"), first("period_of_report").alias("period")
    )


def ingest_totals(chunks: DataFrame) -> DataFrame:
    """(ticker, filings, sections, chunks, sparse, by_reference) per ticker and, with ticker `all`, for everything: what an ingestion reports."""
    one = chunks.groupBy("ticker", "filing_id", "section").agg(F.count("*").alias("c"), F.count_if("is_sparse").alias("s"), F.count_if("incorporated_by_reference").alias("r"))
    return one.groupingSets([[F.col("ticker")], []], F.col("ticker")).agg(
        F.countDistinct("filing_id").alias("filings"), F.count_if(F.col("filing_id").isNotNull() & F.col("section").isNotNull()).alias("sections"), F.sum("c").alias("chunks"), F.sum("s").alias("sparse"), F.sum("r").alias("by_reference"), F.grouping_id().alias("_g"),
    ).select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("ticker")).alias("ticker"), "filings", "sections", "chunks", "sparse", "by_reference")


def with_absent(companies: DataFrame, held: DataFrame) -> DataFrame:
    """Every company of the list with its inventory; absent ones with zero chunks."""
    return companies.select("ticker").distinct().join(held, "ticker", "left").na.fill(0, ["chunks", "sections"])


def merge_by_key(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Last write wins: the new rows and the existing ones whose key is not among them. Duplicate keys in `new`: the largest `order` wins."""
    if order is not None:
        new = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("_r")).select(key, "_r.*")
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*existing.columns))


def ensure_table(spark: SparkSession, path: str, schema: str, vector: str | None = None, dim: int | None = None) -> bool:
    """Create an empty table if there is none (True). An existing one is left alone (False); another vector size is an error."""
    try:
        held = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return True
    if vector is not None and dim is not None:
        row = held.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        if row is not None and row["n"] != dim:
            raise ValueError(f"{path} holds vectors of {row['n']} dimensions, not {dim}")
    return False
