"""Readers and writers of filings, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "id string, question string, ticker string, year int, section string, question_type string, difficulty string, answer string, error string, latency_ms double"


def read_listing(spark: SparkSession, path: str, identity: str, fmt: str = "parquet") -> DataFrame:
    """The listing of filings. The identity of the reader is asked for before anything is read."""
    if not identity or not identity.strip():
        raise ValueError("an identity (name and address) is required to read filings")
    return spark.read.format(fmt).load(path)


def read_chunks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Chunks, with only the columns asked for: text and vectors stay unread unless named."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of JSON files with a list `runs`."""
    return spark.read.schema(f"runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.explode("runs").alias("r")).select("r.*")


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, one per row; the folder is made if needed."""
    report.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, by: tuple[str, ...] = ("ticker", "year"), files: int = 8) -> None:
    """Replace the partitions that `chunks` holds; chunks that vanished on re-ingestion vanish with them. A partition is written by up to `files` tasks, so that a hot one isn't one task's work."""
    chunks.repartition(*by, F.pmod(F.xxhash64(*[c for c in ("point_id", "filing_id", "section", "chunk_index") if c in chunks.columns] or chunks.columns), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def tool_text(results: DataFrame) -> DataFrame:
    """(query_id, rendered): results in order with a header each."""
    head = F.format_string("[%s | FY%s | %s | chunk %s]", F.col("ticker"), F.col("year").cast("string"), F.col("section"), F.col("chunk_index").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", head, "text").alias("t"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("rendered"))


def call_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One record per query with its results in order: a value, no global state."""
    hits = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "year", "section", "chunk_index", "score"))).alias("results"))
    return queries.select("query_id", "query").join(hits, "query_id", "left").withColumn("num_results", F.coalesce(F.size("results"), F.lit(0)))


def span_records(results: DataFrame, queries: DataFrame, version: str, filters: dict[str, object]) -> DataFrame:
    """(query_id, span): one JSON record per search with its input, filters and documents, in the attribute names of the OpenInference convention."""
    document = F.struct(
        F.concat_ws("|", "filing_id", "section", F.col("chunk_index").cast("string")).alias("document.id"), F.col("text").alias("document.content"), F.col("score").alias("document.score"),
        F.to_json(F.struct("ticker", "year", "section", "chunk_index", "filing_id")).alias("document.metadata"),
    )
    docs = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", document.alias("d")))), lambda x: x["d"]).alias("docs"))
    span = F.struct(
        F.lit("RETRIEVER").alias("openinference.span.kind"), F.col("query").alias("input.value"), F.lit(version).alias("retrieval.version"),
        *[F.lit("None" if v is None else str(v)).alias(f"retrieval.filter.{k}") for k, v in filters.items()], F.greatest(F.size("docs"), F.lit(0)).alias("retrieval.result_count"), F.col("docs").alias("retrieval.documents"),
    )
    return queries.select("query_id", "query").join(docs, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast(docs.schema["docs"].dataType))).select("query_id", F.to_json(span).alias("span"))


def financials_text(figures: DataFrame) -> DataFrame:
    """(ticker, year, rendered) of (ticker, year, metrics in millions by name, unavailable): what the figures tool says; no figure is given that isn't reconciled."""
    lines = F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.format_string("  %-22s %14s", e["key"], F.format_number(e["value"], 0)))
    head = F.format_string("%s FY%d reported figures, US$ millions:", F.col("ticker"), F.col("year"))
    missing = F.when(F.size("unavailable") > 0, F.concat(F.lit("  not available here (search the text): "), F.array_join("unavailable", ", ")))
    none = F.format_string("No figure of %s FY%d could be reconciled. State none.", F.col("ticker"), F.col("year"))
    return figures.select("ticker", "year", F.when(F.size("metrics") == 0, none).otherwise(F.concat_ws("\n", head, F.array_join(lines, "\n"), missing)).alias("rendered"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(filing_id, statement, text) of rendered statements in files <filing_id>/<statement>.txt; a statement that is missing or empty has no row, and the others stay."""
    parts = F.regexp_extract_all(F.col("path"), F.lit(r"([^/]+)/([^/]+)\.txt$"), F.lit(1)), F.regexp_extract_all(F.col("path"), F.lit(r"([^/]+)/([^/]+)\.txt$"), F.lit(2))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.get(parts[0], F.lit(0)).alias("filing_id"), F.get(parts[1], F.lit(0)).alias("statement"), "text").where("filing_id is not null and trim(text) <> ''")


def text_table(report: DataFrame, columns: list[str], width: int = 14) -> list[str]:
    """Fixed-width lines of a report (a report is an aggregate of few rows; difficulties in their order)."""
    rank = F.when(F.col(columns[0]) == "easy", 0).when(F.col(columns[0]) == "medium", 1).when(F.col(columns[0]) == "hard", 2).otherwise(3)
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c in columns]
    rows = report.withColumn("_o", F.row_number().over(Window.orderBy(rank, *columns))).select("_o", F.concat(*cells).alias("line")).orderBy("_o").collect()
    return ["".join(c.ljust(width) for c in columns), *[r["line"] for r in rows]]
