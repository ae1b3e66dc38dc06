"""Command line of the engine.

python -m strata list | run QUERY DIR | ingest SECTIONS OUT | index CHUNKS OUT | search CHUNKS TEXT... | evaluate CHUNKS QUESTIONS | compare RUN_A RUN_B | judge RUNS
"""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.functions import formats
from strata.functions.text import snippet
from strata.operators import chunking, corpus, dense, evaluate, lexical
from strata.plans import catalog
from strata.settings import Settings
from strata.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="name the catalogued queries")
    run = sub.add_parser("run", help="run a catalogued query over a folder of tables")
    run.add_argument("query")
    run.add_argument("dir")
    run.add_argument("--limit", type=int, default=20)
    run.add_argument("--explain", action="store_true")
    ingest = sub.add_parser("ingest", help="clean, cut and store sections (filing_id, item, text, ticker, year)")
    ingest.add_argument("sections")
    ingest.add_argument("out")
    ingest.add_argument("--tickers", nargs="*")
    ingest.add_argument("--years", nargs="*", type=int)
    ingest.add_argument("--dry-run", action="store_true", help="print totals, write nothing")
    index = sub.add_parser("index", help="store the lexical index and vectors of chunks")
    index.add_argument("chunks")
    index.add_argument("out")
    search = sub.add_parser("search", help="search chunks for one or more questions")
    search.add_argument("chunks")
    search.add_argument("text", nargs="+")
    for c in (search, evaluation := sub.add_parser("evaluate", help="score a search over labelled questions")):
        c.add_argument("--retrieval", choices=["v1", "v2", "v3", "v4"], default="v1")
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--index", help="a stored index")
        c.add_argument("--include-sparse", action="store_true")
        c.add_argument("--include-by-ref", action="store_true")
    search.add_argument("--ticker")
    search.add_argument("--year", type=int)
    search.add_argument("--section")
    search.add_argument("--snippet-chars", type=int, default=200)
    evaluation.add_argument("chunks")
    evaluation.add_argument("questions")
    evaluation.add_argument("--use-filters", action="store_true", help="give the search each question's own ticker and year")
    evaluation.add_argument("--bm25-weight", type=float)
    evaluation.add_argument("--limit", type=int, help="score the first n questions by id")
    evaluation.add_argument("--ticker")
    evaluation.add_argument("--output", help="folder for the records")
    compare = sub.add_parser("compare", help="compare the records of two evaluations")
    compare.add_argument("a")
    compare.add_argument("b")
    judge = sub.add_parser("judge", help="put stored answers to the checks")
    judge.add_argument("runs")
    judge.add_argument("--output")
    return p


def _lines(df: DataFrame, columns: list[str]) -> None:
    print("\n".join(io.text_table(df, columns)))


def _ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = spark.read.parquet(a.sections)
    raw = raw.where(F.col("ticker").isin(*a.tickers)) if a.tickers else raw
    raw = raw.where(F.col("year").isin(*a.years)) if a.years else raw
    sections = corpus.recover_by_reference(corpus.extract_sections(raw))
    chunks = chunking.chunk_sections(sections).join(raw.select("filing_id", "ticker", "year").distinct(), "filing_id").withColumnRenamed("item", "section")
    if not a.dry_run:
        io.write_chunks(chunks, a.out)
        chunks = io.read_chunks(spark, a.out)
    _lines(corpus.ingest_totals(chunks), ["ticker", "filings", "sections", "chunks", "sparse", "by_reference"])


def _engine(spark: SparkSession, a: argparse.Namespace, cfg: Settings) -> Engine:
    chunks = io.read_chunks(spark, a.chunks)
    chunks = chunks if "key" in chunks.columns else chunks.withColumn("key", F.xxhash64("point_id"))
    return Engine(chunks if "embedding" in chunks.columns else dense.embed(chunks, "text", "embedding"), settings=cfg, index=lexical.load(spark, a.index) if a.index else None)


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    q = spark.createDataFrame([(str(i), t, a.ticker, a.year, a.section) for i, t in enumerate(a.text)], "query_id string, query string, q_ticker string, q_year int, q_section string")
    found = _engine(spark, a, Settings()).search(dense.embed(q, "query", "query_vector"), a.retrieval, a.top_k, exclude_sparse=not a.include_sparse, exclude_by_reference=not a.include_by_ref)
    for r in found.select("query_id", "rank", "ticker", "year", "section", F.round("score", 4).alias("score"), snippet(F.col("text"), a.snippet_chars).alias("text")).orderBy("query_id", "rank").collect():
        print(f"{r['query_id']:>3} {r['rank']:>3}  [{r['ticker']} | FY{r['year']} | {r['section']}] {r['score']}  {r['text']}")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = Settings() if a.bm25_weight is None else replace(Settings(), lexical_weight=a.bm25_weight)
    labelled = spark.read.parquet(a.questions)
    labelled = labelled.where(F.col("ticker") == a.ticker.upper()) if a.ticker else labelled
    labelled = labelled.orderBy("id").limit(a.limit) if a.limit else labelled
    q = labelled.select(F.col("id").alias("query_id"), F.col("question").alias("query"), *([F.col("ticker").alias("q_ticker"), F.col("year").alias("q_year")] if a.use_filters else []))
    began = time.perf_counter()
    asked = dense.embed(lexical.with_scope(q), "query", "query_vector")
    found = _engine(spark, a, cfg).search(asked, a.retrieval, a.top_k, exclude_sparse=not a.include_sparse, exclude_by_reference=not a.include_by_ref)
    records = evaluate.records(found, labelled).persist()
    n = records.count()
    each = (time.perf_counter() - began) * 1000 / max(1, n)  # all questions are answered at once
    records = records.withColumn("latency_ms", F.lit(each))
    if a.output:
        io.write_report(records, a.output)
    rates = [formats.pct(F.col(c)).alias(c) for c in ("keyword_hit", "perfect", "zero", "ticker_hit", "year_hit", "section_hit")]
    _lines(evaluate.report(records).select("value", "n", *rates, F.round("top1_score", 3).alias("top1_score"), F.round("latency_ms", 0).alias("latency_ms")), ["value", "n", "keyword_hit", "perfect", "zero", "ticker_hit", "year_hit", "section_hit", "top1_score", "latency_ms"])


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    both = evaluate.compare(spark.read.json(a.a), spark.read.json(a.b))
    shown = both.where("bucket <> 'unchanged' or still_failing").select("query_id", "bucket", formats.delta(F.col("delta"), False).alias("delta"), F.array_join("now_found", "|").alias("now_found"), F.array_join("now_missing", "|").alias("now_missing"))
    _lines(shown, ["query_id", "bucket", "delta", "now_found", "now_missing"])
    _lines(evaluate.net(both), ["bucket", "n"])


def _judge(spark: SparkSession, a: argparse.Namespace) -> None:
    judged = evaluate.judge(spark.read.parquet(a.runs)).persist()
    if a.output:
        io.write_report(judged, a.output)
    rates = ["faithful", "with_invented", "bad_citation", "wrong_index", "no_citation"]
    _lines(evaluate.faithfulness(judged).select("value", "n", "errors", *[formats.pct(F.col(c)).alias(c) for c in rates], "checked", "invented", "skipped"), ["value", "n", "errors", *rates, "checked", "invented", "skipped"])


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "run" and a.query not in catalog.QUERIES:
        p.error(f"unknown query {a.query!r}")
    if a.command != "ingest" and not all(os.path.exists(x) or "://" in x for x in (getattr(a, n, None) for n in ("dir", "chunks", "runs", "a", "b")) if x):
        p.error("no such folder")
    spark = SparkSession.builder.appName("strata").getOrCreate()
    if a.command == "run":
        df = catalog.QUERIES[a.query](spark, a.dir)
        df.explain("formatted") if a.explain else df.show(a.limit, truncate=100)
    elif a.command == "index":
        chunks = io.read_chunks(spark, a.chunks)
        chunks = chunks if "key" in chunks.columns else chunks.withColumn("key", F.xxhash64("point_id"))
        lexical.write(dense.embed(chunks, "text", "embedding"), a.out)
    else:
        {"ingest": _ingest, "search": _search, "evaluate": _evaluate, "compare": _compare, "judge": _judge}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
