"""Queries of listing, sections, chunking, figures, checks and evaluation over the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import dims
from strata.functions import formats
from strata.functions import numbers as nm
from strata.functions import text as tx
from strata.functions.ids import NAMESPACE, point_id
from strata.operators import corpus as co
from strata.operators import chunking, evaluate, fusion, guard, questions, reconcile, validation
from strata.plans import retrieval_queries as rq
from strata.session import table
from strata.settings import Settings

CFG = Settings()


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filings").withColumn("ticker", F.upper(F.trim("ticker")))


def latest_filings(spark: SparkSession, sf: str) -> DataFrame:
    return co.latest_filings(_listing(spark, sf)).select("ticker", "year", "listing_id", "filing_id", "filing_date")


def filings_missing(spark: SparkSession, sf: str) -> DataFrame:
    listing = _listing(spark, sf)
    return co.missing_filings(co.latest_filings(listing), listing.where("ticker is not null"), [2022, 2023, 2024])


def chunk_index_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ingest").where("filing_id is not null and section is not null").select("record_id", "filing_id", "section")
    return co.renumbered(rows, ["filing_id", "section"], "record_id").select("record_id", "chunk_index", "total_chunks_in_section")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return co.inventory(table(spark, sf, "ingest"))


def inventory_left_dim(spark: SparkSession, sf: str) -> DataFrame:
    held = co.inventory(table(spark, sf, "ingest")).groupBy("ticker").agg(F.sum("chunks").alias("chunks"), F.sum("sections").alias("sections"))
    return co.with_absent(_listing(spark, sf).where("ticker is not null"), held)


def section_missing(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "ingest").where("filing_id is not null and section is not null")
    return co.missing_sections(chunks.select("filing_id", "section"), chunks, "section")


def _raw_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filing_section").select("section_id", "filing_id", "item", "text")


def sections_clean(spark: SparkSession, sf: str) -> DataFrame:
    return co.recover_by_reference(co.extract_sections(_raw_sections(spark, sf).select("filing_id", "item", "text"), CFG))


def by_reference_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filing_section").where("text is not null").select("section_id", tx.by_reference(F.col("text")).alias("by_reference"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filing_section").where("text is not null").select("section_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the sections as they stand, with their characters besides blanks."""
    chunks = chunking.chunk_sections(_raw_sections(spark, sf), CFG)
    return chunks.select("section_id", "chunk_index", "total_chunks_in_section", F.length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "")).alias("characters"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filing_section").select("section_id", tx.clean_text(F.col("text")).alias("text"))


def ingest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return co.ingest_totals(table(spark, sf, "ingest").withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker is not null"))


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.tokenize(F.col("text"))
    windows = table(spark, sf, "filing_section").where("text is not null").select("section_id", F.posexplode(chunking.token_windows(tokens, 128, 16)).alias("window_no", "w"))
    return windows.select("section_id", "window_no", F.array_join("w", " ").alias("tokens"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ingest").select("record_id", point_id(F.col("filing_id"), F.col("section"), F.col("chunk_index")).alias("point_id"))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier half of the rows is held already; the later half is written over it."""
    rows = table(spark, sf, "ingest").select("record_id", F.concat_ws("|", F.coalesce("filing_id", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce(F.col("chunk_index").cast("string"), F.lit(""))).alias("key"))
    half = rows.agg((F.min("record_id") + F.max("record_id")) / 2).first()[0] or 0
    held = rows.where(F.col("record_id") <= half).groupBy("key").agg(F.max("record_id").alias("record_id"))
    return co.merge_by_key(held.select("record_id", "key"), rows.where(F.col("record_id") > half), "key", "record_id")


def extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "ingest").where("text is not null").select("record_id", F.posexplode(nm.extract_numbers(F.col("text"))).alias("seq", "n"))
    return found.select("record_id", "seq", "n.raw", F.round("n.value", 4).alias("value"), "n.is_pct", "n.is_year", nm.trivial(F.col("n")).alias("trivial"))


def _filing_values(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "figure")
    values = f.where("value is not null").groupBy("filing_id").agg(F.array_sort(F.collect_list(F.col("value") / 1e6)).alias("grounded"))
    return f.where("statement_value is not null").join(values, "filing_id").select("figure_id", "statement_value", "grounded")


def grounding_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a figure's statement value is close to any value of its filing: a tolerance semi-join as an array expression."""
    return _filing_values(spark, sf).select("figure_id", F.exists("grounded", lambda g: nm.close(F.col("statement_value"), g)).alias("exact"))


def grounding_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    same = F.exists("grounded", lambda g: nm.mantissa(F.col("statement_value")) == nm.mantissa(g))
    return _filing_values(spark, sf).select("figure_id", nm.mantissa(F.col("statement_value")).alias("mantissa"), same.alias("rescaled"))


def grounding_kinds(spark: SparkSession, sf: str) -> DataFrame:
    number = F.struct(F.array("statement_value").alias("candidates"), F.lit(False).alias("is_pct"))
    return _filing_values(spark, sf).withColumn("n", number).select("figure_id", nm.classify(F.col("n"), F.col("grounded")).alias("kind"))


def grounding_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Statement values that two values of their filing give."""
    return _filing_values(spark, sf).where(nm.derivation(F.col("statement_value"), F.lit(False), F.col("grounded")).isNotNull()).select("figure_id")


_RETRIEVED = "array(named_struct('ticker','AAPL','year',2022,'section','Item 8','chunk',44), named_struct('ticker','AAPL','year',2022,'section','Item 7','chunk',0), named_struct('ticker','AAPL','year',2024,'section','Item 8','chunk',11))"
_ANSWERS = {
    "bare": "$391,035", "scaled": "$394,328 million", "billions": "$394.3 billion", "difference": "a decrease of $3,293 million", "sum": "$785,363 million combined", "change": "fell 0.8%", "made_up": "revenue of $450,000 million",
    "tenfold": "grew 80%", "year": "in 2023", "ordinal": "the 3 sources", "fabricated": "Net sales were $391,035 million.\n\nSources:\n[AAPL | FY2023 | Item 8 | chunk 99] x", "index": "Net sales were $391,035 million.\n\nSources:\n[AAPL | FY2024 | Item 8 | chunk 77] x",
    "good": "Net sales fell from $394,328 million in FY2022 to $391,035 million in FY2024, a decrease of $3,293 million or 0.8%.\n\nSources:\n[AAPL | FY2022 | Item 8 | chunk 44] x\n[AAPL | FY2024 | Item 8 | chunk 11] x",
}


def grounding_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on stated answers against stated evidence."""
    answers = spark.createDataFrame(list(_ANSWERS.items()), "id string, answer string")
    evidence = answers.withColumn("grounded", F.array(*[F.lit(v) for v in (394328.0, 365817.0, 274515.0, 99803.0, 391035.0, 383285.0, 8.0)])).withColumn("retrieved", F.expr(_RETRIEVED))
    got = guard.check_answers(evidence, CFG)
    return got.select("id", "allowed", *[F.col(f"counts.{k}").alias(k) for k in ("exact", "rescaled", "derived", "invented", "skipped")], F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule"])), ",").alias("rules"))


def _calls(spark: SparkSession) -> DataFrame:
    calls = [(1, "AAPL", "2023"), (2, "apple", "FY2023"), (3, "Apple Inc", "2019"), (4, "  ", ""), (5, None, None), (6, "Home Depot", "2030"), (7, "Microsfot", "next"), (8, "Tesla", "2022"), (9, "the bank of america group", "2024"), (10, "googl", " 2024 ")]
    return spark.createDataFrame(calls, "call_id int, ticker string, year string")


def validate_year(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate(_calls(spark), CFG).select("call_id", "used_year", F.exists("adjustments", lambda a: a["field"] == "year").alias("adjusted_year"))


def validate_ticker_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are listed or hold a listed one."""
    return validation.validate(_calls(spark).where("call_id not in (7)"), CFG).select("call_id", "used_ticker")


def validate_ticker_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate(_calls(spark), CFG).select("call_id", "used_ticker", "adjusted")


_STATEMENTS = [
    ("f1", "income", "Sales to customers  5\nTotal net sales\n  Total net sales  $ 1,234  1,100\nNet income including noncontrolling interests 9\nNet income 8.5 7"), ("f1", "balance", "Total liabilities and equity 70\nTotal liabilities 40\nTotal liabilities and shareholders' equity 70\nTotal shareholders' equity (3)"),
    ("f1", "cashflow", "Net cash provided by operating activities from continuing operations 1\nNet cash from operating activities (12)\nPurchases of property (7)"), ("f2", "income", "Revenue 10\nTotal revenue\nOperating income per region"), ("f2", "balance", ""), ("f3", "income", None),
]


def line_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of stated statements by metric: patterns in order of precedence, then lines in order."""
    return reconcile.line_values(reconcile.statement_lines(spark.createDataFrame(_STATEMENTS, "filing_id string, statement string, text string")))


def clean_query(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_question").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return rq._parse(spark, sf)(q).select("query_id", "clean_query")


def question_guard(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_question").select("id", F.col("question").alias("query"))
    out = guard.check_questions(q, CFG)
    return out.select("id", "allowed", F.size("findings").alias("findings"))


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_question")
    text = F.format_string("See [%s | FY%s | %s | chunk 0].", "ticker", F.col("year").cast("string"), "section")
    return q.select("id", F.explode(guard.citations(text, 6)).alias("c")).select("id", "c.*")


def citation_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Citations that name a chunk at hand; loose: its filing and section at least."""
    held = table(spark, sf, "ingest").select(F.upper(F.trim("ticker")).alias("ticker"), "year", F.lower("section").alias("section"), F.col("chunk_index").alias("chunk")).distinct()
    cited = _cited(spark, sf)
    strict = cited.join(held, ["ticker", "year", "section", "chunk"], "left_semi").select("id", F.lit("strict").alias("kind"))
    loose = cited.join(held, ["ticker", "year", "section", "chunk"], "left_anti").join(held, ["ticker", "year", "section"], "left_semi").select("id", F.lit("loose").alias("kind"))
    return strict.unionByName(loose)


def citation_missing(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "ingest").select(F.upper(F.trim("ticker")).alias("ticker"), "year", F.lower("section").alias("section")).distinct()
    return _cited(spark, sf).join(held, ["ticker", "year", "section"], "left_anti").select("id")


def reconcile_status(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.reconcile(table(spark, sf, "figure"), CFG).select("figure_id", "new_status", F.round("usable_value", 2).alias("usable_value"))


def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.reconcile(table(spark, sf, "figure"), CFG).groupBy("metric", "new_status").agg(F.count("*").alias("n"))


def financials(spark: SparkSession, sf: str) -> DataFrame:
    got = reconcile.financials(reconcile.reconcile(table(spark, sf, "figure"), CFG))
    return got.select("ticker", "year", F.array_join(F.map_keys("metrics"), ",").alias("metrics"), F.array_join("unavailable", ",").alias("unavailable"))


def parse_sections(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_question").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return questions.parse_questions(q, rq.CFG).select("query_id", "p_section", "p_year", "year_source")


def _with_meta(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    return fusion.with_columns_of(hits.select("query_id", "key", "rank", "score"), rq.corpus(spark, sf), ["ticker", "year", "section", "text"])


def _run_a(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.records(_with_meta(spark, sf, rq._lexical(spark, sf, 5)), table(spark, sf, "eval_question"))


def _run_b(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.records(_with_meta(spark, sf, rq._search(spark, sf, "v3")), table(spark, sf, "eval_question"))


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    return _run_a(spark, sf).select("query_id", F.round("keyword_hit", 6).alias("keyword_hit"), "ticker_hit", "year_hit", "section_hit", F.round("top1_score", 6).alias("top1_score"))


_RATES = ("keyword_hit", "perfect", "zero", "ticker_hit", "year_hit", "section_hit", "top1_score")


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(_run_a(spark, sf)).select("dimension", "value", "n", *[F.round(c, 6).alias(c) for c in _RATES])


def eval_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the printed report by question type."""
    rows = evaluate.report(_run_a(spark, sf), ("question_type",))
    return rows.select("dimension", "value", "n", *[formats.pct(F.col(c)).alias(c) for c in ("perfect", "zero", "ticker_hit", "year_hit")])


def eval_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(_run_a(spark, sf)).select("query_id", F.array_join("missing", "|").alias("missing"))


def eval_compare(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.compare(_run_a(spark, sf), _run_b(spark, sf))
    return out.select("query_id", F.round("delta", 6).alias("delta"), "bucket", F.array_join("now_found", "|").alias("now_found"), F.array_join("now_missing", "|").alias("now_missing"), "still_failing")


def eval_net(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.net(evaluate.compare(_run_a(spark, sf), _run_b(spark, sf)))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the questions by their place in the order of ids: right, with an invented figure, with a filing never retrieved, with a wrong chunk, without a citation, and failed."""
    q = table(spark, sf, "eval_question").withColumn("n", F.row_number().over(Window.orderBy("id")))
    kind = F.col("n") % 6
    year = F.when(kind == 2, F.col("year") - 50).otherwise(F.col("year"))
    chunk = F.when(kind == 3, 9).otherwise(0)
    cited = F.format_string("\n\nSources:\n[%s | FY%d | %s | chunk %d] x", "ticker", year, "section", chunk)
    figure = F.when(kind == 1, F.lit(777_777_777)).otherwise(F.lit(1_000_000) + F.col("n") * 1000)
    answer = F.concat(F.format_string("In 2023 it came to $%s in all.", F.format_number(figure, 0)), F.when(kind == 4, F.lit("")).otherwise(cited))
    held = F.array(F.struct("ticker", "year", "section", F.lit(0).alias("chunk")))
    return q.select("id", "ticker", "year", "section", "question_type", F.when(kind == 5, F.lit(None)).otherwise(answer).alias("answer"), F.when(kind == 5, "failed").alias("error"), F.array((F.lit(1_000_000) + F.col("n") * 1000).cast("double")).alias("grounded"), held.alias("retrieved"))


def faithfulness_report(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).where("ticker is not null and year is not null and section is not null")
    out = evaluate.faithfulness(evaluate.judge(runs, replace(CFG, symbol_chars=6)))
    return out.select("dimension", "value", "n", "errors", *[F.round(c, 6).alias(c) for c in ("faithful", "with_invented", "bad_citation", "wrong_index", "no_citation", "grounded_share")], "checked", "exact", "invented", "skipped")


QUERIES = {f.__name__: f for f in (
    latest_filings, filings_missing, chunk_index_totals, inventory, inventory_left_dim, section_missing, sections_clean, by_reference_flag, sentence_split, chunk_pack, clean_text, ingest_totals, token_windows, chunk_ids, upsert_merge,
    extract_numbers, grounding_exact, grounding_rescaled, grounding_kinds, grounding_derived, grounding_verdict, validate_year, validate_ticker_exact, validate_ticker_fuzzy, line_first_match, clean_query, question_guard, citation_semi, citation_missing, reconcile_status, reconcile_counts, financials, parse_sections,
    eval_records, eval_report, eval_table, eval_failures, eval_compare, eval_net, faithfulness_report,
)}

_LATEST = """latest AS (SELECT * FROM (SELECT upper(trim(ticker, ' ')) AS ticker, TRY_CAST(substr(period_of_report, 1, 4) AS INT) AS year, listing_id, filing_id, filing_date FROM filings WHERE form = '10-K')
    WHERE year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, year ORDER BY filing_date DESC NULLS LAST, listing_id) = 1)"""
_INVENTORY = """SELECT ticker, year, count(*) AS chunks, count(DISTINCT section) AS sections,
    arg_min(company, record_id) FILTER (company IS NOT NULL) AS company, arg_min(period_of_report, record_id) FILTER (period_of_report IS NOT NULL) AS period FROM ingest GROUP BY ticker, year"""
_REQUIRED = ", ".join(f"('Item {i}')" for i in rq._TWIN_ITEMS if i not in ("1C", "9C", "16"))
# fixed values of the twins, stated here on their own: numbers in answers, forms of asking for advice, words that name no company, names of companies
_NUM = r"(?i)(\(|-)?\$?\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+)\)?\s*(billion|bn|b\b|million|mm|m\b|thousand|k\b|trillion|tn|t\b)?(\s*%|\s*percent)?"
_ADVICE = r"(?i)\b(should i (buy|sell|invest|hold|own|add)|is\s+\S+(\s+\S+)?\s+a\s+(good|bad|solid|safe|smart)\s+(buy|sell|investment|stock|time|pick|bet)|(good|bad) (investment|buy|stock) (right now|today|now)|worth (buying|investing|a buy|owning)|(recommend|advise)\s+(a\s+|me\s+|buying|selling|investing)|what should i (buy|invest|do with|pick)|price target|will\s+.{0,25}(stock|share|price).{0,25}(go up|go down|rise|fall|beat|outperform)|(predict|forecast)\s+.{0,25}(price|stock|return|performance)|(out|under)perform the market)\b"
_PLAIN_WORDS = "what which when where how why who does did compare list show tell give summarise summarize describe explain according based the for from in is are was were can could would should risk risks revenue revenues net total cash item sec edgar md a i us usa gaap ceo cfo r ai eps fy q1 q2 q3 q4 it esg ip tv".split()
_COMPANIES = {
    "AAPL": ["apple inc", "apple"], "MSFT": ["microsoft corporation", "microsoft"], "JPM": ["jpmorgan chase", "jpmorgan", "jp morgan", "j.p. morgan", "chase"], "JNJ": ["johnson & johnson", "johnson and johnson", "j&j", "johnson"], "WMT": ["walmart inc", "walmart", "wal-mart"],
    "XOM": ["exxonmobil", "exxon mobil", "exxon"], "GOOGL": ["alphabet inc", "alphabet", "google"], "BAC": ["bank of america", "bofa", "b of a"], "PFE": ["pfizer inc", "pfizer"], "HD": ["home depot", "the home depot"],
}
_SCALED = "CASE lower(w) WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'trillion' THEN 1e12 WHEN 'tn' THEN 1e12 WHEN 't' THEN 1e12 ELSE 1.0 END"
_VALUES = "vals AS (SELECT filing_id, list(value / 1e6) AS grounded FROM figure WHERE value IS NOT NULL GROUP BY filing_id)"
_STATUS = """st AS (SELECT f.*, CASE WHEN value IS NULL THEN 'absent' WHEN statement_value IS NULL THEN 'no_line'
    WHEN CASE WHEN metric IN ('stockholders_equity', 'operating_cash_flow', 'capital_expenditures') THEN abs(abs(value / 1e6) - abs(statement_value)) ELSE abs(value / 1e6 - statement_value) END <= 0.005 * greatest(abs(value / 1e6), abs(statement_value), 1.0) THEN 'ok'
    WHEN metric = 'revenue' THEN 'statement' ELSE 'unreconciled' END AS new_status FROM figure f),
us AS (SELECT *, CASE new_status WHEN 'ok' THEN value WHEN 'statement' THEN statement_value * 1e6 END AS usable_value FROM st)"""
_RESULT = """, hitrows AS (SELECT h.query_id, h.rank, h.score, c.ticker, c.year, c.section, c.text FROM {} h JOIN corpus c USING (key)),
agg{n} AS (SELECT query_id, regexp_replace(lower(string_agg(coalesce(text, ''), ' ' ORDER BY rank)), '\\s+', ' ', 'g') AS hay, list(DISTINCT ticker) AS tickers, list(DISTINCT year) AS years, list(DISTINCT section) AS sections, arg_min(score, rank) AS top1 FROM hitrows{n} GROUP BY query_id),
rec{n} AS (SELECT id AS query_id, ticker, section, question_type, difficulty, answer_keywords AS kw, list_filter(answer_keywords, lambda k: contains(coalesce(hay, ''), regexp_replace(lower(k), '\\s+', ' ', 'g'))) AS found,
    coalesce(list_contains(tickers, ticker), false) AS ticker_hit, coalesce(list_contains(years, year), false) AS year_hit, coalesce(list_contains(sections, section), false) AS section_hit, coalesce(top1, 0.0) AS top1_score
    FROM eval_question q LEFT JOIN agg{n} a ON a.query_id = q.id),
run{n} AS (SELECT *, CASE WHEN len(kw) > 0 THEN len(found) / len(kw) END AS keyword_hit, list_filter(kw, lambda k: NOT list_contains(found, k)) AS missing FROM rec{n})"""


def _run_sql(hits: str, n: str) -> str:
    return _RESULT.replace("hitrows AS", f"hitrows{n} AS").replace("{n}", n).replace("{}", hits)


_HITS_A = rq._ranked("bm", rq._FLAGS, 5)
_A = rq._BASE + _run_sql(f"({_HITS_A})", "a")
_AB = rq._BASE + rq._fused(f"{rq._FLAGS} AND {rq._PARSED}", 5) + _run_sql(f"({_HITS_A})", "a") + _run_sql("top", "b")
_REPORT = "count(*) AS n, " + ", ".join([
    "round(avg(keyword_hit), 6) AS keyword_hit", "round(avg(CASE WHEN keyword_hit = 1 THEN 1.0 ELSE 0.0 END), 6) AS perfect", "round(avg(CASE WHEN keyword_hit = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero",
    *[f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in ("ticker_hit", "year_hit", "section_hit")], "round(avg(top1_score), 6) AS top1_score",
])
_FAITH = """count(*) FILTER (k <> 5) AS n, count(*) FILTER (k = 5) AS errors, round(avg(CASE WHEN k <> 5 THEN CAST(k IN (0, 3, 4) AS INT) END), 6) AS faithful, round(avg(CASE WHEN k <> 5 THEN CAST(k = 1 AS INT) END), 6) AS with_invented,
    round(avg(CASE WHEN k <> 5 THEN CAST(k = 2 AS INT) END), 6) AS bad_citation, round(avg(CASE WHEN k <> 5 THEN CAST(k = 3 AS INT) END), 6) AS wrong_index, round(avg(CASE WHEN k <> 5 THEN CAST(k = 4 AS INT) END), 6) AS no_citation,
    round(1 - count(*) FILTER (k = 1) / nullif(count(*) FILTER (k <> 5), 0), 6) AS grounded_share, count(*) FILTER (k <> 5) AS checked, count(*) FILTER (k NOT IN (1, 5)) AS exact, count(*) FILTER (k = 1) AS invented, count(*) FILTER (k <> 5) AS skipped"""


_SENTENCES = r"""WITH RECURSIVE t AS (SELECT section_id, trim(text, ' ') AS text FROM filing_section WHERE text IS NOT NULL),
    m AS (SELECT section_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["''’”)\]]*)\s+(["''‘“(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM t),
    g AS (SELECT section_id, array_to_string(list_transform(p, lambda x: x || CASE WHEN regexp_matches(regexp_extract(x, '([A-Za-z]{1,5})\.["''’”)\]]*\s*$', 1), '^[A-Z]$') OR lower(regexp_extract(x, '([A-Za-z]{1,5})\.["''’”)\]]*\s*$', 1)) IN
            ('inc', 'corp', 'co', 'ltd', 'llc', 'lp', 'plc', 'no', 'nos', 'vs', 'etc', 'approx', 'est', 'fig', 'mr', 'mrs', 'ms', 'dr', 'jr', 'sr', 'st', 'prof', 'gov', 'dept', 'univ', 'cf', 'al', 'ie', 'eg',
             'jan', 'feb', 'mar', 'apr', 'jun', 'jul', 'aug', 'sept', 'sep', 'oct', 'nov', 'dec') THEN ' ' ELSE chr(1) END), '') AS j FROM m),
    glued AS (SELECT section_id, list_filter(list_transform(string_split(j, chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM g)"""
_KINDS = f"""WITH {_VALUES}, pool AS (SELECT filing_id, list(v ORDER BY abs(v) DESC, v DESC)[:60] AS pool FROM (SELECT DISTINCT filing_id, value / 1e6 AS v FROM figure WHERE value IS NOT NULL) WHERE v <> 0 GROUP BY filing_id),
    f AS (SELECT figure_id, statement_value AS s, grounded, coalesce(pool, []) AS pool FROM figure JOIN vals USING (filing_id) LEFT JOIN pool USING (filing_id) WHERE statement_value IS NOT NULL),
    n AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(substr(replace(format('{{:.12e}}', abs(s)), '.', ''), 1, 3) AS INT) END AS digits FROM f),
    made AS (SELECT figure_id, s, unnest([a - b, b - a, a + b, (a - b) / abs(b) * 100, abs(a - b) / abs(b) * 100, a / b * 100, a / b]) AS x FROM (
        SELECT figure_id, s, pool[i] AS a, unnest(pool[i + 1:]) AS b FROM (SELECT *, unnest(range(1, len(pool) + 1)) AS i FROM n))),
    hit AS (SELECT DISTINCT figure_id FROM made WHERE abs(s - x) <= 0.005 * greatest(abs(s), abs(x), 1.0)),
    kinds AS (SELECT n.figure_id, len(list_filter(grounded, lambda g: abs(s - g) <= 0.005 * greatest(abs(s), abs(g), 1.0))) > 0 AS exact,
        len(list_filter(grounded, lambda g: digits = CASE WHEN g = 0 THEN 0 ELSE CAST(substr(replace(format('{{:.12e}}', abs(g)), '.', ''), 1, 3) AS INT) END)) > 0 AS same, hit.figure_id IS NOT NULL AS derived FROM n LEFT JOIN hit USING (figure_id))"""


# compatibility forms of the test tables are no-break blanks, zero-width blanks and the ellipsis
_CLEAN = r"""WITH a AS (SELECT section_id, filing_id, item, replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8203), ''), '…', '...') AS t FROM filing_section),
    b AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '(?im)^.{0,80}\|\s*(?:19|20)\d\d\s*Form\s+10-K\s*\|\s*\d{1,4}\s*$', '', 'g'), '(?s)(?:^|\n)[ \t]*SIGNATURES?[ \t]*(?:\n.*)?$', '') AS t) FROM a),
    c AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t) FROM b),
    cleaned AS (SELECT * REPLACE (trim(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' ') AS t) FROM c)"""
_FORM = [
    ("Item 1", "Business", "Part I"), ("Item 1A", "Risk Factors", "Part I"), ("Item 1B", "Unresolved Staff Comments", "Part I"), ("Item 1C", "Cybersecurity", "Part I"), ("Item 2", "Properties", "Part I"), ("Item 3", "Legal Proceedings", "Part I"), ("Item 4", "Mine Safety Disclosures", "Part I"),
    ("Item 5", "Market for Registrant's Equity", "Part II"), ("Item 6", "Reserved", "Part II"), ("Item 7", "MD&A", "Part II"), ("Item 7A", "Quantitative Disclosures About Market Risk", "Part II"), ("Item 8", "Financial Statements", "Part II"), ("Item 9", "Changes in and Disagreements with Accountants", "Part II"),
    ("Item 9A", "Controls and Procedures", "Part II"), ("Item 9B", "Other Information", "Part II"), ("Item 9C", "Disclosure Regarding Foreign Jurisdictions", "Part II"), ("Item 10", "Directors, Executive Officers and Corporate Governance", "Part III"), ("Item 11", "Executive Compensation", "Part III"),
    ("Item 12", "Security Ownership of Certain Beneficial Owners", "Part III"), ("Item 13", "Certain Relationships and Related Transactions", "Part III"), ("Item 14", "Principal Accountant Fees and Services", "Part III"), ("Item 15", "Exhibits and Financial Statement Schedules", "Part IV"), ("Item 16", "Form 10-K Summary", "Part IV"),
]
_SECTIONS_CLEAN = _CLEAN + r""",
    form AS (SELECT * FROM (VALUES {form}) v(ord, item, label, part)),
    cutting AS (SELECT *, string_split(regexp_replace(t, '(?m)(^[ \t]*(?i:item)[ \t]+\d{1,2}[ \t]*(?i:[A-C])?[ \t]*[.:)\-][ \t]*[A-Z][A-Z''’\- ]{3,})', chr(2) || '\1', 'g'), chr(2)) AS p FROM cleaned JOIN form USING (item)),
    named AS (SELECT *, list_transform(p, lambda x, i: i > 1 AND (i > 2 OR p[1] <> '') AND coalesce(list_position([{items}], 'Item ' || upper(regexp_replace(regexp_extract(x, '(?i)^[ \t]*item[ \t]+(\d{1,2}[ \t]*[A-C]?)[ \t]*[.:)\-]', 1), '\s+', ''))) > ord + 1, false)) AS later FROM cutting),
    whole AS (SELECT filing_id, ord, item, label, part, CASE WHEN list_contains(later, true) THEN regexp_replace(array_to_string(p[1:list_position(later, true) - 1], ''), '^\s+|\s+$', '', 'g') ELSE t END AS text FROM named),
    bodies AS (SELECT *, regexp_replace(text, '(?i)^\s*item\s+\d+\s*[A-Z]?\s*[.:)\-]?\s*', '') AS body FROM whole WHERE trim(text, ' ') <> '')
    SELECT filing_id, CAST(ord AS INTEGER) AS ord, item, label, part, text, trim(body, ' ') = '' OR regexp_matches(trim(body, ' '), '(?i)^[\[(]?(none|not\s*applicable|n\s*/\s*a|omitted|reserved)[\])]?[.\s]*$') OR length(trim(body, ' ')) < 200
        OR (length(trim(body, ' ')) < 600 AND NOT regexp_matches(trim(body, ' '), '[.!?]["''’”)\]]*\s+["''‘“(\[]*[A-Z0-9]')) AS is_sparse,
        regexp_matches(substr(body, 1, 600), '(?i)incorporated\s+(?:herein\s+)?by\s+reference|reference\s+is\s+made\s+to') AS incorporated_by_reference FROM bodies""".replace(
    "{form}", ", ".join("({}, '{}', '{}', '{}')".format(i, a, b.replace("'", "''"), c) for i, (a, b, c) in enumerate(_FORM))).replace("{items}", ", ".join(f"'{x[0]}'" for x in _FORM))


def _grouped(head: str, body: str, dimensions: tuple[str, ...]) -> str:
    return head + " SELECT 'all' AS dimension, 'all' AS value, " + body + " FROM runa" + "".join(f" UNION ALL SELECT '{d}', {d}, {body} FROM runa GROUP BY {d}" for d in dimensions)


SQL = {
    "latest_filings": f"WITH {_LATEST} SELECT * FROM latest",
    "filings_missing": f"WITH {_LATEST} SELECT t.ticker, CAST(y.year AS INT) AS year FROM (SELECT DISTINCT upper(trim(ticker, ' ')) AS ticker FROM filings WHERE ticker IS NOT NULL) t, (VALUES (2022), (2023), (2024)) y(year) WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.ticker = t.ticker AND l.year = y.year)",
    "chunk_index_totals": "SELECT record_id, CAST(row_number() OVER (PARTITION BY filing_id, section ORDER BY record_id) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY filing_id, section) AS INT) AS total_chunks_in_section FROM ingest WHERE filing_id IS NOT NULL AND section IS NOT NULL",
    "inventory": _INVENTORY,
    "inventory_left_dim": f"SELECT t.ticker, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(sections), 0) AS BIGINT) AS sections FROM (SELECT DISTINCT upper(trim(ticker, ' ')) AS ticker FROM filings WHERE ticker IS NOT NULL) t LEFT JOIN ({_INVENTORY}) i USING (ticker) GROUP BY t.ticker",
    "section_missing": f"SELECT filing_id, item FROM (SELECT DISTINCT filing_id FROM ingest WHERE filing_id IS NOT NULL AND section IS NOT NULL), (VALUES {_REQUIRED}) v(item) WHERE (filing_id, item) NOT IN (SELECT filing_id, section FROM ingest WHERE filing_id IS NOT NULL AND section IS NOT NULL)",
    "by_reference_flag": r"""SELECT section_id, regexp_matches(substr(regexp_replace(text, '(?i)^\s*item\s+\d+\s*[A-Z]?\s*[.:)\-]?\s*', ''), 1, 600), '(?i)incorporated\s+(?:herein\s+)?by\s+reference|reference\s+is\s+made\s+to') AS by_reference FROM filing_section WHERE text IS NOT NULL""",
    "token_windows": f"""WITH t AS (SELECT section_id, {rq._TOK.format('text')} AS w FROM filing_section WHERE text IS NOT NULL), s AS (SELECT section_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 128 THEN 1 ELSE CAST(ceil((len(w) - 128) / 112.0) AS BIGINT) + 1 END)) AS n FROM t)
        SELECT section_id, CAST(n AS INT) AS window_no, array_to_string(w[n * 112 + 1:n * 112 + 128], ' ') AS tokens FROM s""",
    "chunk_ids": f"""WITH h AS (SELECT record_id, sha1(unhex('{NAMESPACE.hex}') || encode(concat(coalesce(filing_id, ''), '|', coalesce(section, ''), '|', coalesce(CAST(chunk_index AS VARCHAR), '')))) AS h FROM ingest)
        SELECT record_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id FROM h""",
    "upsert_merge": """SELECT key, max(record_id) AS record_id FROM (SELECT record_id, concat(coalesce(filing_id, ''), '|', coalesce(section, ''), '|', coalesce(CAST(chunk_index AS VARCHAR), '')) AS key FROM ingest) GROUP BY key""",
    "extract_numbers": f"""WITH m AS (SELECT record_id, regexp_extract_all(text, '{_NUM}') AS all_raw FROM ingest WHERE text IS NOT NULL), r AS (SELECT record_id, unnest(all_raw) AS raw, unnest(range(len(all_raw))) AS seq FROM m),
        g AS (SELECT record_id, seq, raw, regexp_extract(raw, '{_NUM}', 1) AS neg, regexp_extract(raw, '{_NUM}', 2) AS d, regexp_extract(raw, '{_NUM}', 3) AS w, regexp_extract(raw, '{_NUM}', 4) <> '' AS is_pct FROM r),
        v AS (SELECT *, regexp_matches(d, '^(19|20)\\d\\d$') AS is_year, CAST(replace(d, ',', '') AS DOUBLE) * CASE WHEN neg <> '' THEN -1 ELSE 1 END * CASE WHEN regexp_matches(d, '^(19|20)\\d\\d$') THEN 1.0 ELSE {_SCALED} END AS x FROM g)
        SELECT record_id, CAST(seq AS INT) AS seq, trim(raw, ' ') AS raw, round(x, 4) AS value, is_pct, is_year, is_year OR (NOT is_pct AND x = floor(x) AND abs(x) <= 12) AS trivial FROM v""",
    "grounding_exact": f"WITH {_VALUES} SELECT figure_id, len(list_filter(grounded, lambda g: abs(statement_value - g) <= 0.005 * greatest(abs(statement_value), abs(g), 1.0))) > 0 AS exact FROM figure JOIN vals USING (filing_id) WHERE statement_value IS NOT NULL",
    "grounding_rescaled": f"""WITH {_VALUES}, m AS (SELECT figure_id, statement_value AS s, grounded FROM figure JOIN vals USING (filing_id) WHERE statement_value IS NOT NULL)
        SELECT figure_id, CASE WHEN s = 0 THEN 0 ELSE CAST(substr(replace(format('{{:.12e}}', abs(s)), '.', ''), 1, 3) AS INT) END AS mantissa,
        len(list_filter(grounded, lambda g: (CASE WHEN g = 0 THEN 0 ELSE CAST(substr(replace(format('{{:.12e}}', abs(g)), '.', ''), 1, 3) AS INT) END) = (CASE WHEN s = 0 THEN 0 ELSE CAST(substr(replace(format('{{:.12e}}', abs(s)), '.', ''), 1, 3) AS INT) END))) > 0 AS rescaled FROM m""",
    "citation_semi": """WITH held AS (SELECT DISTINCT upper(trim(ticker, ' ')) AS ticker, year, lower(section) AS section, chunk_index FROM ingest), c AS (SELECT id, upper(ticker) AS ticker, year, lower(section) AS section FROM eval_question WHERE ticker IS NOT NULL AND year IS NOT NULL AND section IS NOT NULL AND length(ticker) <= 6)
        SELECT id, CASE WHEN bool_or(h.chunk_index = 0) THEN 'strict' ELSE 'loose' END AS kind FROM c JOIN held h USING (ticker, year, section) GROUP BY id""",
    "citation_missing": """WITH held AS (SELECT DISTINCT upper(trim(ticker, ' ')) AS ticker, year, lower(section) AS section FROM ingest WHERE ticker IS NOT NULL AND section IS NOT NULL)
        SELECT id FROM eval_question q WHERE ticker IS NOT NULL AND year IS NOT NULL AND section IS NOT NULL AND length(ticker) <= 6 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.ticker = upper(q.ticker) AND h.year = q.year AND h.section = lower(q.section))""",
    "question_guard": f"""WITH q AS (SELECT id, question, regexp_matches(question, '{_ADVICE}') AS advice, list_distinct(list_transform(regexp_extract_all(question, '\\b(?:19|20)\\d{{2}}\\b'), lambda y: CAST(y AS INT))) AS ys,
            list_filter(regexp_extract_all(question, '\\b([A-Z][a-z]{{2,}})\\b', 1), lambda w: NOT list_contains([{', '.join(repr(w) for w in _PLAIN_WORDS)}], lower(w))) AS nouns,
            len(list_filter(regexp_extract_all(question, '\\b([A-Z]{{2,5}})\\b', 1), lambda w: list_contains([{', '.join(repr(t) for t in _COMPANIES)}], w))) > 0 OR {' OR '.join(f"contains(lower(question), '{a}')" for own in _COMPANIES.values() for a in own)} AS known FROM eval_question),
        f AS (SELECT id, advice, len(ys) > 0 AND len(list_intersect(ys, [2022, 2023, 2024])) = 0 AS outside, NOT known AND len(nouns) > 0 AS unknown FROM q)
        SELECT id, NOT (advice OR outside) AS allowed, CAST(advice AS INT) + CAST(outside AS INT) + CAST(unknown AS INT) AS findings FROM f""",
    "reconcile_status": f"WITH {_STATUS} SELECT figure_id, new_status, round(usable_value, 2) AS usable_value FROM us",
    "reconcile_counts": f"WITH {_STATUS} SELECT metric, new_status, count(*) AS n FROM us GROUP BY ALL",
    "financials": f"""WITH {_STATUS}, one AS (SELECT ticker, year, metric, arg_max(usable_value IS NOT NULL, (extracted_at, figure_id)) AS usable FROM us GROUP BY ALL)
        SELECT ticker, year, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (usable), '') AS metrics, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT usable), '') AS unavailable FROM one GROUP BY ALL""",
    "parse_sections": rf"""SELECT id AS query_id, {rq._SECTION_OF.replace('query', 'question')} AS p_section,
        CAST(least(greatest(coalesce(f, list_max(fy), list_max(b)), 2010), 2024) AS INT) AS p_year, CASE WHEN f IS NOT NULL THEN 'filing' WHEN len(fy) > 0 THEN 'fiscal' WHEN len(b) > 0 THEN 'bare' END AS year_source
        FROM (SELECT *, CAST(nullif(regexp_extract(question, '(?i)\b((?:19|20)\d{{2}})\s+(?:(?:form\s+)?10-?k|annual\s+report)\b', 1), '') AS INT) AS f,
            list_transform(regexp_extract_all(question, '(?i)(?:fiscal(?:\s+year)?|fy)\s*((?:19|20)\d{{2}})', 1), lambda y: CAST(y AS INT)) AS fy, list_transform(regexp_extract_all(question, '\b((?:19|20)\d{{2}})\b', 1), lambda y: CAST(y AS INT)) AS b FROM eval_question)""",
    "eval_records": _A + " SELECT query_id, round(keyword_hit, 6) AS keyword_hit, ticker_hit, year_hit, section_hit, round(top1_score, 6) AS top1_score FROM runa",
    "eval_report": _grouped(_A, _REPORT, ("ticker", "difficulty", "question_type", "section")),
    "eval_failures": _A + " SELECT query_id, array_to_string(missing, '|') AS missing FROM runa WHERE keyword_hit < 0.5",
    "eval_compare": _AB + """ SELECT query_id, round(b.keyword_hit - a.keyword_hit, 6) AS delta, CASE WHEN b.keyword_hit - a.keyword_hit > 1e-9 THEN 'improved' WHEN b.keyword_hit - a.keyword_hit < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS bucket,
        array_to_string(list_filter(b.found, lambda k: NOT list_contains(a.found, k)), '|') AS now_found, array_to_string(list_filter(a.found, lambda k: NOT list_contains(b.found, k)), '|') AS now_missing, a.keyword_hit < 0.5 AND b.keyword_hit < 0.5 AS still_failing FROM runa a JOIN runb b USING (query_id)""",
    "eval_table": _A + "".join(f"{u} SELECT '{d}' AS dimension, {v} AS value, count(*) AS n, " + ", ".join(f"printf('%.1f%%', 100 * avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)) AS {n}" for c, n in (("keyword_hit = 1", "perfect"), ("keyword_hit = 0", "zero"), ("ticker_hit", "ticker_hit"), ("year_hit", "year_hit"))) + f" FROM runa {g}" for u, d, v, g in (("", "all", "'all'", ""), (" UNION ALL", "question_type", "question_type", "GROUP BY question_type"))),
    "eval_net": _AB + """, cmp AS (SELECT CASE WHEN b.keyword_hit - a.keyword_hit > 1e-9 THEN 'improved' WHEN b.keyword_hit - a.keyword_hit < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS bucket FROM runa a JOIN runb b USING (query_id))
        SELECT v.bucket, count(cmp.bucket) AS n FROM (VALUES ('improved'), ('regressed'), ('unchanged'), ('only_a'), ('only_b')) v(bucket) LEFT JOIN cmp USING (bucket) GROUP BY v.bucket""",
    "faithfulness_report": _grouped("WITH runa AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) % 6 AS k FROM eval_question) WHERE ticker IS NOT NULL AND year IS NOT NULL AND section IS NOT NULL)", _FAITH, ("question_type", "section", "ticker")),
    "ingest_totals": """WITH r AS (SELECT upper(trim(ticker, ' ')) AS ticker, filing_id, section, is_sparse, incorporated_by_reference FROM ingest WHERE ticker IS NOT NULL)
        SELECT ticker, count(DISTINCT filing_id) AS filings, count(DISTINCT (filing_id, section)) FILTER (filing_id IS NOT NULL AND section IS NOT NULL) AS sections, count(*) AS chunks, count(*) FILTER (is_sparse) AS sparse, count(*) FILTER (incorporated_by_reference) AS by_reference FROM r GROUP BY ticker
        UNION ALL SELECT 'all', count(DISTINCT filing_id), count(DISTINCT (ticker, filing_id, section)) FILTER (filing_id IS NOT NULL AND section IS NOT NULL), count(*), count(*) FILTER (is_sparse), count(*) FILTER (incorporated_by_reference) FROM r""",
    "clean_text": _CLEAN + " SELECT section_id, t AS text FROM cleaned",
    "sections_clean": _SECTIONS_CLEAN,
    "validate_ticker_fuzzy": """SELECT * FROM (VALUES (1, 'AAPL', 'none'), (2, 'AAPL', 'ticker apple -> AAPL; year FY2023 -> 2023'), (3, 'AAPL', 'ticker Apple Inc -> AAPL; year 2019 -> 2022'), (4, NULL, 'none'), (5, NULL, 'none'), (6, 'HD', 'ticker Home Depot -> HD; year 2030 -> 2024'),
        (7, 'MSFT', 'ticker Microsfot -> MSFT; year next -> none'), (8, NULL, 'ticker Tesla -> none'), (9, 'BAC', 'ticker the bank of america group -> BAC'), (10, 'GOOGL', 'none')) v(call_id, used_ticker, adjusted)""",
    "sentence_split": _SENTENCES + """ SELECT section_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM glued""",
    "chunk_pack": _SENTENCES.replace("trim(text, ' ') AS text", r"trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text") + r""",
        said AS (SELECT section_id, unnest(range(len(s))) AS i, unnest(list_transform(s, lambda x: regexp_extract_all(x, '[\p{L}\p{N}_]{1,20}|[^\p{L}\p{N}_ \t\n\r\f\v]'))) AS w FROM glued),
        parts AS (SELECT section_id, i, 0 AS k, w FROM said WHERE len(w) <= 512 UNION ALL SELECT section_id, i, k, w[k * 64 + 1:k * 64 + 64] FROM (SELECT *, unnest(range((len(w) + 63) // 64)) AS k FROM said WHERE len(w) > 512)),
        sizes AS (SELECT section_id, list(len(w) ORDER BY i, k) AS n, list(length(array_to_string(w, '')) ORDER BY i, k) AS c FROM parts GROUP BY section_id),
        sums AS (SELECT section_id, n, len(n) AS parts, [0] || list_transform(n, lambda x, j: list_sum(n[1:j])) AS s, [0] || list_transform(c, lambda x, j: list_sum(c[1:j])) AS cs FROM sizes),
        walk AS (SELECT section_id, 0 AS i, 0 AS first, 0 AS start, false AS flushed, 0 AS held FROM sums
            UNION ALL SELECT section_id, i + 1, first, start, flushed, s[i + 2] - s[first + 1] FROM (
                SELECT w.section_id, i, s, parts, start0 AS start, flushed, CASE WHEN flushed THEN coalesce(list_max(list_filter(range(first0, i), lambda j: s[i + 1] - s[j + 1] >= 64)), first0) ELSE first0 END AS first
                FROM (SELECT walk.section_id, i, s, parts, first AS first0, first AS start0, i > first AND held + n[i + 1] > 512 AS flushed FROM walk JOIN sums USING (section_id) WHERE i < parts) w)),
        ends AS (SELECT section_id, start AS a, i - 1 AS b FROM walk WHERE flushed UNION ALL SELECT section_id, first, i FROM walk JOIN sums USING (section_id) WHERE i = parts)
        SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY b) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY section_id) AS INTEGER) AS total_chunks_in_section, CAST(cs[b + 1] - cs[a + 1] AS INTEGER) AS characters FROM ends JOIN sums USING (section_id)""",
    "grounding_kinds": _KINDS + " SELECT figure_id, CASE WHEN exact THEN 'exact' WHEN same THEN 'rescaled' WHEN derived THEN 'derived' ELSE 'invented' END AS kind FROM kinds",
    "grounding_derived": _KINDS + " SELECT figure_id FROM kinds WHERE derived",
    "grounding_verdict": """SELECT * FROM (VALUES ('bare', true, 1, 0, 0, 0, 0, 'citations_missing'), ('scaled', true, 1, 0, 0, 0, 0, 'citations_missing'), ('billions', true, 0, 1, 0, 0, 0, 'citations_missing,numeric_grounding'), ('difference', true, 0, 0, 1, 0, 0, 'citations_missing'),
        ('sum', true, 0, 0, 1, 0, 0, 'citations_missing'), ('change', true, 0, 0, 1, 0, 0, 'citations_missing'), ('made_up', false, 0, 0, 0, 1, 0, 'citations_missing,numeric_grounding'), ('tenfold', false, 0, 0, 0, 1, 0, 'citations_missing,numeric_grounding'), ('year', true, 0, 0, 0, 0, 1, 'citations_missing'), ('ordinal', true, 0, 0, 0, 0, 1, 'citations_missing'),
        ('fabricated', false, 1, 0, 0, 0, 0, 'citations'), ('index', true, 1, 0, 0, 0, 0, 'citation_index'), ('good', true, 2, 0, 2, 0, 2, '')) v(id, allowed, exact, rescaled, derived, invented, skipped, rules)""",
    "validate_year": "SELECT * FROM (VALUES (1, 2023, false), (2, 2023, true), (3, 2022, true), (4, NULL, false), (5, NULL, false), (6, 2024, true), (7, NULL, true), (8, 2022, false), (9, 2024, false), (10, 2024, false)) v(call_id, used_year, adjusted_year)",
    "validate_ticker_exact": "SELECT * FROM (VALUES (1, 'AAPL'), (2, 'AAPL'), (3, 'AAPL'), (4, NULL), (5, NULL), (6, 'HD'), (8, NULL), (9, 'BAC'), (10, 'GOOGL')) v(call_id, used_ticker)",
    "line_first_match": "SELECT * FROM (VALUES ('f1', 'revenue', 1234.0::DOUBLE), ('f1', 'net_income', 8.5), ('f1', 'total_liabilities', 40.0), ('f1', 'stockholders_equity', -3.0), ('f1', 'operating_cash_flow', -12.0), ('f1', 'capital_expenditures', -7.0), ('f2', 'revenue', 10.0)) v(filing_id, metric, line_value)",
    "clean_query": rq._BASE + r""", own AS (SELECT ticker, string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) AS p FROM names WHERE alias <> '' GROUP BY ticker),
        m0 AS (SELECT q0.query_id, query, CASE WHEN p IS NULL THEN query ELSE regexp_replace(query, '(?i)\b(?:' || p || ')\b', chr(1), 'g') END AS m FROM q0 LEFT JOIN parsed USING (query_id) LEFT JOIN own ON own.ticker = p_ticker),
        m1 AS (SELECT query_id, query, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\b(?:19|20)\d{2}\s+(?:(?:form\s+)?10-?k|annual\s+report)\b', chr(1), 'g'), '(?i)(?:fiscal(?:\s+year)?|fy)\s*(?:19|20)\d{2}', chr(1), 'g'), '\b(?:19|20)\d{2}\b', chr(1), 'g'), '(?i)\b(?:last|prior|previous|this|current)\s+year\b', chr(1), 'g') AS m FROM m0),
        m2 AS (SELECT query_id, query, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)(?:\b(?:at the end of|during|for|in|of)(?:\s+the)?\s+)?(?:\x01(?:''s)?\s*)+([?])', '\1', 'g'), '\x01(?:''s)?', ' ', 'g'), '\s+', ' ', 'g'), ' ([?.,])', '\1', 'g'), ' ') AS m FROM m1)
        SELECT query_id, CASE WHEN m = '' THEN query ELSE m END AS clean_query FROM m2""",
}
