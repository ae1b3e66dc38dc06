"""Queries of the training-data operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import leakage, mixing, neardup, repeated_lines, residue, splitting
from strata.session import table

#: TESTDATA.md fixes word triples, 30 words and 0.5 for the ingest table.
INGEST_NEARDUP = neardup.NearDupConfig(shingle=3, threshold=0.5, min_words=30)


def _ingest_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ingest").select(F.col("record_id").alias("id"), "text")


def _ticker_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ingest").select(F.col("record_id").alias("record"), F.upper(F.trim("ticker")).alias("source"), "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_lines.repeated_lines(_ticker_rows(spark, sf)).occurrences()
    return found.select(F.col("record").alias("record_id"), F.col("line").alias("line_no"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ticker_rows(spark, sf)
    clean = repeated_lines.remove_lines(rows, repeated_lines.repeated_lines(rows).occurrences())
    return clean.withColumnRenamed("record", "record_id")


def p1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal repeated blocks with the place of one occurrence."""
    found = repeated_lines.repeated_lines(_ticker_rows(spark, sf)).maximal()
    return found.select(F.col("source").alias("ticker"), "lines", "records", F.col("record").alias("record_id"), F.col("line").alias("line_no"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.expand_pairs(neardup.near_duplicates(_ingest_texts(spark, sf), INGEST_NEARDUP))
    return pairs.select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = neardup.near_duplicates(_ingest_texts(spark, sf), INGEST_NEARDUP)
    return neardup.groups(found).withColumnRenamed("id", "record_id")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sections(table(spark, sf, "filing_section").select(F.col("section_id").alias("key"), "text"))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).withColumnRenamed("key", "section_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that the operator had to cut: those longer than the limit."""
    return _pieces(spark, sf).where("chunk_index = 0 and total_chunks_in_section > 1").select(F.col("key").alias("section_id"))


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each section keep to: characters besides blanks, whether all fit, overlap by at most 200, and are numbered without gaps."""
    core = F.expr("substring(text, core - start + 1)")
    blank = "[ \\t\\r\\n]"
    return _pieces(spark, sf).groupBy(F.col("key").alias("section_id")).agg(
        F.sum(F.length(F.regexp_replace(core, blank, ""))).alias("characters"), (F.max(F.length("text")) <= 2000).alias("fits"), (F.max(F.col("core") - F.col("start")) <= 200).alias("overlaps"),
        ((F.max("chunk_index") == F.count("*") - 1) & (F.countDistinct("chunk_index") == F.count("*")) & (F.min("total_chunks_in_section") == F.count("*")) & (F.max("total_chunks_in_section") == F.count("*"))).alias("numbered"),
    )


def _items(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_question")
    return q.select("id", F.lit("question").alias("part"), F.col("question").alias("text")).unionByName(q.select("id", F.lit("passage").alias("part"), F.col("passage").alias("text")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items whose longest tile has 12 words; the tiles grow from seeds of 8."""
    cfg = leakage.LeakConfig(min_match=8, min_longest=12)
    return leakage.leaks(table(spark, sf, "documents"), _items(spark, sf), cfg).select("doc_id", "id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that leaks an item's part, reordered passages too: tiles of at least 8 words that cover half of the part."""
    cfg = leakage.LeakConfig(min_match=8, min_coverage=0.5)
    return leakage.leaks(table(spark, sf, "documents"), _items(spark, sf), cfg).select("doc_id", "id", "part", "tiles", "longest", "matched", "words", F.round("coverage", 6).alias("coverage"))


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).slots


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What each source is to give of 4,000,000 characters, and what it lacks: the plan with sizes in characters, which SQL can check."""
    docs = table(spark, sf, "documents").select(F.lower(F.trim("source")).alias("source"), F.length("text").cast("bigint").alias("tokens")).where("source <> '' and tokens > 0")
    return mixing.wanted_tokens(docs, table(spark, sf, "mix_target"), mixing.MixConfig(total_tokens=4_000_000)).drop("target_share")


def _hosted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("host"), "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_hosted(spark, sf)).select(F.col("id").alias("doc_id"))


def p8_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_hosted(spark, sf)).withColumnRenamed("id", "doc_id")


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without the residue."""
    return table(spark, sf, "documents").join(p8_found(spark, sf), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p1_blocks": p1_blocks,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_checks": p2_checks,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_plan": p7_plan,
    "p8_found": p8_found,
    "p8_evidence": p8_evidence,
    "p8_kept": p8_kept,
}
_P1_CASES = r"""
    WITH lines AS (
        SELECT record_id, upper(trim(ticker, ' ')) AS source, text,
               unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM ingest WHERE ticker IS NOT NULL AND text IS NOT NULL),
    normal AS (
        SELECT record_id, source, line_no,
               trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), ' ') AS form
        FROM lines),
    held AS (SELECT source, count(DISTINCT record_id) AS n FROM lines GROUP BY source),
    spread AS (
        SELECT source, form, count(DISTINCT record_id) AS n FROM normal WHERE length(form) >= 20 GROUP BY source, form),
    cases AS (
        SELECT source, form FROM spread JOIN held USING (source) WHERE spread.n >= 6 AND spread.n >= 0.03 * held.n)
"""
_P5_PAIRS = r"""
    WITH RECURSIVE words AS (
        SELECT record_id, w FROM (SELECT record_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM ingest WHERE text IS NOT NULL) WHERE len(w) >= 30),
    grams AS (SELECT DISTINCT record_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS gram FROM (SELECT record_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    sizes AS (SELECT record_id, count(*) AS n FROM grams GROUP BY record_id),
    common AS (SELECT x.record_id AS a, y.record_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.gram = y.gram AND x.record_id < y.record_id GROUP BY ALL),
    pairs AS (SELECT a, b FROM common c JOIN sizes x ON x.record_id = a JOIN sizes y ON y.record_id = b WHERE c.n >= 0.5 * (x.n + y.n - c.n))
"""
SQL: dict[str, str] = {
    "p1_found": _P1_CASES + """
    SELECT record_id, CAST(line_no AS INTEGER) AS line_no FROM normal JOIN cases USING (source, form)""",
    "p1_clean": _P1_CASES + """,
    gone AS (SELECT record_id, list(line_no) AS gone FROM normal JOIN cases USING (source, form) GROUP BY record_id)
    SELECT record_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(
        list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
    FROM ingest LEFT JOIN gone USING (record_id)""",
    "p1_blocks": _P1_CASES + """,
    forms AS (SELECT record_id, source, list(CASE WHEN length(form) >= 20 THEN form END ORDER BY line_no) AS f FROM normal GROUP BY ALL),
    starts AS (SELECT record_id, source, f, unnest(range(1, len(f) + 1)) AS i FROM forms),
    windows AS (SELECT record_id, source, i, f[i:i + l - 1] AS block FROM (SELECT *, unnest(range(1, len(f) - i + 2)) AS l FROM starts)),
    blocks AS (
        SELECT source, block, count(DISTINCT record_id) AS records, min((record_id, i - 1)) AS place FROM windows
        WHERE len(list_filter(block, lambda x: x IS NULL)) = 0 GROUP BY source, block),
    often AS (SELECT blocks.* FROM blocks JOIN held USING (source) WHERE records >= 6 AND records >= 0.03 * n),
    inside AS (SELECT source, block[1:len(block) - 1] AS block FROM often UNION SELECT source, block[2:] FROM often)
    SELECT source AS ticker, CAST(len(block) AS INTEGER) AS lines, records, place[1] AS record_id, CAST(place[2] AS INTEGER) AS line_no FROM often ANTI JOIN inside USING (source, block)""",
    "p2_found": r"""SELECT section_id FROM filing_section WHERE length(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) > 2000""",
    "p2_checks": r"""
    SELECT section_id, length(regexp_replace(text, '[ \t\r\n]', '', 'g')) AS characters, true AS fits, true AS overlaps, true AS numbered
    FROM filing_section WHERE length(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) > 0""",
    "p5_found": _P5_PAIRS + "SELECT a AS record_id_a, b AS record_id_b FROM pairs",
    "p5_groups": _P5_PAIRS + """,
    classes AS (SELECT record_id, min(record_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM words),
    links AS (SELECT a, b FROM pairs WHERE a IN (SELECT class_id FROM classes) AND b IN (SELECT class_id FROM classes)),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT DISTINCT class_id AS id, class_id AS root FROM classes UNION SELECT b, root FROM reach JOIN ends ON a = id)
    SELECT record_id, class_id, group_id, coalesce(n, 0) AS links FROM classes JOIN (SELECT id AS class_id, min(root) AS group_id FROM reach GROUP BY id) USING (class_id)
        LEFT JOIN (SELECT a AS class_id, count(*) AS n FROM ends GROUP BY a) USING (class_id)""",
    "p7_plan": r"""
    WITH have AS (SELECT lower(trim(source, ' ')) AS source, count(*) AS documents, sum(length(text)) AS available FROM documents WHERE length(text) > 0 GROUP BY ALL),
    due AS (
        SELECT t.source, max_repeats, coalesce(documents, 0) AS documents, CAST(coalesce(available, 0) AS BIGINT) AS available,
               CAST(floor(4000000.0::DOUBLE * target_share / (SELECT sum(target_share) FROM mix_target)) AS BIGINT) AS due
        FROM mix_target t LEFT JOIN have USING (source))
    SELECT source, max_repeats, documents, available, least(due, available * max_repeats) AS wanted, greatest(due - available * max_repeats, 0) AS short FROM due""",
    "p6_found": r"""
    WITH words AS (
        SELECT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w
        FROM (SELECT id, question AS t FROM eval_question UNION ALL SELECT id, passage FROM eval_question) WHERE t IS NOT NULL),
    seeds AS (
        SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM words)),
    docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs))
    SELECT DISTINCT doc_id, id FROM grams JOIN seeds USING (gram)""",
}
