"""Search queries over the ingest table, for all questions of eval_question at once.

Chunks and questions are embedded by the built-in encoder. Index and vectors are made once for a state of the table and kept in the shared folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.operators import dense, fusion, lexical, predicates, questions
from strata.session import ensure_checkpoint_dir, spread, table
from strata.settings import Settings

CFG = Settings(years=tuple(range(2010, 2025)))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ingest").select(F.col("record_id").alias("key"), "text", "ticker", "year", "section", "is_sparse", "incorporated_by_reference")


def _state(spark: SparkSession, path: str) -> str:
    """Changes whenever the files under the path do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size, changed = fs.getContentSummary(at), fs.getFileStatus(at)
    return hashlib.sha1(f"{changed.getPath()} {changed.getModificationTime()} {size.getLength()} {size.getFileCount()}".encode()).hexdigest()


_HELD: dict[str, lexical.Index] = {}


def index(spark: SparkSession, sf: str) -> lexical.Index:
    """The stored index of the ingest table with vectors; written at first use."""
    path = f"{ensure_checkpoint_dir(spark)}/index-{_state(spark, f'{sf}/ingest.parquet')}"
    if path not in _HELD:
        _HELD[path] = lexical.write(dense.embed(spread(corpus(spark, sf)), "text", "embedding"), path, CFG)
    return _HELD[path]


def asked(spark: SparkSession, sf: str, scoped: bool = False) -> DataFrame:
    q = table(spark, sf, "eval_question").select(F.col("id").alias("query_id"), F.col("question").alias("query"), "ticker", "year")
    if scoped:
        q = q.withColumn("q_ticker", F.col("ticker")).withColumn("q_year", F.col("year"))
    return dense.embed(q.drop("ticker", "year"), "query", "query_vector")


def company_names(spark: SparkSession, sf: str) -> dict[str, list[str]]:
    """Symbols with the names of their companies: one entry a covered company, read through the driver."""
    f = table(spark, sf, "filings").select(F.upper(F.trim("ticker")).alias("ticker"), F.regexp_replace(F.lower(F.trim("company")), r"[.\s]+$", "").alias("name")).where("ticker <> ''")
    rows = f.groupBy("ticker").agg(F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name")))).alias("names")).collect()
    return {r["ticker"]: r["names"] for r in sorted(rows, key=lambda r: r["ticker"])}


def _parse(spark: SparkSession, sf: str):
    names = company_names(spark, sf)
    return lambda q: questions.parse_questions(q, CFG, aliases=names, offsets={})


def _hits(df: DataFrame, score: str = "score") -> DataFrame:
    return df.select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round(score, 4).alias("score"))


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ingest").select("record_id", F.size(tx.tokenize(F.col("text"))).alias("tokens"))


def exact_count(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that an unscoped search may see, and all."""
    seen = F.count_if(predicates.scope())
    return corpus(spark, sf).agg(F.count("*").alias("chunks"), seen.alias("searched"))


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.build(corpus(spark, sf)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def _lexical(spark: SparkSession, sf: str, n: int, scoped: bool = False, **flags: bool) -> DataFrame:
    return lexical.search(corpus(spark, sf), asked(spark, sf, scoped), n, CFG, index(spark, sf), **flags)


def bm25_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(_lexical(spark, sf, 10, exclude_sparse=False, exclude_by_reference=False))


def bm25_topn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(_lexical(spark, sf, 10, True))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(dense.search(index(spark, sf).docs, asked(spark, sf), 5, exclude_sparse=False, exclude_by_reference=False))


def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(dense.search(index(spark, sf).docs, asked(spark, sf, True), 5))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors: every vec_id divisible by 20 against all rows."""
    v = table(spark, sf, "embeddings")
    rows = v.select(F.col("vec_id").alias("key"), "embedding", F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("is_sparse"), F.lit(False).alias("incorporated_by_reference"))
    return _hits(dense.search(rows, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5))


def hybrid_v2(spark: SparkSession, sf: str) -> DataFrame:
    found = fusion.hybrid(corpus(spark, sf), asked(spark, sf), 5, CFG, index(spark, sf))
    return found.select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.array_join("retrievers", ",").alias("retrievers"))


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    lists = fusion.ranked_lists(dense=dense.search(index(spark, sf).docs, asked(spark, sf), 50), lexical=_lexical(spark, sf, 50))
    return fusion.reciprocal_rank_fusion(lists, 5, CFG, {"lexical": 0.5}).select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


def fusion_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.agreement(fusion.hybrid(corpus(spark, sf), asked(spark, sf), 20, CFG, index(spark, sf)))


def parse_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _parse(spark, sf)(asked(spark, sf)).select("query_id", "p_ticker", "p_year")


def _search(spark: SparkSession, sf: str, version: str, queries: DataFrame | None = None, **options: bool) -> DataFrame:
    return fusion.search(corpus(spark, sf), asked(spark, sf) if queries is None else queries, version, 5, CFG, parse=_parse(spark, sf), index=index(spark, sf), **options)


def search_v3(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "v3").select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


def search_v3_section(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered by the section that the question points at as well."""
    return _search(spark, sf, "v3", use_section_filter=True).select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


def _sectioned(spark: SparkSession, sf: str, found: DataFrame, *more: str) -> DataFrame:
    return fusion.with_columns_of(found, corpus(spark, sf), ["section", *more])


def section_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A quota of half over the lexical candidates."""
    pool = _sectioned(spark, sf, _lexical(spark, sf, 50))
    return fusion.section_quota(pool, 10, 0.5).select("query_id", "key", "section", F.col("rank").cast("int").alias("rank"))


def quota_v4_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool that v4 re-ranks: 20 of 60 fused results, at most half of one section while others are left."""
    scoped = _parse(spark, sf)(lexical.with_scope(asked(spark, sf))).withColumn("q_ticker", F.col("p_ticker")).withColumn("q_year", F.col("p_year"))
    pool = _sectioned(spark, sf, fusion.hybrid(corpus(spark, sf), scoped, 60, CFG, index(spark, sf)))
    return fusion.section_quota(pool, 20, CFG.quota_share).select("query_id", "key", "section", F.col("rank").cast("int").alias("rank"))


def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    pool = _sectioned(spark, sf, _lexical(spark, sf, 20), "text").join(asked(spark, sf).select("query_id", "query"), "query_id")
    return fusion.rerank(pool, None, 5).select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.col("pre_rank").cast("int").alias("pre_rank"), F.round("rerank_score", 6).alias("rerank_score"))


def search_v4(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "v4").select("query_id", "key", F.col("rank").cast("int").alias("rank"), F.round("rerank_score", 6).alias("rerank_score"))


def rescued(spark: SparkSession, sf: str) -> DataFrame:
    """What re-ranking changed in v4: results from beyond the first five."""
    return fusion.rescued(_search(spark, sf, "v4"), 5).select("query_id", "promoted", F.col("deepest").cast("int").alias("deepest"), F.array_join(F.col("from_ranks").cast("array<string>"), ",").alias("from_ranks"))


def relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.floor_status(_search(spark, sf, "v4"), asked(spark, sf))


QUERIES = {f.__name__: f for f in (
    hybrid_v2, tokenize_counts, exact_count, bm25_terms, bm25_topn, bm25_topn_filtered, dense_topk, dense_topk_filtered, vector_topk, rrf_weighted, fusion_agreement, parse_symbols, search_v3, search_v3_section, section_quota, quota_v4_pool,
    rerank_overlap, search_v4, rescued, relevance_floor,
)}

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '\$?\d+(?:[.,]\d+)*%?|[a-z]+(?:''[a-z]+)?')"
# the phrases and items of the filing form, stated here on their own
_TWIN_PHRASES = {
    "Item 7A": ["quantitative and qualitative disclosures", "interest rate sensitivity", "interest rate risk", "market risk", "sensitivity", "hedging", "derivatives", "quantitative", "qualitative"],
    "Item 1A": ["risk factors", "risks", "risk"], "Item 3": ["legal proceedings", "litigation", "lawsuit", "proceedings", "legal"], "Item 2": ["properties", "facilities", "headquarters", "locations", "stores"],
    "Item 9A": ["internal control", "internal controls", "disclosure controls", "controls and procedures"], "Item 8": ["financial statements", "balance sheet", "cash flow", "cash flows", "notes to the financial statements"],
    "Item 7": ["management's discussion", "management discussion", "md&a", "financial condition", "financial results", "gross margin", "operating income", "net income", "revenues", "revenue", "earnings", "expenses", "margin", "profit", "income", "sales"],
    "Item 1": ["business", "operations", "overview", "segments", "products", "employees"],
}
_TWIN_ITEMS = ["1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16"]
_NAMED_ITEM = r"upper(regexp_replace(regexp_extract(query, '(?i)\bitem\s+(\d{1,2}\s*[a-c]?)\b', 1), '\s+', ''))"
_SECTION_OF = (
    f"CASE WHEN {_NAMED_ITEM} IN ({', '.join(repr(i) for i in _TWIN_ITEMS)}) THEN 'Item ' || {_NAMED_ITEM} "
    + " ".join(f"WHEN regexp_matches(lower(query), '\\b{p.replace(chr(39), chr(39) * 2)}\\b') THEN '{i}'" for p, i in sorted(((p, i) for i, own in _TWIN_PHRASES.items() for p in own), key=lambda x: -len(x[0])))
    + " END"
)
_BASE = f"""
WITH corpus AS (SELECT record_id AS key, text, ticker, year, section, is_sparse, incorporated_by_reference FROM ingest),
q0 AS (SELECT id AS query_id, question AS query, ticker, year FROM eval_question),
docs AS (SELECT key, {_TOK.format('text')} AS tokens FROM corpus),
lens AS (SELECT key, len(tokens) AS len FROM docs),
sizes AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
dfs AS (SELECT term, count(*) AS df FROM (SELECT key, unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, sizes),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM q0) GROUP BY ALL),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
bm AS (SELECT query_id, key, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
       FROM qt JOIN idfs USING (term) JOIN tf USING (term) JOIN lens USING (key), sizes GROUP BY ALL HAVING score > 0),
dvec AS (SELECT key, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS dim, sum(CASE WHEN substr(md5(w), 5, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1 ELSE -1 END)::DOUBLE AS v
         FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM corpus WHERE text IS NOT NULL) GROUP BY ALL),
qvec AS (SELECT query_id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS dim, sum(CASE WHEN substr(md5(w), 5, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1 ELSE -1 END)::DOUBLE AS v
         FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM q0 WHERE query IS NOT NULL) GROUP BY ALL),
dots AS (SELECT query_id, key, sum(d.v * q.v) AS dot FROM dvec d JOIN qvec q USING (dim) GROUP BY ALL),
dnorm AS (SELECT key, sqrt(sum(v * v)) AS n FROM dvec GROUP BY key), qnorm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qvec GROUP BY query_id),
cs AS (SELECT query_id, key, coalesce(dot / nullif(dnorm.n * qnorm.n, 0), 0.0) AS score FROM (SELECT query_id FROM q0 WHERE query IS NOT NULL) CROSS JOIN (SELECT key FROM corpus WHERE text IS NOT NULL)
       LEFT JOIN dots USING (query_id, key) LEFT JOIN dnorm USING (key) LEFT JOIN qnorm USING (query_id)),
names AS (SELECT DISTINCT regexp_replace(lower(trim(company, ' ')), '[.\\s]+$', '') AS alias, upper(trim(ticker, ' ')) AS ticker, 0 AS kind FROM filings WHERE company IS NOT NULL AND trim(ticker, ' ') <> ''
          UNION ALL SELECT DISTINCT lower(trim(ticker, ' ')), upper(trim(ticker, ' ')), 1 FROM filings WHERE trim(ticker, ' ') <> ''),
named AS (SELECT query_id, names.ticker AS p_ticker FROM q0 JOIN names ON alias <> '' AND regexp_matches(lower(query), '\\b' || regexp_escape(alias) || '\\b')
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, strpos(lower(query), alias), kind, names.ticker) = 1),
parsed AS (SELECT q0.query_id, t.p_ticker, {_SECTION_OF} AS p_section, CAST(least(greatest(coalesce(
        CAST(nullif(regexp_extract(query, '(?i)\\b((?:19|20)\\d{{2}})\\s+(?:(?:form\\s+)?10-?k|annual\\s+report)\\b', 1), '') AS INT),
        list_max(list_transform(regexp_extract_all(query, '(?i)(?:fiscal(?:\\s+year)?|fy)\\s*((?:19|20)\\d{{2}})', 1), lambda y: CAST(y AS INT))),
        list_max(list_transform(regexp_extract_all(query, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: CAST(y AS INT)))), 2010), 2024) AS INT) AS p_year
    FROM q0 LEFT JOIN named t USING (query_id))
"""
_FLAGS = "is_sparse IS DISTINCT FROM true AND incorporated_by_reference IS DISTINCT FROM true"
_OWN = "c.ticker = q0.ticker AND c.year = q0.year"
_SECTIONED = "(p_section IS NULL OR c.section = p_section)"
_PARSED = "(p_ticker IS NULL OR c.ticker = p_ticker) AND (p_year IS NULL OR c.year = p_year)"


def _ranked(source: str, where: str, n: int) -> str:
    return f"""SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank
        FROM {source} JOIN corpus c USING (key) JOIN q0 USING (query_id) JOIN parsed USING (query_id) WHERE {where} QUALIFY rank <= {n}"""


def _fused(where: str, top: int, weight: float = 1.0) -> str:
    return f""", d AS ({_ranked('cs', where, 50)}), x AS ({_ranked('bm', where, 50)}),
fused AS (SELECT query_id, key, coalesce(1.0 / (60 + d.rank), 0) + coalesce({weight} / (60 + x.rank), 0) AS score, d.rank AS dense_rank, x.rank AS lexical_rank,
    concat_ws(',', CASE WHEN d.rank IS NOT NULL THEN 'dense' END, CASE WHEN x.rank IS NOT NULL THEN 'lexical' END) AS retrievers,
    FROM d FULL JOIN x USING (query_id, key)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, key) AS rank FROM fused QUALIFY rank <= {top})
"""


def _quota(pool: str, n: int) -> str:
    return f"""(SELECT * EXCLUDE (rank, s), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY rank) AS s FROM {pool})
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s > {n // 2}, rank) <= {n}))"""


def _reranked(pool: str, top: int) -> str:
    q, t = (f"list_distinct({_TOK.format(c)})" for c in ("query", "text"))
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, pre_rank) AS rank FROM (
        SELECT p.query_id, p.key, p.rank AS pre_rank, CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {t})) / len({q}) END AS rerank_score
        FROM {pool} p JOIN corpus USING (key) JOIN q0 USING (query_id)) QUALIFY rank <= {top})"""


_HITS = "SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM "
_V4 = _BASE + _fused(f"{_FLAGS} AND {_PARSED}", 60) + ", pool AS (SELECT top.query_id, top.key, top.rank, c.section FROM top JOIN corpus c USING (key)), v4 AS (SELECT * FROM " + _reranked(_quota("pool", 20), 5) + ")"
SQL = {
    "hybrid_v2": _BASE + _fused(_FLAGS, 5) + "SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 9) AS score, CAST(coalesce(dense_rank, 0) AS INT) AS dense_rank, CAST(coalesce(lexical_rank, 0) AS INT) AS lexical_rank, retrievers FROM top",
    "tokenize_counts": f"SELECT record_id, CAST(len({_TOK.format('text')}) AS INT) AS tokens FROM ingest",
    "exact_count": f"SELECT count(*) AS chunks, count(*) FILTER ({_FLAGS}) AS searched FROM ingest",
    "bm25_terms": _BASE + "SELECT term, df, round(idf, 9) AS idf FROM idfs",
    "bm25_topn": _BASE + _HITS + f"({_ranked('bm', 'true', 10)})",
    "bm25_topn_filtered": _BASE + _HITS + f"({_ranked('bm', f'{_FLAGS} AND {_OWN}', 10)})",
    "dense_topk": _BASE + _HITS + f"({_ranked('cs', 'true', 5)})",
    "dense_topk_filtered": _BASE + _HITS + f"({_ranked('cs', f'{_FLAGS} AND {_OWN}', 5)})",
    "vector_topk": """SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM (
        SELECT q.vec_id AS query_id, v.vec_id AS key, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(score, 9) DESC, v.vec_id) AS rank
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5)""",
    "rrf_weighted": _BASE + _fused(_FLAGS, 5, 0.5) + "SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM top",
    "fusion_agreement": _BASE + _fused(_FLAGS, 20) + "SELECT query_id, count(*) AS hits, count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS agreed FROM top GROUP BY query_id",
    "parse_symbols": _BASE + "SELECT query_id, p_ticker, p_year FROM parsed",
    "search_v3": _BASE + _fused(f"{_FLAGS} AND {_PARSED}", 5) + "SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM top",
    "search_v3_section": _BASE + _fused(f"{_FLAGS} AND {_PARSED} AND {_SECTIONED}", 5) + "SELECT query_id, key, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM top",
    "quota_v4_pool": _BASE + _fused(f"{_FLAGS} AND {_PARSED}", 60) + f", pool AS (SELECT top.query_id, top.key, top.rank, c.section FROM top JOIN corpus c USING (key)) SELECT query_id, key, section, CAST(rank AS INT) AS rank FROM {_quota('pool', 20)}",
    "rescued": _V4 + " SELECT query_id, count(*) FILTER (pre_rank > 5) AS promoted, CAST(max(pre_rank) AS INT) AS deepest, string_agg(pre_rank, ',' ORDER BY rank) AS from_ranks FROM v4 GROUP BY query_id",
    "section_quota": _BASE + f", pool AS (SELECT r.query_id, r.key, r.rank, c.section FROM ({_ranked('bm', _FLAGS, 50)}) r JOIN corpus c USING (key)) SELECT query_id, key, section, CAST(rank AS INT) AS rank FROM {_quota('pool', 10)}",
    "rerank_overlap": _BASE + f", pool AS ({_ranked('bm', _FLAGS, 20)}) SELECT query_id, key, CAST(rank AS INT) AS rank, CAST(pre_rank AS INT) AS pre_rank, round(rerank_score, 6) AS rerank_score FROM {_reranked('pool', 5)}",
    "search_v4": _V4 + " SELECT query_id, key, CAST(rank AS INT) AS rank, round(rerank_score, 6) AS rerank_score FROM v4",
    "relevance_floor": _V4 + """ SELECT query_id, count(*) FILTER (rerank_score >= 0.3) AS kept, count(*) FILTER (rerank_score < 0.3) AS dropped,
        CASE WHEN kept > 0 THEN 'results' WHEN dropped > 0 THEN 'below_floor' ELSE 'none' END AS status FROM q0 LEFT JOIN v4 USING (query_id) GROUP BY query_id""",
}
