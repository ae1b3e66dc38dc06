"""BM25 over a corpus (key, text, ...). Statistics always cover the whole corpus; filters drop rows before they are scored.

The index is partitioned by document: every task scores its own documents for all queries of a block (term weights of the documents times term
weights of the queries) and keeps the best n of each query, so that tasks x queries x n rows are shuffled, whatever the size of the corpus. It can be
written once, read by any number of searches, and appended to.

Cases: null text is a document without tokens; null or empty queries match nothing; repeated query terms count as often; an empty corpus gives no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import tokenize
from strata.operators.predicates import scope
from strata.operators.topn import TopN, scope_masks
from strata.session import query_blocks
from strata.settings import Settings

#: scope columns that go with the documents
META = ("ticker", "year", "section", "is_sparse", "incorporated_by_reference")
#: cells of a block of term weights
CELLS = 4_000_000


@dataclass
class Index:
    """docs: (key, tokens, len, scope columns and an embedding if the corpus has them); terms: (term, df, idf); stats: one row (n, avg_len, mean_idf)."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def _documents(corpus: DataFrame) -> DataFrame:
    kept = [c for c in (*META, "embedding") if c in corpus.columns]
    return corpus.select("key", tokenize(F.col("text")).alias("tokens"), *kept).withColumn("len", F.size("tokens"))


def _frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _index(docs: DataFrame, cfg: Settings, df: DataFrame | None = None) -> Index:
    sizes = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = _frequencies(docs) if df is None else df
    raw = df.join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, F.lit(cfg.bm25_epsilon) * F.col("mean_idf")).otherwise(F.col("raw"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))
    return Index(docs, terms, sizes.join(F.broadcast(mean)))


def build(corpus: DataFrame, cfg: Settings = Settings()) -> Index:
    """Index of (key, text), computed anew wherever it is used."""
    return _index(_documents(corpus), cfg)


def write(corpus: DataFrame, path: str, cfg: Settings = Settings(), mode: str = "overwrite") -> Index:
    """Index of a corpus, stored: documents sorted by ticker and year inside each file, so that scoped searches skip row groups."""
    docs = _documents(corpus)
    order = [c for c in ("ticker", "year") if c in docs.columns]
    (docs.sortWithinPartitions(*order) if order else docs).write.mode(mode).parquet(f"{path}/docs")
    spark = corpus.sparkSession
    held = spark.read.parquet(f"{path}/docs")
    # counted once; the weights and their mean are read from it
    _frequencies(held).write.mode("overwrite").parquet(f"{path}/frequencies")
    made = _index(held, cfg, spark.read.parquet(f"{path}/frequencies"))
    made.terms.write.mode("overwrite").parquet(f"{path}/terms")
    made.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return load(spark, path)


def append(corpus: DataFrame, path: str, cfg: Settings = Settings()) -> Index:
    """Adds documents of new keys to a stored index; only the new texts are read, the statistics are recomputed from the stored tokens."""
    return write(corpus, path, cfg, mode="append")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("docs", "terms", "stats")))


def top(scored: DataFrame, n: int, score: str = "score", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The n best per query with a 1-based rank; scores equal to nine places rank by key. Spark limits each group before it shuffles."""
    order: list[Column] = [F.round(F.col(score), 9).desc(), *[F.col(k) for k in keys]]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def scoped(docs: DataFrame, block: list, **flags: bool) -> DataFrame:
    """Documents that at least one query of the block may see, as far as flags, tickers and years say so before the scan."""
    docs = docs.where(scope(**flags))
    for column in ("ticker", "year"):
        wanted = {r[f"q_{column}"] for r in block}
        if None not in wanted:
            docs = docs.where(F.col(column).isin(*wanted))
    return docs


def _score(docs: DataFrame, block: list, idf: dict[str, float], avg_len: float, n: int, kind: str, cfg: Settings) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in block for t in r["tokens"] if t in idf}))}
    weights = np.zeros((len(vocabulary), len(block)))
    for q, r in enumerate(block):
        for t in r["tokens"]:
            if t in vocabulary:
                weights[vocabulary[t], q] += idf[t]
    shared = spark.sparkContext.broadcast((vocabulary, weights, [r["query_id"] for r in block], [(r["q_ticker"], r["q_year"], r["q_section"]) for r in block]))
    k1, b = cfg.bm25_k1, cfg.bm25_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, ids, scopes = shared.value
        best = TopN(len(ids), n)
        step = max(1, CELLS // max(1, len(words)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                tokens = batch.column("tokens")
                flat = tokens.flatten().dictionary_encode()
                of_word = np.array([words.get(t, -1) for t in flat.dictionary.to_pylist()], dtype=np.int64)
                term = of_word[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, dtype=np.int64)
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                hit = term >= 0
                tf = np.bincount(row[hit] * len(words) + term[hit], minlength=batch.num_rows * len(words)).reshape(batch.num_rows, len(words)).astype(np.float64)
                size = batch.column("len").to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                scores = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg_len))) @ weight
                columns = {c: np.array(batch.column(c).to_pylist(), dtype=object) for c in ("ticker", "year", "section")}
                best.add(batch.column("key").to_numpy(zero_copy_only=False), scores, scope_masks(columns, scopes), above=0.0)
        yield pa.RecordBatch.from_pandas(best.frame(ids), schema=schema, preserve_index=False)

    schema = pa.schema([("query_id", pa.string() if kind == "string" else pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    return docs.select("key", "tokens", "len", "ticker", "year", "section").mapInArrow(run, f"query_id {kind}, key bigint, score double")


def search(corpus: DataFrame, queries: DataFrame, n: int | None = None, cfg: Settings = Settings(), index: Index | None = None, exclude_sparse: bool = True, exclude_by_reference: bool = True) -> DataFrame:
    """(query_id, key, score, rank), positive scores only. queries: (query_id, query), a stated set, with optional q_ticker, q_year, q_section."""
    index, n = index or build(corpus, cfg), n or cfg.lexical_candidates
    asked = with_scope(queries).select("query_id", tokenize(F.col("query")).alias("tokens"), "q_ticker", "q_year", "q_section")
    kind = dict(queries.dtypes)["query_id"]
    avg_len = index.stats.first()["avg_len"]
    out = None
    for block in query_blocks(asked):
        wanted = sorted({t for r in block for t in r["tokens"]})
        # the terms of one block of queries, of which each has at most one row here
        idf = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(*wanted)).select("term", "idf").collect()} if wanted else {}
        if idf and avg_len:
            found = _score(scoped(index.docs, block, exclude_sparse=exclude_sparse, exclude_by_reference=exclude_by_reference), block, idf, avg_len, n, kind, cfg)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"query_id {kind}, key bigint, score double")
    return top(out, n).select("query_id", "key", "score", "rank")


def with_scope(queries: DataFrame) -> DataFrame:
    for name, kind in (("q_ticker", "string"), ("q_year", "int"), ("q_section", "string")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries
