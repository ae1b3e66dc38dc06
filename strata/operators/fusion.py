"""Rank fusion, section quota, re-ranking and the four stacked searches; always for a whole set of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import tokenize
from strata.operators import dense, lexical
from strata.session import cut, small_side
from strata.settings import Settings


def ranked_lists(**lists: DataFrame) -> DataFrame:
    """Long form (query_id, key, list, rank, score) of named ranked lists."""
    out = None
    for name, df in lists.items():
        one = df.select("query_id", "key", F.lit(name).alias("list"), "rank", "score")
        out = one if out is None else out.unionByName(one)
    return out


def reciprocal_rank_fusion(lists: DataFrame, top_k: int, cfg: Settings = Settings(), weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank) over the lists; ties by dense rank, then lexical rank, then key. Other list names may be used as well."""
    weights = weights if weights is not None else {"lexical": cfg.lexical_weight}
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col("list") == name, F.lit(float(x))).otherwise(w)
    pick = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    fused = lists.groupBy("query_id", "key").agg(
        F.sum(w / (F.lit(cfg.rrf_k) + F.col("rank"))).alias("score"), pick("dense", "rank").alias("dense_rank"), pick("dense", "score").alias("dense_score"),
        pick("lexical", "rank").alias("lexical_rank"), pick("lexical", "score").alias("lexical_score"), F.array_sort(F.collect_set("list")).alias("retrievers"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "key")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def agreement(fused: DataFrame) -> DataFrame:
    """(query_id, hits, agreed): how many results more than one list named."""
    return fused.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.size("retrievers") > 1).alias("agreed"))


def section_quota(pool: DataFrame, n: int, share: float) -> DataFrame:
    """n results per query of (query_id, section, rank): at most max(1, int(n * share)) of a section while others are left, overflow fills up; new ranks in old order."""
    cap = max(1, int(n * share))
    s = F.row_number().over(Window.partitionBy("query_id", "section").orderBy("rank"))
    picked = pool.withColumn("_over", s > cap).withColumn("_pick", F.row_number().over(Window.partitionBy("query_id").orderBy("_over", "rank"))).where(F.col("_pick") <= n)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("_over", "_pick")


Scorer = Callable[[list[str], list[str]], list[float]]


def rerank(candidates: DataFrame, scorer: Callable[[], Scorer] | None, top_k: int, batch: int = 32) -> DataFrame:
    """Re-score (query, text) of already limited candidates; ties keep the earlier rank. None: share of query words that the text holds (built-in)."""
    if scorer is None:
        q, t = F.array_distinct(tokenize(F.col("query"))), F.array_distinct(tokenize(F.col("text")))
        scored = candidates.withColumn("rerank_score", F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q)))
    else:

        @F.pandas_udf(T.DoubleType())
        def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = scorer()
            for q, t in it:
                yield pd.Series([x for at in range(0, len(q), batch) for x in model(list(q[at : at + batch].fillna("")), list(t[at : at + batch].fillna("")))], dtype="float64")

        scored = candidates.withColumn("rerank_score", run(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), "rank")
    return scored.withColumn("pre_rank", F.col("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def hybrid(corpus: DataFrame, queries: DataFrame, top_k: int, cfg: Settings = Settings(), index: lexical.Index | None = None, **flags: bool) -> DataFrame:
    """v2: fused vector and lexical candidates. queries: (query_id, query, query_vector, optional q_ticker, q_year, q_section).

    A stored index that holds the vectors serves both arms; the corpus is then not read.
    """
    d = dense.search(index.docs if index and "embedding" in index.docs.columns else corpus, queries, cfg.dense_candidates, cfg, **flags)
    x = lexical.search(corpus, queries, cfg.lexical_candidates, cfg, index, **flags)
    return reciprocal_rank_fusion(ranked_lists(dense=d, lexical=x), top_k, cfg)


def with_columns_of(found: DataFrame, corpus: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the corpus for found rows (query_id, key, ...): at most queries x n rows, cut and sent to the scan as long as they are few."""
    return corpus.select("key", *columns).join(small_side(cut(found)), "key")


def search(
    corpus: DataFrame, queries: DataFrame, version: str = "v1", top_k: int | None = None, cfg: Settings = Settings(), scorer: Callable[[], Scorer] | None = None, candidates: int | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None, index: lexical.Index | None = None, use_section_filter: bool = False, use_clean_query: bool = False, **flags: bool,
) -> DataFrame:
    """Dispatcher. v1 vectors; v2 hybrid; v3 hybrid scoped by the parsed question (explicit q_ columns win); v4 v3 with quota and re-ranking.

    `candidates` only reaches v4. An unknown version is an error. `parse` adds p_ticker, p_year, p_section and clean_query to the queries. v3 and v4 can also filter by the
    parsed section and search with the cleaned question (re-ranking always reads the original one); the vector of a question is then the caller's to choose.
    """
    top_k = top_k or cfg.top_k
    if version == "v1":
        return dense.search(corpus, queries, top_k, cfg, **flags)
    if version == "v2":
        return hybrid(corpus, queries, top_k, cfg, index, **flags)
    if version not in ("v3", "v4"):
        raise ValueError(f"unknown search version {version!r}; known: v1, v2, v3, v4")
    from strata.operators.questions import parse_questions

    explicit = lexical.with_scope(queries)
    parsed = (parse or parse_questions)(explicit)
    scoped = parsed.withColumn("q_ticker", F.coalesce("q_ticker", "p_ticker")).withColumn("q_year", F.coalesce("q_year", "p_year"))
    if use_section_filter:
        scoped = scoped.withColumn("q_section", F.coalesce("q_section", "p_section"))
    if use_clean_query:
        scoped = scoped.withColumn("query", F.col("clean_query"))
    if version == "v3":
        return hybrid(corpus, scoped, top_k, cfg, index, **flags)
    n = max(candidates or cfg.rerank_candidates, top_k)
    free = hybrid(corpus, scoped, n * cfg.quota_pool_factor if cfg.quota_share < 1 else n, cfg, index, **flags)
    asked = explicit.select("query_id", "query", F.col("q_section").isNotNull().alias("pinned"))
    named = with_columns_of(free, corpus, ["section", "text"]).join(asked, "query_id")
    pinned = named.where(F.col("pinned") & (F.col("rank") <= n))
    open_ = named.where(~F.col("pinned"))
    pool = (section_quota(open_, n, cfg.quota_share) if cfg.quota_share < 1 else open_.where(F.col("rank") <= n)).unionByName(pinned)
    return rerank(pool, scorer, top_k)


def rescued(reranked: DataFrame, top_k: int) -> DataFrame:
    """(query_id, promoted, deepest, from_ranks): results whose rank before re-ranking was beyond top_k, and all ranks before in the new order."""
    ranks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pre_rank"))), lambda r: r["pre_rank"])
    return reranked.groupBy("query_id").agg(F.count_if(F.col("pre_rank") > top_k).alias("promoted"), F.max("pre_rank").alias("deepest"), ranks.alias("from_ranks"))
