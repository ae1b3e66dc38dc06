"""Scoring whole question sets, comparing runs, and answer faithfulness; each report is one pass with grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import normalize
from strata.operators.guard import check_answers
from strata.settings import Settings


def records(results: DataFrame, questions: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row per question: share of its keywords in the retrieved texts, and whether its ticker, year and section were hit.

    results: (query_id, rank, score, ticker, year, section, text), already limited to top-k. A question without results scores 0; without keywords null.
    latencies: (query_id, latency_ms) where they were measured. retrieved lists what came back, in order.
    """
    got = results.groupBy("query_id").agg(
        normalize(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), " ")).alias("hay"),
        F.collect_set("ticker").alias("tickers"), F.collect_set("year").alias("years"), F.collect_set("section").alias("sections"), F.max_by("score", -F.col("rank")).alias("top1_score"),
        F.array_sort(F.collect_list(F.struct("rank", "ticker", "year", "section", "score", "text"))).alias("retrieved"),
    )
    q = questions.select(F.col("id").alias("query_id"), "ticker", "year", "section", "question_type", "difficulty", "answer_keywords")
    q = q.join(latencies, "query_id", "left") if latencies is not None else q.withColumn("latency_ms", F.lit(None).cast("double"))
    both = q.join(got, "query_id", "left").withColumn("hay", F.coalesce("hay", F.lit("")))
    found = F.filter("answer_keywords", lambda k: F.contains(F.col("hay"), normalize(k)))
    hit = lambda c, s: F.coalesce(F.array_contains(s, F.col(c)), F.lit(False))
    return both.withColumn("found", found).select(
        "query_id", "ticker", "section", "question_type", "difficulty", "found", F.array_except("answer_keywords", "found").alias("missing"),
        F.when(F.size("answer_keywords") > 0, F.size("found") / F.size("answer_keywords")).alias("keyword_hit"),
        hit("ticker", "tickers").alias("ticker_hit"), hit("year", "years").alias("year_hit"), hit("section", "sections").alias("section_hit"), F.coalesce("top1_score", F.lit(0.0)).alias("top1_score"), "latency_ms", F.coalesce(F.size("retrieved"), F.lit(0)).alias("num_results"), "retrieved",
    )


def _rate(c) -> object:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def report(scored: DataFrame, dimensions: tuple[str, ...] = ("ticker", "difficulty", "question_type", "section")) -> DataFrame:
    """(dimension, value, n, rates): the total and each single grouping in one pass."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    grouped = scored.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count("*").alias("n"), F.avg("keyword_hit").alias("keyword_hit"), _rate(F.col("keyword_hit") == 1).alias("perfect"), _rate(F.col("keyword_hit") == 0).alias("zero"),
        _rate(F.col("ticker_hit")).alias("ticker_hit"), _rate(F.col("year_hit")).alias("year_hit"), _rate(F.col("section_hit")).alias("section_hit"), F.avg("top1_score").alias("top1_score"), F.avg("latency_ms").alias("latency_ms"), F.grouping_id().alias("gid"),
    )
    full = (1 << len(dimensions)) - 1
    name, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dimensions):
        gid = full ^ (1 << (len(dimensions) - 1 - i))
        name, value = F.when(F.col("gid") == gid, F.lit(d)).otherwise(name), F.when(F.col("gid") == gid, F.col(d).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n", "keyword_hit", "perfect", "zero", "ticker_hit", "year_hit", "section_hit", "top1_score", "latency_ms")


def failures(scored: DataFrame, below: float = 0.5) -> DataFrame:
    return scored.where(F.col("keyword_hit") < below)


def compare(a: DataFrame, b: DataFrame, below: float = 0.5) -> DataFrame:
    """(query_id, a, b, delta, bucket, now_found, now_missing, still_failing) of two runs; questions of one run only are bucketed as such."""
    x = a.select("query_id", F.col("keyword_hit").alias("a"), F.col("found").alias("fa"))
    y = b.select("query_id", F.col("keyword_hit").alias("b"), F.col("found").alias("fb"))
    both = x.join(y, "query_id", "full_outer").withColumn("delta", F.col("b") - F.col("a"))
    bucket = (
        F.when(F.col("fa").isNull(), "only_b").when(F.col("fb").isNull(), "only_a").when(F.col("delta") > 1e-9, "improved").when(F.col("delta") < -1e-9, "regressed").otherwise("unchanged")
    )
    return both.select("query_id", "a", "b", "delta", bucket.alias("bucket"), F.array_except("fb", "fa").alias("now_found"), F.array_except("fa", "fb").alias("now_missing"), ((F.col("a") < below) & (F.col("b") < below)).alias("still_failing"))


def net(compared: DataFrame) -> DataFrame:
    """(bucket, n) of a comparison; buckets without questions come with 0."""
    names = compared.sparkSession.createDataFrame([(b,) for b in ("improved", "regressed", "unchanged", "only_a", "only_b")], "bucket string")
    return names.join(compared.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").na.fill(0, ["n"])


def judge(runs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Answers put to the checks: (id, ..., error, faithful, counts, findings) of runs with answer, error, grounded and retrieved. A run with an error is kept and not judged."""
    checked = check_answers(runs.withColumn("answer", F.coalesce("answer", F.lit(""))), cfg)
    ok = F.col("error").isNull()
    kept = [c for c in ("id", "question", "ticker", "year", "section", "question_type", "difficulty", "error", "answer") if c in runs.columns]
    return checked.select(*kept, F.when(ok, F.col("allowed")).alias("faithful"), F.when(ok, F.col("counts")).alias("counts"), F.when(ok, F.col("findings")).alias("findings"))


def faithfulness(judged: DataFrame, dimensions: tuple[str, ...] = ("question_type", "section", "ticker")) -> DataFrame:
    """(dimension, value, n, errors, five rates, figures): answers with an error are counted and otherwise left out; the share is null where no figure was checked.

    judged: (error, faithful, counts struct of exact, rescaled, derived, invented, skipped, findings, dimensions).
    """
    ok = F.col("error").isNull()
    total = lambda k: F.coalesce(F.sum(F.when(ok, F.col(f"counts.{k}"))), F.lit(0))
    has = lambda rule, severity: F.avg(F.when(ok, F.exists("findings", lambda f: (f["rule"] == rule) & (f["severity"] == severity)).cast("double")))
    sets = [[], *[[F.col(d)] for d in dimensions]]
    g = judged.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("faithful").cast("double"))).alias("faithful"),
        has("numeric_grounding", "block").alias("with_invented"), has("citations", "block").alias("bad_citation"), has("citation_index", "warn").alias("wrong_index"), has("citations_missing", "warn").alias("no_citation"),
        *[total(k).alias(k) for k in ("exact", "rescaled", "derived", "invented", "skipped")], F.grouping_id().alias("gid"),
    )
    g = g.withColumn("checked", F.col("exact") + F.col("rescaled") + F.col("derived") + F.col("invented"))
    full = (1 << len(dimensions)) - 1
    name, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dimensions):
        gid = full ^ (1 << (len(dimensions) - 1 - i))
        name, value = F.when(F.col("gid") == gid, F.lit(d)).otherwise(name), F.when(F.col("gid") == gid, F.col(d).cast("string")).otherwise(value)
    share = F.when(F.col("checked") > 0, 1 - F.col("invented") / F.col("checked")).alias("grounded_share")
    return g.select(name.alias("dimension"), value.alias("value"), "n", "errors", "faithful", "with_invented", "bad_citation", "wrong_index", "no_citation", "checked", "exact", "rescaled", "derived", "invented", "skipped", share)
