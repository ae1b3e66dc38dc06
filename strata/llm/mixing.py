"""Mixing sources to target weights with a low-discrepancy schedule.

1. Tokens of every document are counted with a public tokenizer.
2. The size of the mixture is a budget: what the caller asks for, or as many tokens as the target sources hold. Each source is wanted with its share
   of the budget; one that can't fill it even when every document is used max_repeats times gives all it has, and the report names what is short. Shortfalls
   aren't made up by other sources. `exact=True` takes the largest size instead at which no source falls short (sources without documents apart).
3. Each source's documents are put in a hashed order, once per round (a round is one use of every document), and cut into blocks of
   equal tokens by running sums. The sums have two levels (buckets of the hash, then inside a bucket), so no source is summed in one task.
4. Blocks of all sources lie end to end in cumulative order. Place p goes to slot reverse(p), p's bits read backwards (the van der Corput sequence), so that
   every stretch of slots holds each source in proportion; the n-th slot of a source takes its n-th block, which puts first uses before repeats. Slots
   are counted by two-level sums too. Slot numbers give the order and have gaps.

Cases: null or blank source, null text and sources without a target take no part. Documents without tokens take no part. Source names are compared trimmed and in
lower case. Equal documents are different documents. An empty table gives an empty mixture and shares of 0. Repeated target rows: the first by share counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut, small_side

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class MixConfig:
    tokenizer: str = TOKENIZER
    block_tokens: int = 2048
    #: tokens of the mixture; None: as many as the target sources hold
    total_tokens: int | None = None
    #: take the largest mixture without a shortfall
    exact: bool = False
    bucket_documents: int = 50_000
    slot_chunk: int = 1 << 16
    seed: int = 13


@lru_cache(maxsize=2)
def _encoding(table: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line.strip())}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("table", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, cfg: MixConfig) -> DataFrame:
    """(doc_id, source, tokens); texts leave the plan here. The vocabulary (some 50,000 entries) is read on the driver and shipped with the tasks."""
    with open(cfg.tokenizer, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(table.value)
        for pdf in it:
            pdf["tokens"] = [len(encoding.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "source", "tokens"]]

    named = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where("source <> '' and text is not null")
    return named.mapInPandas(run, "doc_id bigint, source string, tokens bigint").where("tokens > 0")


@dataclass
class Mixture:
    """slots: (slot, source, block, doc_id, round, tokens): documents of each slot's block; shares: one row per target source."""

    slots: DataFrame
    shares: DataFrame


def wanted_tokens(counted: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, wanted, short): tokens that each target source is to give, and what it lacks of its share."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats")).where("source <> '' and target_share > 0")
    t = t.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t")).select("source", "t.*")
    have = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    both = t.join(have, "source", "left").na.fill(0, ["documents", "available"]).withColumn("usable", F.col("available") * F.col("max_repeats"))
    held = F.col("usable") > 0
    total = both.agg(
        F.sum("target_share").alias("shares"), F.sum(F.when(held, F.col("target_share"))).alias("present"), F.sum("available").alias("tokens"), F.min(F.when(held, F.col("usable") / F.col("target_share"))).alias("scale"),
    )
    # the table has one row a source, the totals one row
    both = both.join(F.broadcast(total))
    size = F.col("tokens").cast("double") if cfg.total_tokens is None else F.lit(float(cfg.total_tokens))
    due = F.floor(F.col("scale") * F.col("target_share") if cfg.exact else size * F.col("target_share") / F.col("shares")).cast("bigint")
    due = F.coalesce(due, F.lit(0).cast("bigint"))
    return both.select("source", "target_share", "max_repeats", "documents", "available", F.least("usable", due).alias("wanted"), F.greatest(due - F.col("usable"), F.lit(0).cast("bigint")).alias("short"))


def _blocks(counted: DataFrame, plan: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, block, doc_id, round, tokens): the uses of documents that fill each source's quota, in blocks of equal tokens."""
    need = plan.where("wanted > 0").select("source", "wanted", F.ceil(F.col("wanted") / F.col("available")).cast("int").alias("rounds"), F.ceil(F.col("documents") / cfg.bucket_documents).cast("int").alias("buckets"))
    uses = (
        counted.join(small_side(need), "source").withColumn("round", F.explode(F.expr("sequence(0, rounds - 1)")))
        .withColumn("h", F.xxhash64(F.lit(cfg.seed), "round", "doc_id")).withColumn("bucket", F.expr("cast(pmod(shiftright(h, 20), buckets) as int)"))
    )
    order = Window.partitionBy("source").orderBy("round", "bucket")
    start = uses.groupBy("source", "round", "bucket").agg(F.sum("tokens").alias("n")).withColumn("base", F.sum("n").over(order) - F.col("n")).drop("n")
    inside = Window.partitionBy("source", "round", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.join(small_side(start), ["source", "round", "bucket"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return placed.where("begin < wanted").select("source", F.floor(F.col("begin") / cfg.block_tokens).cast("bigint").alias("block"), "doc_id", "round", "tokens")


def _schedule(plan: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, block, slot): one van der Corput slot for every block."""
    spark = plan.sparkSession
    # the target table is a statement of the caller (one row a source), read through the driver
    rows = sorted((r["source"], int(r["wanted"])) for r in plan.where("wanted > 0").collect())
    blocks = [-(-w // cfg.block_tokens) for _, w in rows]
    total = sum(blocks)
    if not total:
        return spark.createDataFrame([], "source string, block bigint, slot bigint")
    ends = list(accumulate(blocks))
    bits = max(1, (total - 1).bit_length())
    named = (
        spark.range(total).withColumn("slot", F.expr(f"cast(conv(reverse(lpad(bin(id), {bits}, '0')), 2, 10) as bigint)")).withColumn("ends", F.array(*[F.lit(e) for e in ends]))
        .withColumn("k", F.expr("size(filter(ends, e -> e <= id))")).withColumn("chunk", F.expr(f"slot div {cfg.slot_chunk}")).select("slot", "k", "chunk")
    )
    counts = named.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = named.join(small_side(base), ["k", "chunk"]).withColumn("block", F.col("base") + F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    return ranked.select(F.element_at(F.array(*[F.lit(s) for s, _ in rows]), F.col("k") + 1).alias("source"), "block", "slot")


def mix(docs: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> Mixture:
    """Mix (doc_id, source, text) to (source, target_share, max_repeats)."""
    counted = cut(count_tokens(docs, cfg))
    plan = cut(wanted_tokens(counted, targets, cfg))
    uses = cut(_blocks(counted, plan, cfg))
    slots = uses.join(_schedule(plan, cfg), ["source", "block"]).select("slot", "source", "block", "doc_id", "round", "tokens")
    used = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("round").alias("last"))
    every = used.agg(F.sum("tokens").alias("all_tokens"))
    shares = (
        plan.join(used, "source", "left").join(F.broadcast(every))
        .select("source", "target_share", "max_repeats", "documents", "available", "wanted", "short", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
                (F.coalesce("last", F.lit(-1)) + 1).alias("repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
    return Mixture(slots, shares)
