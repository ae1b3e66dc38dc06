"""Per-key work without hot tasks: fragment-replicate by estimated load.

1. Loads: rows per key in a sample, scaled up. They steer where rows go, never which rows count.
2. Plan: a task's share is total / tasks. A key above a quarter of it is *heavy* (there are at most 4 * `tasks` of those, whatever the
   data) and is split into proportionate shards. All other keys fall by hash into a fixed number of groups, whose loads are
   known from the same sample. Shards and groups are packed onto tasks, largest first onto the least loaded.
3. Fragment: each row goes to the task of its key's shard (chosen by a hash of the row) or of its group.
4. Replicate: for a join, the other side's rows of a heavy key are copied to that key's shards only.

Counts of distinct values come from rows that were made distinct inside each shard, so it doesn't matter how a key's values are spread.
What the driver sees is bounded by `tasks` and `groups`, never by the number of keys or rows. Keys may be null: null is a key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut, tasks_of

BIN, SHARD = "_bin", "_shard"


@dataclass(frozen=True)
class Plan:
    """heavy: one frame row per heavy key with its first shard number and number of shards; bins: the task of each shard and group."""

    keys: list[str]
    tasks: int
    groups: int
    heavy: DataFrame
    n_heavy_shards: int
    bins: DataFrame
    bin_load: list[int]
    heavy_keys: int


def pack(loads: list[int], bins: int) -> list[int]:
    """Largest first onto the least loaded bin; ties go to the lower number."""
    heap = [(0, b) for b in range(bins)]
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, b = heapq.heappop(heap)
        out[i] = b
        heapq.heappush(heap, (load + loads[i], b))
    return out


def _group(keys: list[str], groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(groups)).cast("int")


def key_loads(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("load"))


def make_plan(df: DataFrame, keys: list[str], tasks: int | None = None, groups_per_task: int = 32, sample: float = 1 / 16) -> Plan:
    """Estimate loads of `keys` from a sample and lay out shards and groups over `tasks` tasks."""
    spark = df.sparkSession
    tasks = tasks or tasks_of(spark)
    groups = tasks * groups_per_task
    rows = df.select(*keys)
    loads = cut(key_loads(rows.sample(sample, seed=17) if sample < 1 else rows, keys))
    total = loads.agg(F.sum("load")).first()[0] or 0
    # a shard is kept to a quarter of a share, so that packing can even out; at most 4 * tasks heavy keys exist
    limit = max(1, -(-total // (4 * tasks)))
    heavy = loads.where(F.col("load") > limit).collect()
    light = loads.where(F.col("load") <= limit).groupBy(_group(keys, groups).alias("g")).agg(F.sum("load").alias("load")).collect()
    shards, sizes, first = [], [], 0
    for row in sorted(heavy, key=lambda r: (-r["load"], str(r))):
        n = -(-row["load"] // limit)
        shards.append((*[row[k] for k in keys], first, n))
        sizes += [row["load"] // n] * n
        first += n
    by_group = {r["g"]: r["load"] for r in light}
    sizes += [by_group.get(g, 0) for g in range(groups)]
    bins = pack(sizes, tasks)
    bin_load = [0] * tasks
    for b, n in zip(bins, sizes):
        bin_load[b] += n
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_first int", "_n int"])
    placed = spark.createDataFrame(list(enumerate(bins)), f"{SHARD} int, {BIN} int")
    return Plan(keys, tasks, groups, spark.createDataFrame(shards, schema), first, placed, bin_load, len(shards))


def _with_heavy(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds _first and _n of heavy keys (null for light ones); the heavy side has at most 4 * tasks rows and is broadcast."""
    h = plan.heavy.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(plan.keys)], "_first", "_n")
    on = None
    for i, k in enumerate(plan.keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = c if on is None else on & c
    return df.join(F.broadcast(h), on, "left").drop(*[f"_k{i}" for i in range(len(plan.keys))])


def _placed(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds _bin of _shard (a table of (groups_per_task + 4) * tasks rows at most, broadcast) and moves the rows there."""
    return df.join(F.broadcast(plan.bins), SHARD).repartitionById(plan.tasks, F.col(BIN))


def fragment(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds _shard and _bin and moves each row to its task; equal rows of a heavy key are spread as well."""
    spread = F.pmod(F.xxhash64(F.lit(29), F.monotonically_increasing_id()), F.col("_n")).cast("int")
    slot = F.when(F.col("_n").isNotNull(), F.col("_first") + spread).otherwise(F.lit(plan.n_heavy_shards) + _group(plan.keys, plan.groups))
    return _placed(_with_heavy(df, plan).withColumn(SHARD, slot).drop("_first", "_n"), plan)


def replicate(df: DataFrame, plan: Plan) -> DataFrame:
    """The matching side: rows of a heavy key once for each of its shards, all others once; placed like fragment()."""
    slots = F.when(F.col("_n").isNotNull(), F.expr("sequence(_first, _first + _n - 1)")).otherwise(F.array(F.lit(plan.n_heavy_shards) + _group(plan.keys, plan.groups)))
    return _placed(_with_heavy(df, plan).withColumn(SHARD, F.explode(slots)).drop("_first", "_n"), plan)


def balanced_counts(df: DataFrame, keys: list[str], distinct: str, size: Column | None = None, plan: Plan | None = None) -> DataFrame:
    """(keys, rows, distinct values of `distinct`, sum of size) for each key; without `size` 0.

    Rows of a heavy key are sharded by row. A shard gives one row for each value of `distinct`, and these are added up by value, then by
    key. Null values of `distinct` count as no value; a key whose sizes are all null has sum 0. An empty table gives no rows. Extra columns are ignored.
    """
    narrow = df.select(*keys, F.col(distinct).alias("_d"), (F.lit(0) if size is None else size).cast("bigint").alias("_s"))
    plan = plan or make_plan(narrow, keys)
    add = lambda d: d.agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    shard = fragment(narrow, plan).groupBy(BIN, SHARD, *keys, "_d").agg(F.count("*").alias("_c"), F.sum("_s").alias("_s"))
    values = add(shard.groupBy(*keys, "_d"))
    return values.groupBy(*keys).agg(F.sum("_c").alias("rows"), F.count("_d").alias("distinct_values"), F.coalesce(F.sum("_s"), F.lit(0).cast("bigint")).alias("size"))


def balanced_join(big: DataFrame, other: DataFrame, keys: list[str], plan: Plan | None = None) -> DataFrame:
    """Inner equi-join in which no key's rows of `big` meet in one task. Null keys match nothing.

    Columns of `other` that `big` has too (besides the keys) come out with the suffix _other.
    """
    plan = plan or make_plan(big, keys)
    clash = [c for c in other.columns if c in big.columns and c not in keys]
    for c in clash:
        other = other.withColumnRenamed(c, f"{c}_other")
    present = None
    for k in keys:
        present = F.col(k).isNotNull() if present is None else present & F.col(k).isNotNull()
    left, right = fragment(big.where(present), plan), replicate(other.where(present), plan)
    return left.join(right, [BIN, SHARD, *keys]).drop(BIN, SHARD)
