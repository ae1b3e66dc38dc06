"""Lines repeated across one source's records: suffix arrays over line identifiers, common prefixes, exact counts over shards.

Every line becomes a 64-bit identifier of its normal form. The rows of one source are spread over shards of bounded
size; in each shard the identifiers are concatenated (records kept apart), a suffix array is built by prefix
doubling, and the common prefixes of neighbouring suffixes are folded into their intervals: an interval of depth n is a repeated block of n lines with all
the suffixes that start with it. There are fewer intervals than lines, whatever the lengths of blocks, and the number of different records of every
interval comes from the same sweep.

A source that fits one shard is done with that: blocks that span enough records are kept with the places of their suffixes. A larger one takes two
steps. First each shard names the blocks that span the wanted share of *its* records; a block that spans that share of all records does so in at least one shard, so none is
missed. Then all shards count all named blocks exactly, and the counts are summed (a record lies in one shard). What is merged is a few rows for each shard.

A line is removed where a suffix starts that lies in a block spanning enough records: with `min_lines` above 1, the block's first `min_lines` lines.

Cases: null text or source: the row takes no part and comes out unchanged. Empty text: one empty line, never a case. Rows with the same text
count once each. Lines of fewer than `min_chars` normal characters belong to no block. blocks() of a source in several shards lists blocks at the lengths at which they branch in some shard; removed lines don't depend on that.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.words import mix64, powers
from strata.session import cut, small_side


@dataclass(frozen=True)
class RepeatedLinesConfig:
    min_chars: int = 20
    min_rows: int = 6
    min_share: float = 0.03
    min_lines: int = 1
    shard_lines: int = 200_000


def normal_lines(text: Column) -> Column:
    """Normal forms of the lines: lower case, digit runs to #, other runs to one blank, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), "[^a-z#\n]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def line_ids(text: Column, min_chars: int) -> Column:
    """Identifier of each line, 0 for lines too short to count."""
    return F.transform(normal_lines(text), lambda x: F.when(F.length(x) >= min_chars, F.xxhash64(x)).otherwise(F.lit(0).cast("bigint")))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before) of a sequence in which 0 ends a record: no prefix runs over a 0.

    Prefix doubling with array operations. Every 0 gets a rank of its own, so suffixes starting with one never share a prefix.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64) + n
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    step = 1
    ranks = [np.unique(rank, return_inverse=True)[1].astype(np.int64)]
    while True:
        rank = ranks[-1]
        second = np.full(n, -1, dtype=np.int64)
        second[:-step] = rank[step:] if step < n else second[:-step]
        order = np.lexsort((second, rank))
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))))
        if new.max() == n - 1 or step * 2 >= 2 * n:
            break
        ranks.append(new)
        step *= 2
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        # binary lifting: the kept ranks at step 2^k compare 2^k symbols at once
        x, y, common = order[1:].copy(), order[:-1].copy(), np.zeros(n - 1, dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            ok = (x < n) & (y < n)
            same = np.zeros(n - 1, dtype=bool)
            same[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
            common += same * (1 << k)
            x, y = x + same * (1 << k), y + same * (1 << k)
        lcp[1:] = common
    return order, lcp


@dataclass
class Intervals:
    """Intervals of the suffix array with a common prefix of `depth` lines: places first..last, number of different records, enclosing interval (-1: none)."""

    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray
    records: np.ndarray
    parent: np.ndarray


def intervals(lcp: np.ndarray, owner: np.ndarray) -> Intervals:
    """All intervals of depth 1 or more in one sweep; owner: the record of each suffix, in suffix order.

    A record is counted once: each suffix with an earlier one of its record costs the smallest interval that holds both one record.
    """
    n = len(lcp)
    by_owner = np.argsort(owner, kind="stable")
    again = owner[by_owner][1:] == owner[by_owner][:-1] if n else np.zeros(0, dtype=bool)
    earlier = np.full(n, -1, dtype=np.int64)
    earlier[by_owner[1:][again]] = by_owner[:-1][again]
    depth, first, last, parent, surplus = [], [], [], [], []
    open_, lefts = [], []
    live = np.flatnonzero(lcp > 0)
    at = -2
    for i, h, e in zip(live.tolist(), lcp[live].tolist(), earlier[live].tolist()):
        if i != at + 1:
            while open_:
                node = open_.pop()
                last[node], parent[node] = at, open_[-1] if open_ else -1
            lefts.clear()
        at, left, orphan = i, i - 1, -1
        while open_ and depth[open_[-1]] > h:
            node, left = open_.pop(), lefts.pop()
            last[node] = i - 1
            if open_ and depth[open_[-1]] >= h:
                parent[node] = open_[-1]
            else:
                orphan = node
        if not open_ or depth[open_[-1]] < h:
            if orphan >= 0:
                parent[orphan] = len(depth)
            open_.append(len(depth))
            lefts.append(left)
            depth.append(h)
            first.append(left)
            last.append(-1)
            parent.append(-1)
            surplus.append(0)
        if e >= 0 and (k := bisect_right(lefts, e) - 1) >= 0:
            surplus[open_[k]] += 1
    while open_:
        node = open_.pop()
        last[node], parent[node] = at, open_[-1] if open_ else -1
    got = Intervals(*(np.array(x, dtype=np.int64) for x in (depth, first, last, surplus, parent)))
    for node in np.argsort(-got.depth, kind="stable").tolist():
        if got.parent[node] >= 0:
            got.records[got.parent[node]] += got.records[node]
    got.records = got.last - got.first + 1 - got.records
    return got


class _Shard:
    """The concatenated identifiers of a shard's records, with a rolling hash of every window."""

    def __init__(self, records: np.ndarray, ids: list[np.ndarray]):
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1] + 1) if len(ends) else 0
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        self.records, self.symbols = records, np.zeros(n, dtype=np.int64)
        if len(ids):
            self.symbols[inside] = np.concatenate(ids)
        self.owner = np.repeat(np.arange(len(ids)), lengths + 1)
        self.line = np.arange(n) - (ends - lengths)[self.owner]
        gap = np.where(self.symbols == 0, np.arange(n), n)
        self.run = np.minimum.accumulate(gap[::-1])[::-1] - np.arange(n)  # lines up to the next 0
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.symbols.view(np.uint64) * up[:n], out=self._sums[1:])

    def hash(self, at: np.ndarray, lines: np.ndarray | int) -> np.ndarray:
        """64 bits for the `lines` lines from each place on."""
        return mix64((self._sums[at + lines] - self._sums[at]) * self._down[at] + np.asarray(lines).astype(np.uint64)).view(np.int64)


FOUND = "source string, block bigint, lines int, root bigint, parent bigint, parent_lines int, tail bigint, records bigint, record array<bigint>, line array<int>"
CANDIDATE = "source string, block bigint, lines int, first bigint, root bigint"


def _frequent_intervals(shard: _Shard, least: float, window: int) -> tuple[np.ndarray, Intervals, np.ndarray]:
    """(suffix array, intervals, numbers of those of `window` lines or more that span at least `least` records)."""
    order, lcp = suffix_array(shard.symbols)
    nodes = intervals(lcp, shard.owner[order])
    return order, nodes, np.flatnonzero((nodes.records >= least) & (nodes.depth >= window))


def _rows(shard: _Shard, source: str, own: np.ndarray, places: np.ndarray, lines: np.ndarray, records: np.ndarray, parent: np.ndarray, window: int) -> pd.DataFrame:
    """FOUND rows. own: number of the longest block at each place (-1: none); places: one place of each block; parent: number of the enclosing block (-1: none)."""
    at = np.flatnonzero(own >= 0)
    at = at[np.argsort(own[at], kind="stable")]
    ends = np.searchsorted(own[at], np.arange(len(places) + 1))
    held = lambda x: pd.Series(np.split(x, ends[1:-1]) if len(places) else [], dtype=object)
    blocks = shard.hash(places, lines)
    longer = lines > 1
    tails = np.zeros(len(places), dtype=np.int64)
    tails[longer] = shard.hash(places[longer] + 1, lines[longer] - 1)
    return pd.DataFrame({
        "source": source, "block": blocks, "lines": lines.astype(np.int32), "root": shard.hash(places, window), "parent": np.where(parent >= 0, blocks[parent], 0) if len(places) else blocks,
        "parent_lines": (np.where(parent >= 0, lines[parent], 0) if len(places) else lines).astype(np.int32), "tail": tails, "records": records,
        "record": held(shard.records[shard.owner[at]]), "line": held(shard.line[at].astype(np.int32)),
    })


def _whole_source(pdf: pd.DataFrame, cfg: RepeatedLinesConfig) -> pd.DataFrame:
    """FOUND rows of a source that is one shard."""
    shard = _Shard(pdf["record"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in pdf["ids"]])
    least, source = max(cfg.min_rows, cfg.min_share * len(pdf)), pdf["source"].iloc[0]
    if least <= 1:
        return _counted(pdf, _named(pdf, cfg, least), cfg)
    order, nodes, kept = _frequent_intervals(shard, least, cfg.min_lines)
    kept = kept[np.argsort(nodes.depth[kept], kind="stable")]
    number = np.full(len(nodes.depth) + 1, -1, dtype=np.int64)
    number[kept] = np.arange(len(kept))
    own = np.full(len(shard.symbols), -1, dtype=np.int64)
    for k, node in enumerate(kept.tolist()):  # by depth: the longest block of a place comes last
        own[order[nodes.first[node] : nodes.last[node] + 1]] = k
    return _rows(shard, source, own, order[nodes.first[kept]], nodes.depth[kept], nodes.records[kept], number[nodes.parent[kept]], cfg.min_lines)


def _named(pdf: pd.DataFrame, cfg: RepeatedLinesConfig, least: float) -> pd.DataFrame:
    """CANDIDATE rows of a shard: blocks that span at least `least` of its records, and the first min_lines lines of each."""
    shard, m = _Shard(pdf["record"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in pdf["ids"]]), cfg.min_lines
    order, nodes, kept = _frequent_intervals(shard, least, m)
    places, lines = order[nodes.first[kept]], nodes.depth[kept]
    windows = np.flatnonzero(shard.run >= m) if least <= 1 else places
    places, lines = np.concatenate([places, windows]), np.concatenate([lines, np.full(len(windows), m)])
    out = pd.DataFrame({"source": pdf["source"].iloc[0], "block": shard.hash(places, lines), "lines": lines.astype(np.int32), "first": shard.symbols[places], "root": shard.hash(places, m)})
    return out.drop_duplicates(["block", "lines"])


def _counted(pdf: pd.DataFrame, named: pd.DataFrame, cfg: RepeatedLinesConfig) -> pd.DataFrame:
    """FOUND rows of the named blocks in one shard, with exact counts."""
    shard, m = _Shard(pdf["record"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in pdf["ids"]]), cfg.min_lines
    by_first = np.argsort(shard.symbols, kind="stable")
    firsts = shard.symbols[by_first]
    own = np.full(len(shard.symbols), -1, dtype=np.int64)
    places, lines, records, parents = [], [], [], []
    for length, group in named.groupby("lines", sort=True):  # ascending: the longest block of a place comes last
        for first, same in group.groupby("first"):
            at = by_first[np.searchsorted(firsts, first) : np.searchsorted(firsts, first, side="right")]
            at = at[shard.run[at] >= length]
            hashes = shard.hash(at, int(length))
            for block in same["block"]:
                hit = at[hashes == block]
                if len(hit):
                    places.append(int(hit[0]))
                    lines.append(length)
                    records.append(len(np.unique(shard.owner[hit])))
                    parents.append(int(own[hit[0]]))
                    own[hit] = len(places) - 1
    return _rows(shard, named["source"].iloc[0], own, *(np.array(x, dtype=np.int64) for x in (places, lines, records, parents)), m)


@dataclass
class RepeatedLines:
    """found: rows FOUND of every source and shard; shards: (source, rows, shards)."""

    found: DataFrame
    shards: DataFrame
    cfg: RepeatedLinesConfig

    def blocks(self) -> DataFrame:
        """(source, block, lines, records, root, parent, parent_lines, tail, record, line): blocks of at least min_lines lines that span enough records, with one place."""
        c = self.cfg
        whole = self.found.groupBy("source", "block", "lines").agg(
            F.sum("records").alias("records"), *[F.min(x).alias(x) for x in ("root", "parent", "parent_lines", "tail")], F.min(F.array_min(F.arrays_zip("record", "line"))).alias("at"),
        )
        return (
            whole.join(small_side(self.shards.select("source", "rows")), "source").where((F.col("records") >= c.min_rows) & (F.col("records") >= F.lit(c.min_share) * F.col("rows")))
            .select("source", "block", "lines", "records", "root", "parent", "parent_lines", "tail", "at.record", "at.line")
        )

    def maximal(self) -> DataFrame:
        """Blocks that no spanning block extends by a line at either end."""
        blocks = cut(self.blocks())
        inner = blocks.select("source", F.explode(F.array(F.struct(F.col("tail").alias("block"), (F.col("lines") - 1).alias("lines")), F.struct(F.col("parent").alias("block"), F.col("parent_lines").alias("lines")))).alias("b"))
        return blocks.join(inner.select("source", "b.block", "b.lines").where("lines > 0").distinct(), ["source", "block", "lines"], "left_anti")

    def occurrences(self) -> DataFrame:
        """(record, line): the lines to be removed, from the places of the suffixes in spanning blocks.

        A place in a named block that proved too rare over all shards counts by its first min_lines lines.
        """
        m = self.cfg.min_lines
        spanning = small_side(cut(self.blocks().select("source", "block", "lines")))
        first = spanning.where(F.col("lines") == m).select("source", F.col("block").alias("root"))
        placed = self.found.select("source", "block", "lines", "root", F.arrays_zip("record", "line").alias("at")).where(F.size("at") > 0)
        kept = placed.join(spanning, ["source", "block", "lines"], "left_semi").select("at").unionByName(
            placed.join(spanning, ["source", "block", "lines"], "left_anti").join(first, ["source", "root"], "left_semi").select("at")
        )
        starts = kept.select(F.explode("at").alias("at")).select("at.record", "at.line")
        return starts if m == 1 else starts.select("record", F.explode(F.expr(f"sequence(line, line + {m - 1})")).alias("line")).distinct()


def repeated_lines(docs: DataFrame, cfg: RepeatedLinesConfig = RepeatedLinesConfig()) -> RepeatedLines:
    """Find the lines of (record, source, text) that span many records of their source. record must be unique."""
    rows = cut(docs.where("source is not null and text is not null").select("record", "source", line_ids(F.col("text"), cfg.min_chars).alias("ids")))
    shards = cut(
        rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.size("ids") + 1).alias("n")).where(F.col("rows") >= cfg.min_rows)
        .select("source", "rows", F.ceil(F.col("n") / cfg.shard_lines).cast("int").alias("shards"))
    )
    placed = rows.join(small_side(shards), "source").withColumn("shard", F.expr("cast(pmod(xxhash64(record, 5), shards) as int)"))
    found = placed.where("shards = 1").select("source", "record", "ids").groupBy("source").applyInPandas(lambda pdf: _whole_source(pdf, cfg), FOUND)
    many = shards.where("shards > 1")
    if not many.isEmpty():
        parts = placed.where("shards > 1").select("source", "shard", "rows", "record", "ids")

        def name(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = float(pdf["rows"].iloc[0])
            return _named(pdf, cfg, max(cfg.min_share, cfg.min_rows / rows) * len(pdf))

        named = cut(parts.groupBy("source", "shard").applyInPandas(name, CANDIDATE).groupBy("source", "block", "lines").agg(F.min("first").alias("first"), F.min("root").alias("root")))
        everywhere = named.join(small_side(many), "source").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).select("source", "shard", "block", "lines", "first", "root")

        def count(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            return _counted(pdf, blocks, cfg) if len(pdf) and len(blocks) else pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in FOUND.split(", ")})

        found = found.unionByName(parts.groupBy("source", "shard").cogroup(everywhere.groupBy("source", "shard")).applyInPandas(count, FOUND))
    return RepeatedLines(cut(found), shards, cfg)


def remove_lines(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(record, text): every row of docs, without the given lines and otherwise unchanged; a text whose lines all go becomes empty."""
    gone = occurrences.groupBy("record").agg(F.collect_set("line").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return docs.select("record", "text").join(gone, "record", "left").select("record", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
