"""Near-duplicate records: tensored MinHash banding, sketch filter, exact verification, classes and groups.

Plain banding with L tables of K MinHash values needs K * L values a text. Here two small collections A and
B of `bands` half-keys (each of `half` values) are computed, and table (i, j) has the key (A_i, B_j): bands^2
tables from 2 * bands * half values, about the square root of the plain cost. Only the A half-keys
are shuffled (one row each, with the text's B half-keys and a 16-byte sketch along); the pairing with B
takes place inside the cell of one A value. A pair of similarity s becomes a candidate with probability
(1 - (1 - s^half)^bands)^2: for half 2 and 12 bands 0.94 at s = 0.5, 0.991 at 0.6, 0.9994 at 0.7.

Exact copies are folded into classes first, so that a text repeated a million times costs one signature.
An A value shared by more than `cell_rows` texts is split into blocks whose pairs of blocks are separate
cells (fragment and replicate), so no task ever holds more than two blocks, compares more than `cell_rows`^2 pairs at a time or loses a pair. Cells
come to Python sorted and are compared one after the other; hits leave as they are found.
A family of n almost equal texts has n^2 / 2 links, which are the result; what doesn't pass the sketch costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import batches, grams_by_text, mix64, word_hashes
from strata.session import cut, small_side, tasks_of

_LANES = np.uint64(0x5555555555555555)
SKETCH_BINS = 64


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 5
    half: int = 2
    bands: int = 12
    cell_rows: int = 20_000
    #: half-key rows in a task, as long as that gives at most max_parts tasks
    part_rows: int = 60_000
    max_parts: int = 50_000
    #: classes of more copies are joined in pieces of this many
    copies: int = 2_000
    #: sketch matches (of 64 two-bit lanes) below which a candidate is dropped; None: mean minus 2.7 standard deviations at the threshold
    sketch_floor: int | None = None

    def floor(self) -> int:
        if self.sketch_floor is not None:
            return self.sketch_floor
        p = self.threshold + (1 - self.threshold) / 4
        return max(0, int(SKETCH_BINS * p - 2.7 * (SKETCH_BINS * p * (1 - p)) ** 0.5))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(77001).integers(1, 2**62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minhashes(grams: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(seeds)), dtype=np.uint64)
    for k, seed in enumerate(seeds):
        x = grams * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _sketch(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Two words of 64 two-bit lanes a text: one-permutation hashing, empty bins filled from the next one round."""
    x = mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    cell = owner * SKETCH_BINS + (x >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((x, cell))
    cell, x = cell[order], x[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    value = np.zeros(n * SKETCH_BINS, dtype=np.uint64)
    there = np.zeros(n * SKETCH_BINS, dtype=bool)
    value[cell[first]], there[cell[first]] = x[first], True
    value, there = value.reshape(n, SKETCH_BINS), there.reshape(n, SKETCH_BINS)
    # position of the nearest filled bin at or after each bin, round the ring
    at = np.where(np.concatenate([there, there], axis=1), np.arange(2 * SKETCH_BINS), 4 * SKETCH_BINS)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :SKETCH_BINS]
    gap = (at - np.arange(SKETCH_BINS)).astype(np.uint64)
    bits = mix64(np.take_along_axis(value, at % SKETCH_BINS, axis=1) + gap * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(3)
    shift = (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]
    return np.stack([(bits[:, :32] << shift).sum(axis=1, dtype=np.uint64), (bits[:, 32:] << shift).sum(axis=1, dtype=np.uint64)], axis=1)


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    keep = np.concatenate(([True], (g[1:] != g[:-1]) | (o[1:] != o[:-1]))) if len(g) else np.zeros(0, dtype=bool)
    return g[keep], o[keep]


def _text_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits for the word sequence of each text."""
    lengths = np.diff(offsets)
    pos = (np.arange(len(hashes)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
    out = np.zeros((len(lengths), 2), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    for k, salt in enumerate((0x1234567, 0x89ABCDE)):
        x = mix64(hashes ^ mix64(pos * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
        if len(full):
            out[full, k] = np.add.reduceat(x, offsets[:-1][full])
    return out


SIGNATURE = "id bigint, k1 bigint, k2 bigint, a array<bigint>, b binary, sk binary"


def signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(id, text) -> one signature row for each text with at least cfg.min_words words; null and shorter texts give no row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _seeds(2 * cfg.half * cfg.bands)
        for pdf in it:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].to_numpy()
            for part in batches(texts):
                hashes, offsets = word_hashes(texts[part])
                enough = np.diff(offsets) >= max(cfg.min_words, cfg.shingle)
                grams, owner, _ = grams_by_text(hashes, offsets, cfg.shingle)
                keep = enough[owner]
                grams, owner = _distinct(grams[keep], owner[keep])
                if not len(grams):
                    continue
                rows = np.flatnonzero(enough)
                owner = np.searchsorted(rows, owner)
                starts = np.searchsorted(owner, np.arange(len(rows)))
                mh = _minhashes(grams, starts, seeds)
                keys = np.zeros((len(rows), 2 * cfg.bands), dtype=np.uint64)
                for k in range(2 * cfg.bands):
                    acc = np.full(len(rows), k + 1, dtype=np.uint64)
                    for h in range(cfg.half):
                        acc = mix64(acc * np.uint64(0x100000001B3) + mh[:, k * cfg.half + h])
                    keys[:, k] = acc
                sketch = _sketch(grams, owner, len(rows))
                text_key = _text_keys(hashes, offsets)[rows]
                yield pd.DataFrame({
                    "id": ids[part][rows], "k1": text_key[:, 0].view(np.int64), "k2": text_key[:, 1].view(np.int64),
                    "a": list(np.ascontiguousarray(keys[:, : cfg.bands]).view(np.int64)),
                    "b": [r.tobytes() for r in (keys[:, cfg.bands :] & np.uint64(0xFFFF)).astype(np.uint16)],
                    "sk": [r.tobytes() for r in sketch],
                })

    return docs.select("id", "text").where("text is not null").mapInPandas(run, SIGNATURE)


def classes(sig: DataFrame) -> DataFrame:
    """(id, rep) of every text that has an exact copy (same words in the same order); rep is the smallest id of the class."""
    keyed = sig.select("id", "k1", "k2")
    several = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(several, ["k1", "k2"]).select("id", "rep")


def _cell_pairs(a: np.ndarray, side: np.ndarray, same: bool, ids: np.ndarray, b: np.ndarray, sk: np.ndarray, floor: int) -> Iterator[np.ndarray]:
    """Blocks of pairs (positions) of rows that share A and some B_j and pass the sketch. same: within one block, else only across sides."""
    for j in range(b.shape[1]):
        key = mix64(a + b[:, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
        order = np.argsort(key, kind="stable")
        k = key[order]
        run = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        left = np.repeat(run[1:], np.diff(run)) - np.arange(len(k)) - 1  # rows after this one in its run
        live = np.flatnonzero(left > 0)
        step = 1
        while len(live):
            # the d-th successor of each row, many d at a time while the block of pairs stays small
            width = max(1, min(int(left[live].max()) - step + 1, 2_000_000 // max(1, len(live))))
            d = np.arange(step, step + width)
            ok = left[live][:, None] >= d[None, :]
            x = order[np.broadcast_to(live[:, None], ok.shape)[ok]]
            y = order[(live[:, None] + d[None, :])[ok]]
            keep = ids[x] != ids[y]
            if not same:
                keep &= side[x] != side[y]
            # a pair that shares an earlier B as well was compared there
            for e in range(j):
                keep &= b[x, e] != b[y, e]
            x, y = x[keep], y[keep]
            diff = sk[x] ^ sk[y]
            diff = (diff | (diff >> np.uint64(1))) & _LANES
            good = SKETCH_BINS - np.bitwise_count(diff).sum(axis=1) >= floor
            if good.any():
                yield np.stack([x[good], y[good]], axis=1)
            step += width
            live = live[left[live] >= step]


def candidates(sig: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b), a < b: pairs of ids in one cell of the tensored tables that pass the sketch; once each."""
    spark = sig.sparkSession
    values = sig.select("id", "b", "sk", F.explode("a").alias("av"))
    # loads are estimated from every sixteenth text; they steer where rows go, not which are compared
    hot = (
        values.where(F.expr("pmod(xxhash64(id, 3), 16) = 0")).groupBy("av").agg((F.count("*") * 16).alias("n")).where(F.col("n") > cfg.cell_rows)
        .select("av", F.ceil(F.col("n") / cfg.cell_rows).cast("int").alias("blocks"))
    )
    hot = cut(hot)
    if hot.isEmpty():
        placed = values.select("id", "b", "sk", "av", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"))
    else:
        # block x of a hot value meets every block y: cell (min, max); one row goes to `blocks` cells
        placed = (
            values.join(small_side(hot), "av", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.expr("cast(pmod(xxhash64(id, 11), blocks) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("id", "b", "sk", "av", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
        )
    parts = max(tasks_of(spark), min(-(-sig.count() * cfg.bands // cfg.part_rows), cfg.max_parts))
    bands, floor = cfg.bands, cfg.floor()
    cells = placed.repartitionById(parts, F.expr(f"cast(pmod(xxhash64(av, lo, hi), {parts}) as int)")).sortWithinPartitions("av", "lo", "hi")

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = pdf["id"].to_numpy()
        av = pdf["av"].to_numpy().astype(np.int64).view(np.uint64)
        lo, hi, block = (pdf[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "block"))
        b = np.frombuffer(b"".join(pdf["b"]), dtype=np.uint16).reshape(-1, bands)
        sk = np.frombuffer(b"".join(pdf["sk"]), dtype=np.uint64).reshape(-1, 2)
        a = mix64(av + (lo * 1_000_003 + hi).astype(np.uint64))
        for same in (True, False):
            at = np.flatnonzero((lo == hi) == same)
            for got in _cell_pairs(a[at], block[at], same, ids[at], b[at], sk[at], floor) if len(at) else ():
                found = np.sort(ids[at][got], axis=1)
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows whose cell may go on
        for pdf in it:
            if not len(pdf):
                continue
            open_ = (pdf["av"] == pdf["av"].iloc[-1]) & (pdf["lo"] == pdf["lo"].iloc[-1]) & (pdf["hi"] == pdf["hi"].iloc[-1])
            first = int(open_.to_numpy().argmax())
            if first:
                yield from pairs(pd.concat([*held, pdf.iloc[:first]]))
                held = []
            held.append(pdf.iloc[first:])
        if held:
            yield from pairs(pd.concat(held))

    return cells.mapInPandas(run, "a bigint, b bigint").distinct()


def _gram_lists(texts: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of each text."""
    out: list[np.ndarray] = []
    for part in batches(texts):
        hashes, offsets = word_hashes(texts[part])
        grams, owner, _ = grams_by_text(hashes, offsets, shingle)
        grams, owner = _distinct(grams, owner)
        at = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
        out += [grams[x:y] for x, y in zip(at[:-1], at[1:])]
    return out


def verify(docs: DataFrame, pairs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact similarity reaches cfg.threshold. `pairs` should be checkpointed.

    Texts travel as they are, since they compress and n-gram hashes don't.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select("id", "text").join(small_side(ids), "id", "left_semi")
    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    )

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x, y = _gram_lists(pdf["ta"].to_numpy(), cfg.shingle), _gram_lists(pdf["tb"].to_numpy(), cfg.shingle)
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], dtype=np.float64)
            either = np.array([len(p) + len(q) for p, q in zip(x, y)], dtype=np.float64) - common
            sim = np.divide(common, either, out=np.zeros_like(common), where=either > 0)
            keep = sim >= cfg.threshold
            yield pd.DataFrame({"a": pdf["a"].to_numpy()[keep], "b": pdf["b"].to_numpy()[keep], "similarity": sim[keep]})

    return both.mapInPandas(run, "a bigint, b bigint, similarity double")


@dataclass
class NearDups:
    """links: verified pairs (a, b, similarity) of class representatives; members: (id, rep) of every row with an exact copy; ids: every row that takes part."""

    links: DataFrame
    members: DataFrame
    ids: DataFrame

    def member_of(self) -> DataFrame:
        """(id, rep) of every row that takes part."""
        return self.ids.join(self.members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def near_duplicates(docs: DataFrame, cfg: NearDupConfig) -> NearDups:
    """Near-duplicates among (id, text); ids must be unique.

    Null texts and texts of fewer than cfg.min_words words take part in nothing. Equal texts form one class. An empty table gives empty results.
    """
    sig = cut(signatures(docs, cfg))
    members = cut(classes(sig))
    copies = members.where("id <> rep").select("id")
    reps = sig.join(small_side(copies), "id", "left_anti")
    pairs = cut(candidates(reps, cfg))
    return NearDups(cut(verify(docs, pairs, cfg)), members, sig.select("id"))


def expand_pairs(found: NearDups, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(a, b), a < b: all pairs of rows, copies included. As large as its result has to be.

    A class of more than cfg.copies rows is met in pieces of that many, so that no task pairs a whole large class.
    """
    links, rep_of = found.links.select("a", "b"), found.members.select("rep", "id")
    large = cut(rep_of.groupBy("rep").agg(F.ceil(F.count("*") / cfg.copies).cast("int").alias("pieces")).where("pieces > 1"))
    plain = large.isEmpty()
    side = None if plain else small_side(large)

    def pieces(df: DataFrame, rep: str) -> DataFrame:
        split = df.withColumn("pieces", F.lit(1)) if plain else df.join(side.withColumnRenamed("rep", rep), rep, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        return split.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))

    members = rep_of.withColumn("piece", F.lit(0)) if plain else rep_of.join(side, "rep", "left").withColumn("piece", F.expr("cast(pmod(xxhash64(id, 23), coalesce(pieces, 1)) as int)")).drop("pieces")

    def spread(df: DataFrame, rep: str, out: str) -> DataFrame:
        """Each row once for every member of the class `rep`; a class of one is its representative."""
        m = members.select(F.col("rep").alias(rep), "piece", F.col("id").alias(out))
        met = pieces(df, rep).join(m, [rep, "piece"], "left").where(F.col(out).isNotNull() | (F.col("pieces") == 1))
        return met.withColumn(out, F.coalesce(out, rep)).drop("piece", "pieces")

    across = spread(spread(links, "a", "x"), "b", "y")
    within = pieces(rep_of.select("rep", F.col("id").alias("x")), "rep").join(members.select("rep", "piece", F.col("id").alias("y")), ["rep", "piece"]).where("x < y")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): connected components of (a, b) by alternating large-star and small-star steps; component is the smallest id.

    Stars never grow beyond the links themselves, and each round is cut in the shared folder. Ends when a round changes nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        after = cut(small)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components: {rounds} rounds did not suffice")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def groups(found: NearDups) -> DataFrame:
    """(id, class_id, group_id, links): one row for every text that takes part; links counts the different texts linked to its class."""
    degree = found.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    group = components(found.links).select(F.col("id").alias("rep"), "component")
    return (
        found.member_of().join(group, "rep", "left").join(degree, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
