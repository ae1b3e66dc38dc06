"""Evaluation texts in training text: greedy string tiling over shared-token seeds.

The items' word n-grams are a stated query set. They are taken in blocks of at most `block_seeds` n-grams; a block is a sorted
array that goes to every task, and every document is looked up against every block, so the corpus itself is never shuffled. The items are read from
the driver's iterator, so that it holds one block at a time. A document
and an item part that share a seed are tiled: seeds on one diagonal are joined into maximal common runs of words, the longest run that overlaps no
marked word is marked, the rest is cut down to what is still free, and so on. The tiles don't depend on order, so reordered
passages are caught by the share of the part that tiles cover. Words are compared as strings in the tiling, so a hash
collision can't produce a match.

Cases: null or empty texts and parts hold no words. Parts shorter than `min_match` words match nothing. Equal documents each come out.
Items with the same id are one item.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import batches, grams_by_text, word_hashes

_WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class LeakConfig:
    #: shortest tile in words; also the length of a seed
    min_match: int = 12
    #: words of the longest tile
    min_longest: int = 0
    #: share of a part that its tiles must cover (0: any tile will do)
    min_coverage: float = 0.0
    block_seeds: int = 1_000_000


def tiles(part: list[str], doc: list[str], starts: list[tuple[int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """(part position, document position, length) of the tiles, longest first. starts: positions of shared seeds of min_match words."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for i, j in starts:
        if part[i : i + min_match] == doc[j : j + min_match]:
            by_diagonal[j - i].append(i)
    heap: list[tuple[int, int, int]] = []
    for diagonal, at in by_diagonal.items():
        at = sorted(set(at))
        first = last = at[0]
        for i in [*at[1:], None]:
            if i is None or i != last + 1:
                heap.append((-(last - first + min_match), first, first + diagonal))
                first = i
            last = i
    heapq.heapify(heap)
    used_part, used_doc, out = bytearray(len(part)), bytearray(len(doc)), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = [k for k in range(n) if used_part[i + k] or used_doc[j + k]]
        if not taken:
            out.append((i, j, n))
            used_part[i : i + n] = b"\1" * n
            used_doc[j : j + n] = b"\1" * n
            continue
        edge = 0
        for k in [*taken, n]:  # what is left between words already marked
            if k - edge >= min_match:
                heapq.heappush(heap, (-(k - edge), i + edge, j + edge))
            edge = k + 1
    return out


@dataclass(frozen=True)
class _Block:
    seeds: np.ndarray
    part: np.ndarray
    at: np.ndarray
    items: list[tuple[str, str, list[str]]]


def _blocks(items: Iterable[tuple[str, str, str | None]], cfg: LeakConfig) -> Iterator[_Block]:
    """items: (id, part, text)."""
    held: list[tuple[str, str, list[str]]] = []
    size = 0
    for key, part, text in items:
        words = _WORD.findall((text or "").lower())
        n = len(words) - cfg.min_match + 1
        if n > 0:
            if held and size + n > cfg.block_seeds:
                yield _block(held, cfg)
                held, size = [], 0
            held.append((key, part, words))
            size += n
    if held:
        yield _block(held, cfg)


def _block(items: list[tuple[str, str, list[str]]], cfg: LeakConfig) -> _Block:
    hashes, offsets = word_hashes([" ".join(w) for _, _, w in items])
    grams, part, at = grams_by_text(hashes, offsets, cfg.min_match)
    order = np.argsort(grams, kind="stable")
    return _Block(grams[order], part[order], at[order], items)


LEAK = "doc_id bigint, id string, part string, tiles int, longest int, matched int, words int, coverage double"


def _scan(docs: DataFrame, block: _Block, cfg: LeakConfig) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for pdf in it:
            ids, texts, rows = pdf["doc_id"].to_numpy(), pdf["text"].to_numpy(), []
            for piece in batches(texts):
                hashes, offsets = word_hashes(texts[piece])
                grams, owner, pos = grams_by_text(hashes, offsets, cfg.min_match)
                lo = np.searchsorted(b.seeds, grams)
                hit = np.flatnonzero(b.seeds[np.minimum(lo, len(b.seeds) - 1)] == grams)
                if not len(hit):
                    continue
                hi = np.searchsorted(b.seeds, grams[hit], side="right")
                found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for h, first, last in zip(hit, lo[hit], hi):
                    for s in range(first, last):
                        found[(int(owner[h]), int(b.part[s]))].append((int(b.at[s]), int(pos[h])))
                words: dict[int, list[str]] = {}
                for (d, p), starts in found.items():
                    item, part, part_words = b.items[p]
                    if cfg.min_coverage:  # words in reach of any seed: no tiling can cover more
                        reach = np.zeros(len(part_words) + 1, dtype=np.int64)
                        at = np.unique([s for s, _ in starts])
                        reach[at] += 1
                        reach[at + cfg.min_match] -= 1
                        if np.count_nonzero(np.cumsum(reach)[:-1] > 0) < cfg.min_coverage * len(part_words):
                            continue
                    if d not in words:
                        words[d] = _WORD.findall(texts[piece.start + d].lower())
                    got = tiles(part_words, words[d], starts, cfg.min_match)
                    covered = sum(n for _, _, n in got)
                    longest = max((n for _, _, n in got), default=0)
                    if got and longest >= cfg.min_longest and covered >= cfg.min_coverage * len(part_words):
                        rows.append((ids[piece.start + d], item, part, len(got), longest, covered, len(part_words), covered / len(part_words)))
            yield pd.DataFrame(rows, columns=["doc_id", "id", "part", "tiles", "longest", "matched", "words", "coverage"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, LEAK)


def leaks(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """One row per document and item part (id, part, text) whose tiles reach cfg. The items are the query set: they are read through the driver block by block."""
    out = None
    for block in _blocks(map(tuple, items.select("id", "part", "text").where("id is not null and text is not null").toLocalIterator()), cfg):
        found = _scan(docs, block, cfg)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK)
