"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments at its boundaries; a boundary has a strength (paragraph, line, sentence, clause, word, none). Adjacent
pairs wait in a heap ordered by the strength of the boundary between them, then by their joint size, then by place; the weakest boundary is merged first as long
as the joint size plus the overlap fits the limit. The boundaries that are left are the cuts. A stretch between two stronger boundaries that fits is merged whole by
these rules whatever its inner order, so it is atomic from the start, and only stretches that don't fit are taken apart at the next weaker strength.
A full stop after a shortened word or an initial ends no sentence. Every piece but the first is preceded
by up to `overlap` characters of what comes before it, from the strongest boundary in reach on, of equally strong ones the earliest.

Sizes are code points. Blanks at both ends of a text and of a piece are left out and nothing else is: the pieces' cores, in order, hold every other character.

Cases: null, empty and blank texts have no pieces. A text within the limit is one piece. A run without any boundary is cut hard. Repeated rows come out each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from strata.functions.text import ABBREVIATIONS

BLANKS = " \t\r\n"
#: Strengths of boundaries.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, HARD = 5, 4, 3, 2, 1, 0
#: strongest first
_LEVELS = [
    (PARAGRAPH, re.compile(r"\s*\n[ \t\r]*\n\s*")), (LINE, re.compile(r"[ \t\r]*\n[ \t\r]*")), (SENTENCE, re.compile(r"(?<=[.!?。…])[\"'”’)\]]*\s+|(?<=[。！？])")),
    (CLAUSE, re.compile(r"(?<=[,;:–—])\s+|(?<=[，；：、])")), (WORD, re.compile(r"\s+")),
]
_SHORTENED = re.compile(r"(?<![^\W\d_])([^\W\d_]{1,6})\.[\"'”’)\]]*$")


@dataclass(frozen=True)
class SplitConfig:
    limit: int = 2000
    overlap: int = 200

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit:
            raise ValueError("overlap must be at least 0 and below limit")


@dataclass(frozen=True)
class Piece:
    start: int  # of the overlap
    core: int  # where the piece's own characters begin
    end: int
    text: str


def _ends_sentence(text: str, at: int) -> bool:
    m = _SHORTENED.search(text, max(0, at - 12), at)
    return m is None or not (len(m[1]) == 1 or m[1].lower() in ABBREVIATIONS)


def _places(text: str, start: int, end: int, level: int) -> list[int]:
    """Ends of the boundaries of one level inside text[start:end]."""
    strength, pattern = _LEVELS[level]
    return [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end and (strength != SENTENCE or _ends_sentence(text, m.start()))]


def boundaries(text: str, start: int, end: int, most: int, level: int = 0) -> list[tuple[int, int]]:
    """(position, strength) of the cuts that part text[start:end] into segments of at most `most`, weaker ones only inside segments that don't fit otherwise."""
    if end - start <= most:
        return []
    if level == len(_LEVELS):
        return [(p, HARD) for p in range(start + most, end, most)]
    at = _places(text, start, end, level)
    out: list[tuple[int, int]] = []
    for left, right in zip([start, *at], [*at, end]):
        if left > start:
            out.append((left, _LEVELS[level][0]))
        out += boundaries(text, left, right, most, level + 1)
    return out


def _lead(text: str, floor: int, begin: int) -> int:
    """Where the overlap before `begin` starts."""
    for level in range(len(_LEVELS)):
        if at := _places(text, floor - 1 if floor else floor, begin, level):
            return at[0]
    return floor


def split_text(text: str | None, cfg: SplitConfig = SplitConfig()) -> list[Piece]:
    if text is None:
        return []
    end = len(text.rstrip(BLANKS))
    start = len(text) - len(text.lstrip(BLANKS))
    if start >= end:
        return []
    if end - start <= cfg.limit:
        return [Piece(start, start, end, text[start:end])]
    most = cfg.limit - cfg.overlap
    cuts = boundaries(text, start, end, most)
    begin = [start, *[p for p, _ in cuts]]
    finish = [*[p for p, _ in cuts], end]
    strength = [s for _, s in cuts]  # strength[i]: between segments i and i + 1
    n = len(begin)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def entry(i: int) -> tuple[int, int, int, int, int]:
        j = after[i]
        return (strength[j - 1], finish[j] - begin[i], i, j, finish[j])

    heap = [entry(i) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, reach = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or finish[j] != reach or finish[j] - begin[i] != size or size > most:
            continue
        finish[i], after[i], alive[j] = finish[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, entry(i))
        if before[i] >= 0:
            heapq.heappush(heap, entry(before[i]))
    out: list[Piece] = []
    for i in (i for i in range(n) if alive[i]):
        lead = begin[i]
        if out and cfg.overlap:
            lead = max(_lead(text, begin[i] - cfg.overlap, begin[i]), out[-1].core)
        raw = text[lead : finish[i]]
        body = raw.rstrip(BLANKS)
        skip = len(body) - len(body.lstrip(BLANKS))
        if not body:
            continue
        out.append(Piece(lead + skip, max(begin[i], lead + skip), lead + len(body), body[skip:]))
    return out


PIECES = "key bigint, chunk_index int, total_chunks_in_section int, start int, core int, end int, text string"


def split_sections(sections: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """(key, chunk_index, total_chunks_in_section, start, core, end, text) of (key, text). Each text is cut in one task; no shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"]):
                pieces = split_text(text, cfg)
                rows += [(key, i, len(pieces), p.start, p.core, p.end, p.text) for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "total_chunks_in_section", "start", "core", "end", "text"])

    return sections.select("key", "text").where("text is not null").mapInPandas(run, PIECES)
