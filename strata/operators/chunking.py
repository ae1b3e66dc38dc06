"""Chunks of sections: whole sentences packed up to a number of tokens, cut from the text as it stands.

A tokenizer gives the places of the tokens of a text; any script counts, and models bring their own. Chunks are slices of the original text, so
nothing is lost or respelled: every character besides blanks is in some chunk. A sentence of more than `chunk_tokens` tokens is packed in stretches of
`chunk_overlap` tokens, so that overlap is carried once, as between sentences.

Cases: null, empty and blank texts have no chunks. A text within the limit is one chunk. Repeated rows come out each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.ids import point_id
from strata.functions.text import ABBREVIATIONS, BREAK_AFTER, BREAK_BEFORE, TRAILING_TOKEN
from strata.settings import Settings

#: places (start, end) of the tokens of a text, in order
Tokenizer = Callable[[str], list[tuple[int, int]]]

_BLANK = " \t\n\r\f\v"
_CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_WORDS = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])\w){{1,20}}|[^\w{_BLANK}]")
_BREAK = re.compile(rf"{BREAK_AFTER}[{_BLANK}]+(?={BREAK_BEFORE})")
_TAIL = re.compile(TRAILING_TOKEN)


def words_and_signs() -> Tokenizer:
    """Stretches of up to 20 letters and digits, single characters of scripts without blanks, and single signs."""
    return lambda text: [m.span() for m in _WORDS.finditer(text)]


def public_tokenizer(path: str) -> Callable[[], Tokenizer]:
    """A tokenizer file in the JSON form of the `tokenizers` library."""

    def make() -> Tokenizer:
        from tokenizers import Tokenizer as Table

        table = Table.from_file(path)
        return lambda text: [(a, b) for a, b in table.encode(text, add_special_tokens=False).offsets if b > a]

    return make


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences; a stretch that ends in a shortened word or a single capital goes on."""
    out, start = [], 0
    for m in _BREAK.finditer(text):
        before = text[start : m.end()].rstrip(_BLANK)
        tail = _TAIL.search(before)
        if tail and (tail[1].lower() in ABBREVIATIONS or (len(tail[1]) == 1 and tail[1].isupper())):
            continue
        out.append((start, start + len(before)))
        start = m.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip(_BLANK)]


def units(text: str, tokenizer: Tokenizer, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of what is packed: sentences, and stretches of those that are too long by themselves."""
    out = []
    for a, b in sentences(text):
        places = tokenizer(text[a:b])
        if len(places) <= size:
            out.append((a, b, len(places)))
            continue
        step = overlap or size
        starts = [a, *[a + places[k][0] for k in range(step, len(places), step)]]
        out += [(x, y, min(step, len(places) - k * step)) for k, (x, y) in enumerate(zip(starts, [*starts[1:], b]))]
    return out


def pack(counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the units of each chunk: greedy, with a tail of whole units worth at least `overlap` tokens carried over. A chunk exceeds `size` only by a carried tail, as published."""
    out: list[tuple[int, int]] = []
    first, held = 0, 0
    for i, n in enumerate(counts):
        if i > first and held + n > size:
            out.append((first, i))
            tail, j = 0, i
            while overlap > 0 and j > first and tail < overlap:
                j -= 1
                tail += counts[j]
            first, held = j, tail
        held += n
    if first < len(counts):
        out.append((first, len(counts)))
    return out


def chunk_places(text: str, tokenizer: Tokenizer, size: int, overlap: int) -> list[tuple[int, int]]:
    """Places of the chunks of a text that begins and ends without blanks."""
    parts = units(text, tokenizer, size, overlap) if text else []
    return [(parts[a][0], parts[b - 1][1]) for a, b in pack([n for _, _, n in parts], size, overlap)]


def chunk_text(text: str | None, tokenizer: Tokenizer, size: int, overlap: int) -> list[str]:
    text = (text or "").strip(_BLANK)
    return [text[a:b].strip(_BLANK) for a, b in chunk_places(text, tokenizer, size, overlap)]


def chunk_sections(sections: DataFrame, cfg: Settings = Settings(), tokenizer: Callable[[], Tokenizer] = words_and_signs) -> DataFrame:
    """One row per chunk of (filing_id, item, text, ...) with chunk_index, total_chunks_in_section and point_id. Sections are packed where they lie: no shuffle."""
    size, overlap = cfg.chunk_tokens, cfg.chunk_overlap
    keep = [c for c in sections.columns if c not in ("text", "chunk_index", "total_chunks_in_section", "point_id")]
    schema = T.StructType([*sections.select(*keep).schema.fields, T.StructField("total_chunks_in_section", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = tokenizer()
        for pdf in it:
            chunks = [chunk_text(t, places, size, overlap) for t in pdf["text"]]
            out = pdf[keep].assign(total_chunks_in_section=[len(c) for c in chunks], chunk_index=[list(range(len(c))) for c in chunks], text=chunks).explode(["chunk_index", "text"])
            yield out[out["text"].notna()].astype({"total_chunks_in_section": "int32", "chunk_index": "int32"})

    cut = sections.select(*keep, "text").where(F.col("text").isNotNull()).mapInPandas(run, schema)
    return cut.withColumn("point_id", point_id(F.col("filing_id"), F.col("item"), F.col("chunk_index")))


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens with stride max(1, size - overlap); the first that reaches the end is the last."""
    stride = max(1, size - overlap)
    n = F.size(tokens)
    starts = F.when(n <= size, F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), n - size + ((F.lit(stride) - (n - size) % stride) % stride), F.lit(stride)))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))
