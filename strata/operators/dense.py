"""Vectors: a built-in encoder, and cosine top-k of a set of query vectors against all rows as one vectorised scan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.lexical import scoped, top, with_scope
from strata.operators.topn import TopN, scope_masks
from strata.session import query_blocks
from strata.settings import Settings


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def search(corpus: DataFrame, queries: DataFrame, n: int | None = None, cfg: Settings = Settings(), exclude_sparse: bool = True, exclude_by_reference: bool = True) -> DataFrame:
    """(query_id, key, score, rank) for corpus (key, embedding, scope columns) and queries (query_id, query_vector and optional q_ ones).

    Filters come before the vectors are read. Each task keeps its n best rows per query over all its batches, so what is shuffled doesn't grow with the
    corpus' rows per task. Null vectors match nothing; a vector of zeros has cosine 0 with everything.
    """
    n = n or cfg.dense_candidates
    asked = with_scope(queries).where("query_vector is not null").select("query_id", "query_vector", "q_ticker", "q_year", "q_section")
    kind = dict(queries.dtypes)["query_id"]
    out = None
    for block in query_blocks(asked):
        pool = scoped(corpus.where(F.col("embedding").isNotNull()), block, exclude_sparse=exclude_sparse, exclude_by_reference=exclude_by_reference)
        found = _scan(pool, block, n, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], f"query_id {kind}, key bigint, score double")
    return top(out, n)


def _scan(pool: DataFrame, rows: list, n: int, kind: str) -> DataFrame:
    block = pool.sparkSession.sparkContext.broadcast((
        [r["query_id"] for r in rows], unit(np.array([r["query_vector"] for r in rows], dtype=np.float64)),
        [(r["q_ticker"], r["q_year"], r["q_section"]) for r in rows],
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, scopes = block.value
        best = TopN(len(ids), n)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                columns = {c: np.array(batch.column(c).to_pylist(), dtype=object) for c in ("ticker", "year", "section")}
                best.add(batch.column("key").to_numpy(zero_copy_only=False), unit(flat.reshape(batch.num_rows, -1)) @ vectors.T, scope_masks(columns, scopes))
        yield pa.RecordBatch.from_pandas(best.frame(ids), schema=schema, preserve_index=False)

    schema = pa.schema([("query_id", pa.string() if kind == "string" else pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    return pool.select("key", "ticker", "year", "section", "embedding").mapInArrow(run, f"query_id {kind}, key bigint, score double")


Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dim: int = 64) -> Encoder:
    """Deterministic stand-in where no model is at hand: signed counts of hashed words (a dimension and a sign from the words' MD5), not scaled."""
    places: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in places:
            h = hashlib.md5(word.encode()).digest()
            places[word] = int.from_bytes(h[:2], "big") % dim, 1.0 if h[2] & 128 else -1.0
        return places[word]

    def encode(texts: list[str]) -> np.ndarray:
        lists = pa.array([t.lower() for t in texts], pa.string())
        words = pa.compute.split_pattern_regex(pa.compute.replace_substring_regex(lists, "[^a-z0-9]+", " "), " ")
        flat = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(words).to_numpy(zero_copy_only=False))
        at = np.array([place(w) if w else (0, 0.0) for w in flat.dictionary.to_pylist()]).reshape(-1, 2)
        code = flat.indices.to_numpy(zero_copy_only=False)
        out = np.zeros((len(texts), dim))
        np.add.at(out, (row, at[code, 0].astype(np.int64)), at[code, 1])
        if len(places) > 1_000_000:
            places.clear()
        return out

    return encode


def embed(df: DataFrame, text: str, out: str, encoder: Callable[[], Encoder] = hashed_encoder, instruction: str = "", batch: int = 64) -> DataFrame:
    """Adds the vector of a text column. `encoder` makes the model once per worker; queries get the instruction, passages none. Null gives null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for s in it:
            parts = []
            for at in range(0, len(s), batch):
                piece = s.iloc[at : at + batch]
                vectors = model([instruction + (t or "") for t in piece]).astype(np.float32)
                parts += [None if t is None else v for t, v in zip(piece, vectors)]
            yield pd.Series(parts, index=s.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))
