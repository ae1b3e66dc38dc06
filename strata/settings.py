"""Tuning constants. Every one can be overridden per call; the defaults are the published ones."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 384
    query_instruction: str = "Represent this sentence for searching relevant passages: "
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    sparse_chars: int = 200
    single_sentence_chars: int = 600
    reference_window: int = 600
    top_k: int = 5
    dense_candidates: int = 50
    lexical_candidates: int = 50
    rrf_k: int = 60
    lexical_weight: float = 1.0
    rerank_candidates: int = 20
    quota_share: float = 0.5
    quota_pool_factor: int = 3
    relevance_floor: float = 0.3
    years: tuple[int, ...] = (2022, 2023, 2024)
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    tolerance: float = 0.005
    statement_scale: float = 1e6
    derive_limit: int = 60
    trivial_max: int = 12
    fuzzy_cutoff: float = 0.75
    symbol_chars: int = 5
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_env(prefix: str = "STRATA_", file: str | None = None) -> Settings:
        """Defaults overridden by environment variables such as STRATA_TOP_K, or by lines KEY=VALUE of a file; values already set in the environment win over the file's."""
        given: dict[str, str] = {}
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                for line in f:
                    key, mark, value = line.strip().partition("=")
                    if mark and not key.startswith("#"):
                        given[key.strip()] = value.strip().strip("'\"")
        given |= dict(os.environ)
        kinds = {"int": int, "float": float, "str": str}
        got = {n: kinds[f.type](given[prefix + n.upper()]) for n, f in Settings.__dataclass_fields__.items() if f.type in kinds and prefix + n.upper() in given}
        return Settings(**got)
