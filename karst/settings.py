"""Engine settings with bounds, from keyword arguments, the environment or a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from functools import lru_cache


def _f(default, low=None, high=None):
    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Settings:
    """Unknown names are ignored on load; values out of bounds are an error."""

    # Models: one provider and model for planning, selection and answers; a fixed embedder and judge.
    llm_provider: str = "recorded"
    llm_model: str = "recorded"
    embedding_model: str = "recorded"
    planner_max_output_tokens: int = _f(3000, 128, 16000)
    reranker_max_output_tokens: int = _f(2000, 128, 16000)
    generator_max_output_tokens: int = _f(3000, 128, 32000)
    verify_abstain: bool = True
    abstain_verify_confidence: float = _f(0.80, 0.0, 1.0)
    embedding_batch_size: int = _f(32, 1, 256)
    reranker_candidate_limit: int = _f(12, 5, 30)
    reranker_total_char_budget: int = _f(12000, 4000, 50000)
    reranker_article_char_limit: int = _f(2500, 800, 10000)
    # Concept search and fusion.
    vector_candidates: int = _f(40, 1, 200)
    bm25_candidates: int = _f(40, 1, 200)
    concept_top_k: int = _f(16, 1, 50)
    rrf_k: int = _f(60, 1, 1000)
    semantic_weight: float = _f(0.35, 0.0, 1.0)
    lexical_weight: float = _f(0.25, 0.0, 1.0)
    hint_weight: float = _f(0.25, 0.0, 1.0)
    specificity_weight: float = _f(0.15, 0.0, 1.0)
    seed_count: int = _f(4, 1, 12)
    seed_min_score: float = _f(0.28, 0.0, 1.0)
    seed_relative_threshold: float = _f(0.70, 0.0, 1.0)
    # Traversal and ranking.
    max_hops: int = _f(2, 1, 3)
    paths_per_article: int = _f(5, 1, 20)
    hop_decay: float = _f(0.72, 0.1, 1.0)
    issue_article_candidates: int = _f(8, 1, 20)
    article_top_k: int = _f(5, 1, 10)
    article_graph_weight: float = _f(0.75, 0.0, 1.0)
    article_relevance_weight: float = _f(0.25, 0.0, 1.0)
    # Graph.
    namespace: str = "http://example.org/law#"
    article_count: int = _f(142, 1, None)
    node_table: str = "nodes"
    edge_table: str = "edges"

    def __post_init__(self) -> None:
        for f in fields(self):
            value, low, high = getattr(self, f.name), f.metadata.get("low"), f.metadata.get("high")
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"{f.name}={value!r} is not within [{low}, {high}]")

    @classmethod
    def load(cls, env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
        found: dict[str, str] = {}
        if os.path.isfile(env_file):
            with open(env_file, encoding="utf-8") as lines:
                for line in lines:
                    name, sep, value = line.strip().partition("=")
                    if sep and not name.startswith("#"):
                        found[name.strip().lower()] = value.strip().strip("'\"")
        found |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
        values = {}
        for f in fields(cls):
            if f.name in found:
                raw = found[f.name]
                kind = type(f.default)
                values[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**values)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """The settings of this process."""
    return Settings.load()
