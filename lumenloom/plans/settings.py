"""Settings of retrieval and ingestion, passed explicitly; no operator reads globals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Ranking signals in the order that breaks ties between equal fused scores, with their default weights.
SIGNAL_WEIGHTS = {"bm25": 2.0, "text_cosine": 1.0, "image_cosine": 0.5, "graph": 0.3, "maxsim": 1.0, "hyde_cosine": 0.8, "recency": 0.4, "entity": 0.6}


@dataclass(frozen=True)
class Settings:
    # fusion
    rrf_k: int = 60
    weights: dict = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    signal_depth: int = 3
    rerank_candidates: int = 50
    rerank_diversity: float = 0.2
    rerank_multiplier: float = 2.0
    rerank_max: int = 200
    top_k: int = 10
    # bm25
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    # cosine
    funnel_dims: tuple[int, ...] = (128, 256, 768)
    funnel_widths: tuple[int, ...] = (4, 2, 1)
    # recency and corroboration
    half_life_days: float = 30.0
    corroboration_cap: float = 5.0
    dedup_increment: float = 0.3
    graph_increment: float = 1.0
    # entities and duplicates
    entity_threshold: float = 0.75
    entity_candidates: int = 5
    duplicate_threshold: float = 0.85
    novelty_threshold: float = 0.20
    # chunking
    paragraph_tokens: int = 400
    child_tokens: int = 200
    section_tokens: int = 500
    small_class_tokens: int = 500
    min_chunk_chars: int = 250
    min_content_chars: int = 50
    parent_child: bool = True
    # query complexity
    simple_words: int = 8
    complex_words: int = 15
    # multi-vector encodings
    fde_buckets: int = 20
    fde_seed: int = 42
    # graph
    max_graph_nodes: int = 400_000
    spectral_dims: int = 8
    power_iterations: int = 100

    def with_weights(self, overrides: dict[str, float]) -> Settings:
        return replace(self, weights={**self.weights, **overrides})
