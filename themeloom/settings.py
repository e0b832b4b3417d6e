"""Parameters of an analysis, passed explicitly to every plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # analysis
    similarity_threshold: float = 0.7
    max_topics: int = 10
    topic_terms: int = 100
    article_terms: int = 200
    content_cap: int = 8000
    shown_themes: int = 20
    kept_quotes: int = 3
    # clustering
    n_clusters: int | None = None
    kmeans_seeds: tuple[int, ...] = tuple(range(42, 52))
    kmeans_max_iter: int = 300
    kmeans_tol: float = 1e-4
    # retrieval
    chunk_words: int = 1200
    chunk_overlap: int = 100
    embedding_dim: int = 64
    chunk_key_terms: int = 8
    neighbours: int = 10
    top_k: int = 20
    # how much of one group a single row may hold; larger groups are split
    block_rows: int = 1000
