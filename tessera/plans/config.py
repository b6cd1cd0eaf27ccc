"""Settings, and the presets for common needs."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # Defaults of all settings.
    chunking: str = "parent_child"
    structure_max: int = 2000
    structure_min: int = 200
    structure_overlap: int = 100
    #: Short sections are kept by merging them; False drops them.
    keep_short: bool = True
    parent_max: int = 3000
    parent_min: int = 200
    parent_min_section: int = 120
    child_max: int = 800
    child_min: int = 150
    child_overlap: int = 80
    semantic_over: int = 1600
    semantic_spread: float = 0.15
    meaning_max: int = 1000
    meaning_min: int = 80
    meaning_threshold: float = 0.45
    meaning_percentile: int = 22
    meaning_overlap: int = 220
    meaning_window: int = 6
    level_sizes: tuple[int, ...] = (1024, 384, 128)
    sentence_size: int = 384
    sentence_overlap: int = 150
    clean: bool = True
    flatten: bool = True
    anchor: bool = True
    fix_encoding: bool = True
    mode: str = "fusion"
    weights: tuple[float, float] = (0.45, 0.55)
    hyde_weight: float = 0.85
    rrf_k: int = 40
    multipath_k: int = 60
    multipath_top: int = 100
    multipath_candidates: int = 50
    queries: int = 4
    recall: int = 200
    synonyms: int = 6
    routing: bool = True
    multi_expand: bool = True
    hyde: bool = True
    hyde_chars: int = 300
    points: bool = False
    rerank: bool = True
    rerank_top: int = 200
    neighbours: int = 1
    with_parents: bool = True
    answer_docs: int = 5
    answer_chars: int = 1000
    history: int = 5
    session_minutes: int = 60
    sessions: int = 1000


DEFAULT = Settings()
# What each preset changes.
PRESETS: dict[str, Settings] = {
    "high-precision": replace(DEFAULT, chunking="structure", mode="fusion_score", weights=(0.35, 0.65), queries=5, recall=50, synonyms=5, rerank_top=10),
    "high-speed": replace(DEFAULT, chunking="sentence", sentence_size=512, sentence_overlap=100, queries=3, recall=20, routing=False, rerank=False),
    "standard-docs": replace(DEFAULT, chunking="structure", mode="fusion_score", weights=(0.25, 0.75), queries=5, recall=50, rerank_top=8),
    "hierarchical": replace(DEFAULT, chunking="hierarchical", mode="fusion_score", weights=(0.35, 0.65), queries=5, recall=40, rerank_top=8),
    "recall-first": replace(DEFAULT, mode="fusion_score", weights=(0.3, 0.7), queries=5, recall=100, rerank_top=10),
    "precision-first": replace(DEFAULT, mode="fusion_score", weights=(0.35, 0.65), queries=5, recall=50, rerank_top=8),
    "service": replace(DEFAULT, recall=200, rerank_top=10, queries=3, hyde_chars=200),
}
