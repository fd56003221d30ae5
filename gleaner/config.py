"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import yaml


@dataclass(frozen=True)
class RetrievalConfig:
    bm25_top_k: int = 50
    dense_top_k: int = 50
    hybrid_top_k: int = 50
    rerank_candidates: int = 30
    final_top_k: int = 10
    rrf_k: int = 60

    @property
    def candidate_k(self) -> int:
        """Both retrievers hand on as many rows as the greediest stage wants."""
        return max(self.bm25_top_k, self.dense_top_k, self.rerank_candidates)


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 900
    overlap: int = 120
    least: int = 180

    def __post_init__(self) -> None:
        if self.size < 200:
            raise ValueError("chunk size must be 200 or more")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be 0 or more and less than the chunk size")
        if not 1 <= self.least <= self.size:
            raise ValueError("the least chunk size must be between 1 and the chunk size")


@dataclass(frozen=True)
class AnswerConfig:
    max_evidence_chunks: int = 5
    max_evidence_characters: int = 6500
    excerpt_characters: int = 600


@dataclass(frozen=True)
class EvaluationConfig:
    recall_k: tuple[int, ...] = (5, 10, 20)
    mrr_k: int = 10
    ndcg_k: int = 10

    @property
    def deepest(self) -> int:
        return max(*self.recall_k, self.mrr_k, self.ndcg_k)


@dataclass(frozen=True)
class Config:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    bm25: Bm25Config = field(default_factory=Bm25Config)
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    answer: AnswerConfig = field(default_factory=AnswerConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)

    @staticmethod
    def read(path: str) -> Config:
        """Settings from a YAML file of sections (retrieval, bm25, chunks, generation, evaluation); what it leaves out keeps its default."""
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
        if not isinstance(found, dict):
            raise ValueError(f"{path} must hold sections")
        parts = {}
        for name, kind in (("retrieval", RetrievalConfig), ("bm25", Bm25Config), ("chunks", ChunkConfig), ("generation", AnswerConfig), ("evaluation", EvaluationConfig)):
            known = {f.name for f in fields(kind)}
            own = {k: tuple(v) if isinstance(v, list) else v for k, v in (found.get(name) or {}).items() if k in known}
            parts["answer" if name == "generation" else name] = kind(**own)
        return Config(**parts)
