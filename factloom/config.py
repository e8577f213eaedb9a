"""Tunables of scoring, links and promotion, in one frozen value. Only the balanced profile exists."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # The defaults of the balanced profile.
    decay: float = 0.3
    w_semantic: float = 0.5
    w_importance: float = 0.7
    scope_multiplier: float = 1.5
    rrf_k: int = 60
    w_activation: float = 0.92
    w_keyword: float = 0.08
    keyword_limit: int = 50
    gravity: float = 0.6
    hub_penalty: float = 0.3
    resolution: float = 1.25
    learning_rate: float = 0.12
    homeostasis: float = 0.7
    link_decay: float = 0.95
    exploration_alpha: float = 0.45
    exploration_rounds: int = 20
    exploration_boost: float = 0.2
    promotion_ttl: float = 600.0
    gauge_chars: int = 10_000
    top_k: int = 8
    diversity_penalty: float = 0.35
    duplicate_similarity: float = 0.95
    duplicate_overlap: float = 0.4
    contradiction: float = 0.12

    @classmethod
    def profile(cls, name: str = "balanced") -> "Config":
        if name != "balanced":
            raise ValueError(f"unknown profile: {name}")
        return cls()
