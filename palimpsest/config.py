"""Fixed values of the data model, one dataclass per group."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values.
STAGES = ("staging", "active", "consolidated", "fading", "archived")
MEMORY_CLASSES = ("canonical", "working", "ephemeral", "structural")
EDGE_TYPES = ("hebbian", "connection", "causal", "temporal", "invalidation", "bridge")
TASK_STATUSES = ("open", "in_progress", "blocked", "done")
PRIORITIES = ("urgent", "high", "medium", "low")


@dataclass(frozen=True)
class Mode:
    """Retrieval preset."""

    text: float
    temporal: float
    decay: float
    gate: float
    beam: int
    hop: float


MODES = {
    "targeted": Mode(0.75, 0.25, 0.6, 0.8, 3, 0.2),
    "exploratory": Mode(0.4, 0.6, 0.3, 0.3, 20, 0.4),
    "balanced": Mode(0.6, 0.4, 0.5, 0.5, 15, 0.3),
}


@dataclass(frozen=True)
class AgentConfig:
    """Thresholds of one agent."""

    salience_threshold: float = 0.4
    staging_threshold: float = 0.2
    staging_ttl_hours: int = 24
    max_active: int = 10_000
    max_staging: int = 1_000
    edges_per_memory: int = 20
    edge_half_life_days: float = 7.0
    connect_threshold: float = 0.7
    feedback_plus: float = 0.05
    feedback_minus: float = 0.1


@dataclass(frozen=True)
class RecallConfig:
    limit: int = 10
    min_score: float = 0.01
    mode: str = "balanced"
    abstain: float = 0.0
    strict_inner_limit: bool = False
    include_stages: tuple[str, ...] = ("active", "fading")
    include_retracted: bool = False
    memory_type: str | None = None
    #: With no reranker every reranker score is 0, which sends pools of three or more through the weak-evidence branch.
    weak_pool_penalty: bool = False
    #: A clear winner in a small pool is not reranked.
    rerank_skip: bool = True
    #: Recalls of a lower confidence return nothing.
    require_confidence: float = 0.0
    #: Candidates whose tags name an entity of the query are raised.
    query_bridge: bool = False


@dataclass(frozen=True)
class ConsolidationConfig:
    cluster_similarity: float = 0.65
    complete_link: float = 0.50
    edge_signal: float = 0.5
    new_edge_weight: float = 0.3
    max_new_edges: int = 50
    max_bridges: int = 20
    bridge_similarity: float = 0.15
    prune_below: float = 0.01
    homeostasis: float = 10.0
    grace_days: float = 7
    archive_days: float = 30
    delete_days: float = 90
    redundancy_similarity: float = 0.75
    redundancy_cap: int = 25
    fade_days: float = 45
    fade_chars: int = 150
    fade_min_chars: int = 250
    fade_cap: int = 25
    fade_max_access: int = 10
    drift_cap: float = 0.03
    synthesis_cap: int = 5
    synthesis_min: int = 3


@dataclass(frozen=True)
class SalienceWeights:
    surprise: float = 0.15
    decision: float = 0.15
    causal_depth: float = 0.15
    effort: float = 0.1
    novelty: float = 0.45
    bonus: dict = field(default_factory=lambda: {"decision": 0.15, "friction": 0.2, "surprise": 0.25, "causal": 0.2, "user_feedback": 0.3})
