"""Parameters of the graph operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The relation vocabulary with the weight of each in propagation.
RELATION_BIAS = {
    "is_a": 1.0, "has_property": 0.8, "causes": 1.2, "caused_by": 1.1, "follows": 0.7, "precedes": 0.7, "contradicts": 0.3, "supports": 1.0,
    "associated_with": 0.5, "example_of": 0.9, "part_of": 0.8, "synonym": 1.0, "antonym": 0.4, "temporal_coincident": 0.6, "spatial_near": 0.5, "linguistic_maps": 0.7,
}
# Intents by number.
INTENTS = (
    "define", "assert_fact", "explain_cause", "explain_effect", "contrast", "compare", "list", "example",
    "conclude", "question", "uncertain", "clarify", "summarize", "elaborate", "transition", "emphasize",
)
# What an intent prefers, relation by relation; "default" for the others.
INTENT_BIAS = {
    0: {"is_a": 1.5, "has_property": 1.2, "example_of": 1.0, "default": 0.5},
    1: {"supports": 1.3, "causes": 1.2, "part_of": 1.0, "default": 0.6},
    2: {"causes": 1.8, "caused_by": 1.5, "follows": 1.2, "default": 0.4},
    3: {"causes": 1.6, "caused_by": 1.4, "precedes": 1.2, "default": 0.4},
    4: {"contradicts": 2.0, "antonym": 1.8, "associated_with": 0.8, "default": 0.3},
    5: {"synonym": 1.5, "associated_with": 1.2, "part_of": 1.0, "default": 0.5},
    6: {"part_of": 1.4, "has_property": 1.2, "example_of": 1.1, "default": 0.5},
    7: {"example_of": 2.0, "has_property": 1.2, "is_a": 1.0, "default": 0.4},
    8: {"supports": 1.5, "causes": 1.3, "part_of": 1.0, "default": 0.6},
    9: {"associated_with": 1.2, "part_of": 1.0, "default": 0.7},
    10: {"contradicts": 1.2, "supports": 0.8, "default": 0.5},
    11: {"associated_with": 1.3, "default": 0.7},
    12: {"part_of": 1.3, "supports": 1.1, "default": 0.6},
    13: {"has_property": 1.4, "part_of": 1.2, "default": 0.5},
    14: {"follows": 1.3, "precedes": 1.2, "default": 0.6},
    15: {"supports": 1.6, "causes": 1.4, "default": 0.5},
}
# Node types of the graph.
NODE_TYPES = ("Concept", "Entity", "TemporalAnchor", "LinguisticToken", "ContextLabel", "Pattern")


@dataclass(frozen=True)
class Resonance:
    dynamics: str = "wilson_cowan"  # or simple_diffusion, threshold
    normalization: str = "budget_soft_cap"  # or l1_norm, none
    gate: str = "top_k"  # or threshold, none
    edge_threshold: float = 0.02
    propagation_threshold: float = 0.008
    decay: float = 0.1
    top_k: int = 64
    steps: int = 4
    floor: float = 0.01
    ceiling: float = 1.0
    budget: float = 2.0
    gamma: float = 0.5
    frequency_scale: float = 20.0
    confidence_share: float = 0.4
    relation_bias: dict[str, float] = field(default_factory=lambda: dict(RELATION_BIAS))


@dataclass(frozen=True)
class Walk:
    max_steps: int = 5
    min_activation: float = 0.01
    temperature: float = 0.1
    softmax_temperature: float = 0.1
    gamma: float = 0.9


@dataclass(frozen=True)
class Learning:
    alpha: float = 0.05
    beta: float = 0.02
    gamma: float = 0.9
    temporal_strength: float = 0.5
    length_penalty: float = 0.0
    decay: float = 0.001
    min_strength: float = 0.01
    co_activation: int = 5
    contexts: int = 5
    sequence: int = 3
    contradiction: float = 0.3
    low_confidence: float = 0.4
