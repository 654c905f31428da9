"""Constants and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# How far a node's score falls with each kind of step away from the surface.
SYNONYM, HYPERNYM, ANTONYM = 0.99, 0.7, 0.8
# What a differing feature costs a matched phrase that is not the head.
PENALTY = {"fuzoku": 1.0, "case": 0.3, "kanou": 0.8, "sonnkei": 1.0, "ukemi": 0.3, "shieki": 0.3, "negation": 0.3, "semicontentword": 0.8}
#: Nodes below it aren't registered.
THRESHOLD = 0.5
#: A phrase with so many ambiguous morphemes or more keeps its first reading.
MAX_AMBIGUOUS = 5
#: Larger groups of synonyms are dropped.
MAX_GROUP = 40
#: What the smallest number of children starts from.
CHILD_NUM = 10
#: Retrieval: weights of a dependency and of a query that is no description; saturation and length norm of term weights.
DEPENDENCY_WEIGHT, QUERY_WEIGHT = 0.5, {"DESCRIPTION": 1.0, "OTHER": 0.5}
K1, B = 2.0, 0.75


@dataclass(frozen=True)
class NodeOptions:
    """Which nodes are registered."""

    hypernyms: bool = True
    recursive: bool = False
    antonyms: bool = True
    max_hyponyms: int | None = None
    threshold: float = THRESHOLD
    provenance: bool = False
    inside_entries: bool = True


@dataclass(frozen=True)
class MatchOptions:
    """Which node pairs may match."""

    coordinate: bool = False
    max_hyponyms: int | None = None
    same_particles: bool = False


@dataclass(frozen=True)
class BuildOptions:
    """How sentences and lexicons become trees."""

    exclude_semi_content: bool = False
    generalise_numbers: bool = False
    adjective_stems: bool = True
    content_word_ids: bool = False
    compat: bool = False


@dataclass(frozen=True)
class EngineConfig:
    """All options of an engine."""

    nodes: NodeOptions = field(default_factory=NodeOptions)
    match: MatchOptions = field(default_factory=MatchOptions)
    build: BuildOptions = field(default_factory=BuildOptions)
    max_patterns: int = 10
