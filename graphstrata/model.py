"""Identifiers, rows, configuration and errors of the graph index."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

FORMAT_VERSION = 1
NODE_SCHEMA = "id string, kind string, label string, seq long"
EDGE_SCHEMA = "id string, src string, dst string, kind string, seq long"


class GraphIndexError(Exception):
    """Base of all errors raised here."""


class DanglingEdgeError(GraphIndexError):
    def __init__(self, node_id: str, line: int | None = None):
        super().__init__(f"edge refers to unknown node {node_id}" + (f" (line {line})" if line else ""))
        self.node_id, self.line = node_id, line


class ParseError(GraphIndexError):
    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


class GmlParseError(ParseError):
    pass


class EdgeListParseError(ParseError):
    pass


class CorruptionError(GraphIndexError):
    pass


class UnsupportedFormatError(GraphIndexError):
    pass


class DuplicateNodeError(GraphIndexError):
    pass


class DuplicateEdgeError(GraphIndexError):
    pass


class ConflictError(GraphIndexError):
    """Another writer's snapshot came first."""


def new_id() -> str:
    """A time-ordered UUID of version 7, in canonical text."""
    raw = bytearray((time.time_ns() // 1_000_000).to_bytes(6, "big") + os.urandom(10))
    raw[6] = raw[6] & 0x0F | 0x70
    raw[8] = raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


def is_v7(text: str) -> bool:
    try:
        return uuid.UUID(text).version == 7
    except ValueError:
        return False


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    label: str | None = None

    @classmethod
    def fresh(cls, kind: str, label: str | None = None) -> Node:
        return cls(new_id(), kind, label)


@dataclass(frozen=True)
class Edge:
    id: str
    src: str
    dst: str
    kind: str

    @classmethod
    def fresh(cls, src: str, dst: str, kind: str) -> Edge:
        return cls(new_id(), src, dst, kind)


class HubKind(Enum):
    DEGREE = "degree"
    BETWEENNESS = "betweenness"
    DEGREE_AND_BETWEENNESS = "degree_and_betweenness"


@dataclass(frozen=True)
class IndexConfig:
    hub_fraction: float = 0.10
    hubs: HubKind = HubKind.DEGREE_AND_BETWEENNESS
    samples: int | None = 256  #: None: every node
    sample_seed: int = 42
    k_hop: int = 3
    seed: int = 42


@dataclass(frozen=True)
class BuildStats:
    nodes: int
    clusters: int
    regions: int
    hubs: int
    seconds: dict[str, float] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class ClusterDrift:
    generation: int
    delta_inserts: int


@dataclass(frozen=True)
class DriftReport:
    clusters: dict[int, ClusterDrift]

    @property
    def cluster_count(self) -> int:
        return len(self.clusters)

    @property
    def total_inserts(self) -> int:
        return sum(d.delta_inserts for d in self.clusters.values())


class MaintenanceAction(Enum):
    DO_NOTHING = "do_nothing"


@dataclass(frozen=True)
class MaintenanceReport:
    actions_taken: list[MaintenanceAction]


class MaintenancePolicy(Protocol):
    def decide(self, report: DriftReport) -> list[MaintenanceAction]: ...


class NeverRebalance:
    def decide(self, report: DriftReport) -> list[MaintenanceAction]:
        return []
