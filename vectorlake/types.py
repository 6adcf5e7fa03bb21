"""Metrics, index kinds, configurations and errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


class EngineError(Exception):
    """Base of all errors of the engine."""


class DimensionMismatch(EngineError, ValueError):
    pass


class InvalidFilter(EngineError, ValueError):
    pass


class InvalidConfig(EngineError, ValueError):
    pass


class NotFound(EngineError, KeyError):
    pass


class ConcurrentWrite(EngineError):
    """Another writer changed the collection first; nothing was written."""


class AlreadyExists(EngineError):
    pass


# fixed values: accepted metric names
METRICS = {
    "l2": "l2",
    "euclidean": "l2",
    "cosine": "cosine",
    "dot": "dot",
    "dot_product": "dot",
    "ip": "dot",
    "inner_product": "dot",
}
INDEX_KINDS = ("flat", "hnsw", "ivf", "grid")
EPSILON = 1.1920929e-7  # of single precision


def metric(name: str) -> str:
    """Canonical metric name (M5)."""
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise InvalidConfig(f"unknown metric {name!r}") from None


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42


@dataclass(frozen=True)
class IvfConfig:
    nlist: int = 64
    nprobe: int = 8
    pq_m: int | None = None
    seed: int = 42
    memory_bound: bool = False

    def with_pq(self, m: int) -> IvfConfig:
        return IvfConfig(self.nlist, self.nprobe, m, self.seed, True)


@dataclass(frozen=True)
class GridConfig:
    outer_grid: tuple[int, int] = (16, 16)
    max_layers: int = 3
    pitch_ratio: float = 0.5
    projection_seed: int = 42
    ef_search: int = 128
    hybrid_rerank_pool: int = 3
    coarse_keep_per_column: int = 32
    touch_budget: int | None = None
    touch_budget_frac: float = 0.5
    use_centroid_graph: bool = True
    graph_degree: int = 8
    graph_beam_hops: int = 3
    beam_radius: int = 2
    fallback_max_rings: int = 8
    fallback_max_columns: int = 96
    conditional_fallback: bool = True
    fallback_score_gap: float = 2.0
    max_column_height_ratio: float = 4.0
    decay_half_life_ms: int = 3_600_000
    hot_threshold: float = 0.5
    cold_threshold: float = 0.05


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: str = "cosine"
    index: str = "hnsw"
    hnsw: HnswConfig = field(default_factory=HnswConfig)
    ivf: IvfConfig = field(default_factory=IvfConfig)
    grid: GridConfig = field(default_factory=GridConfig)

    def __post_init__(self):
        object.__setattr__(self, "metric", metric(self.metric))
        if self.index not in INDEX_KINDS:
            raise InvalidConfig(f"unknown index {self.index!r}")
        if self.dimension < 1:
            raise InvalidConfig("the dimension must be positive")

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> CollectionConfig:
        """Missing keys get their defaults."""

        def part(kind, value):
            known = {f.name for f in fields(kind)}
            value = {k: tuple(v) if isinstance(v, list) else v for k, v in (value or {}).items() if k in known}
            return kind(**value)

        return CollectionConfig(d["name"], d["dimension"], d.get("metric", "cosine"), d.get("index", "hnsw"), part(HnswConfig, d.get("hnsw")), part(IvfConfig, d.get("ivf")), part(GridConfig, d.get("grid")))
