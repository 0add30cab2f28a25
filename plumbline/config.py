"""Thresholds and weights of the review analytics, one immutable value per rule."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BurstConfig:
    window: int = 30
    z: float = 3.5
    min_reviews: int = 3
    multiplier: float = 5.0


@dataclass(frozen=True)
class RatingShiftConfig:
    window: int = 3
    baseline: int = 30
    jsd: float = 0.05
    min_reviews: int = 5
    dominant: float = 0.7


@dataclass(frozen=True)
class SpecificityConfig:
    base: float = 50.0
    numbers: float = 12.0
    entities: float = 10.0
    wait: float = 10.0
    product: float = 10.0
    staff: float = 8.0
    narrative: float = 6.0
    long_text: float = 8.0
    generic: float = 18.0
    generic_cap: float = 15.0
    short_factor: float = 0.55


@dataclass(frozen=True)
class ExperienceConfig:
    log_scale: float = 3.0
    count: float = 0.35
    share: float = 0.40
    active: float = 0.15
    diversity: float = 0.10


@dataclass(frozen=True)
class FamiliarityConfig:
    log_scale: float = 2.5
    diversity: float = 0.40
    activity: float = 0.35
    duration: float = 0.25


@dataclass(frozen=True)
class RelevanceConfig:
    category: float = 0.30
    specificity: float = 0.25
    consistency: float = 0.15
    local: float = 0.15
    depth: float = 0.15


@dataclass(frozen=True)
class WeightConfig:
    specificity: float = 0.35
    category: float = 0.20
    relevance: float = 0.25
    recency: float = 0.20
    duplicate: float = 0.30
    templated: float = 0.25
    coordinated: float = 0.20
    neutral: float = 0.5
    rise: float = 2.0
    least: float = 0.25
    most: float = 2.0
    half_life: float = 365.0


@dataclass(frozen=True)
class CoordinatedConfig:
    volume: float = 0.30
    rating: float = 0.25
    semantic: float = 0.15
    duplicate: float = 0.08
    temporal: float = 0.10
    template: float = 0.07
    overlap: float = 0.05


@dataclass(frozen=True)
class TemplatedConfig:
    phrase: float = 0.30
    peers: float = 0.20
    structure: float = 0.15
    unspecific: float = 0.10
    detail: float = 0.10
    style: float = 0.10
    temporal: float = 0.05
    owners: int = 5
    rare: int = 2
    peer_similarity: float = 0.88


@dataclass(frozen=True)
class Config:
    burst: BurstConfig = field(default_factory=BurstConfig)
    shift: RatingShiftConfig = field(default_factory=RatingShiftConfig)
    specificity: SpecificityConfig = field(default_factory=SpecificityConfig)
    experience: ExperienceConfig = field(default_factory=ExperienceConfig)
    familiarity: FamiliarityConfig = field(default_factory=FamiliarityConfig)
    relevance: RelevanceConfig = field(default_factory=RelevanceConfig)
    weight: WeightConfig = field(default_factory=WeightConfig)
    coordinated: CoordinatedConfig = field(default_factory=CoordinatedConfig)
    templated: TemplatedConfig = field(default_factory=TemplatedConfig)


CONFIG = Config()
