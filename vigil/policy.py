"""Thresholds of the supervisory policy; plans turn them into literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    rapid_closure_s: int = 180
    thin_note_chars: int = 20
    sla_s: dict[str, int] = field(default_factory=lambda: {"CRITICAL": 900, "HIGH": 3600, "MEDIUM": 14400, "LOW": 43200})
    sla_band: float = 0.9
    boundary_hours: int = 48
    min_peers: int = 8
    shrink_k: float = 10.0
    ramp_z0: float = 2.0
    ramp_z1: float = 5.0
    full_confidence_n: int = 30
    fdr_q: float = 0.05
    family_cap: float = 0.60
    tiers: tuple[float, float, float] = (0.75, 0.50, 0.25)
    dq_weights: dict[str, float] = field(default_factory=lambda: {"completeness": 0.25, "validity": 0.20, "timeliness": 0.15, "consistency": 0.15, "uniqueness": 0.15, "mapping": 0.10})
    similarity: float = 0.82
    dts_floor: float = 0.20
    min_measurable: float = 0.50


DEFAULT = Policy()
