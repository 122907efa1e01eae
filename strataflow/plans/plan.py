"""A run as a value: sections with defaults, read from TOML; unknown keys are errors, missing ones take defaults."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Zones:
    span: int = 12
    overlap: int = 2


@dataclass(frozen=True)
class Matching:
    max_ratio: float = 0.8
    max_angle: float = 0.7
    min_inliers: int = 15


@dataclass(frozen=True)
class Sparse:
    min_images_per_track: int = 3
    intra_image_distance: float = 10.0
    max_reprojection_error: float = 4.0


@dataclass(frozen=True)
class Live:
    policy: str = "append_only"
    replay_window: int = 8


@dataclass(frozen=True)
class Plan:
    zones: Zones = field(default_factory=Zones)
    matching: Matching = field(default_factory=Matching)
    sparse: Sparse = field(default_factory=Sparse)
    live: Live = field(default_factory=Live)

    def problems(self) -> list[str]:
        """What makes this plan unusable."""
        out = []
        if self.zones.span < 1 or not 0 <= self.zones.overlap < self.zones.span:
            out.append("zones: span must be positive and overlap smaller than it")
        if not 0 < self.matching.max_ratio <= 1:
            out.append("matching: max_ratio must be in (0, 1]")
        if self.live.policy not in ("append_only", "replay_window", "invalidate_zones", "strict"):
            out.append(f"live: unknown policy {self.live.policy}")
        return out


def _build(kind, values: dict, at: str):
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(values) - set(known)):
        raise ValueError(f"unknown key {at}{extra[0]}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        made[name] = _build(type(default), value, f"{at}{name}.") if is_dataclass(default) else type(default)(value)
    return kind(**made)


def parse(text: str) -> Plan:
    plan = _build(Plan, tomllib.loads(text), "")
    if problems := plan.problems():
        raise ValueError("; ".join(problems))
    return plan


def to_toml(plan: Plan) -> str:
    out = []
    for section, values in asdict(plan).items():
        out.append(f"[{section}]")
        out += [f'{k} = "{v}"' if isinstance(v, str) else f"{k} = {v}" for k, v in values.items()]
    return "\n".join(out) + "\n"
