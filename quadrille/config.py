"""Settings, as frozen dataclasses, and the checks across them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

SPLITS = ("train", "validation", "test")
HIGHER, LOWER = "higher", "lower"


class ConfigError(ValueError):
    """All that is wrong with a configuration, at once."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Grid:
    """Windows over an image; ``stride`` must divide what the window leaves free."""

    image_width: int = 256
    image_height: int = 256
    width: int = 64
    height: int = 64
    stride_x: int = 8
    stride_y: int = 8

    @property
    def columns(self) -> int:
        return (self.image_width - self.width) // self.stride_x + 1

    @property
    def rows(self) -> int:
        return (self.image_height - self.height) // self.stride_y + 1

    @property
    def windows(self) -> int:
        return self.columns * self.rows

    def errors(self, expected: tuple[int, int] | None = None) -> list[str]:
        out = []
        if min(self.image_width, self.image_height, self.width, self.height, self.stride_x, self.stride_y) <= 0:
            return ["grid sizes must be positive"]
        for name, image, window, stride in (
            ("width", self.image_width, self.width, self.stride_x),
            ("height", self.image_height, self.height, self.stride_y),
        ):
            if window > image:
                out.append(f"window {name} exceeds the image")
            elif (image - window) % stride:
                out.append(f"stride does not divide image minus window {name}")
        if expected and not out and (self.columns, self.rows) != expected:
            out.append(f"grid is {self.columns} x {self.rows}, expected {expected[0]} x {expected[1]}")
        return out


@dataclass(frozen=True)
class Feature:
    name: str
    direction: str = HIGHER
    enabled: bool = True
    weight: float = 1.0


@dataclass(frozen=True)
class Group:
    name: str
    members: dict[str, float]
    weight: float = 1.0


@dataclass(frozen=True)
class Fusion:
    groups: tuple[Group, ...]
    clip_min: float = 0.0
    clip_max: float = 1.0
    method: str = "grouped_weighted_mean"


@dataclass(frozen=True)
class Bounds:
    """How bounds are fitted: percentiles from 0 to 100, and the least span."""

    low: float = 1.0
    high: float = 99.0
    epsilon: float = 1e-8


@dataclass(frozen=True)
class Flags:
    """Limits of the suspicious flags."""

    constant_std: float = 1e-6
    low_std: float = 0.03
    high_std: float = 0.25
    low_score: float = 0.10
    high_score: float = 0.90
    most_low: float = 0.95
    most_high: float = 0.95
    most_zero: float = 0.20
    most_one: float = 0.20
    group_gap: float = 0.50
    peak: float = 0.35
    most_peaks: float = 0.01


@dataclass(frozen=True)
class Settings:
    grid: Grid = field(default_factory=Grid)
    features: tuple[Feature, ...] = ()
    fusion: Fusion = field(default_factory=lambda: Fusion(()))
    bounds: Bounds = field(default_factory=Bounds)
    flags: Flags = field(default_factory=Flags)
    color_mode: str = "rgb"
    channels: int = 3

    @property
    def enabled(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.features if f.enabled)


def fusion_errors(features: tuple[Feature, ...], fusion: Fusion) -> list[str]:
    """Each enabled feature stands in exactly one group, and no other does."""
    out = []
    if fusion.method != "grouped_weighted_mean":
        out.append(f"unknown fusion method {fusion.method!r}")
    members = [m for g in fusion.groups for m in g.members]
    known, enabled = {f.name for f in features}, {f.name for f in features if f.enabled}
    checks = (
        ("unknown features in groups", set(members) - known),
        ("disabled features in groups", set(members) & known - enabled),
        ("enabled features without a group", enabled - set(members)),
        ("features in several groups", {m for m in members if members.count(m) > 1}),
        ("groups without members", {g.name for g in fusion.groups if not g.members}),
        ("groups without positive weight", {g.name for g in fusion.groups if g.weight <= 0}),
        ("members without positive weight", {m for g in fusion.groups for m, w in g.members.items() if w <= 0}),
    )
    out += [f"{what}: {', '.join(sorted(names))}" for what, names in checks if names]
    return out


def threshold_candidates(start: float = 0.50, end: float = 0.66, step: float = 0.01) -> list[float]:
    """Thresholds from ``start`` to ``end``, rounded to ten places."""
    return [round(start + k * step, 10) for k in range(round((end - start) / step) + 1)]


def check(settings: Settings, expected_grid: tuple[int, int] | None = None) -> Settings:
    """``settings``, or a :class:`ConfigError` with everything that is wrong."""
    out = settings.grid.errors(expected_grid)
    b = settings.bounds
    if not 0 <= b.low < b.high <= 100:
        out.append("percentiles must satisfy 0 <= low < high <= 100")
    if b.epsilon <= 0:
        out.append("epsilon must be positive")
    if settings.fusion.clip_min >= settings.fusion.clip_max:
        out.append("clip_min must be under clip_max")
    if settings.color_mode not in ("rgb", "grayscale"):
        out.append(f"unknown color mode {settings.color_mode!r}")
    elif settings.channels != {"rgb": 3, "grayscale": 1}[settings.color_mode]:
        out.append("channels do not fit the color mode")
    if not settings.enabled:
        out.append("no feature is enabled")
    for f in settings.features:
        if f.direction not in (HIGHER, LOWER):
            out.append(f"unknown direction of {f.name}")
        if f.enabled and f.weight <= 0:
            out.append(f"weight of {f.name} must be positive")
    out += fusion_errors(settings.features, settings.fusion)
    if out:
        raise ConfigError(out)
    return settings


def resolve_path(path: str, root: str | Path) -> Path:
    """A path with variables and user expanded, absolute under ``root``."""
    full = os.path.expanduser(os.path.expandvars(path))
    if "${" in full or re.search(r"\$[A-Za-z_]", full):
        raise ValueError(f"unresolved variable in {path!r}")
    if os.name == "posix" and re.match(r"[A-Za-z]:[\\/]", full):
        raise ValueError(f"{path!r} is a path of another system")
    return Path(full) if os.path.isabs(full) else Path(root) / full


def load(path: str, root: str | None = None) -> Settings:
    """Settings from a YAML mapping with keys named like the dataclasses' fields."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}

    def expand(value):
        if isinstance(value, dict):
            return {k: expand(v) for k, v in value.items()}
        if isinstance(value, list):
            return [expand(v) for v in value]
        return os.path.expandvars(value) if isinstance(value, str) else value

    raw = expand(raw)
    try:
        return check(
            Settings(
                grid=Grid(**raw.get("grid", {})),
                features=tuple(Feature(**f) for f in raw.get("features", [])),
                fusion=Fusion(
                    tuple(Group(**g) for g in raw.get("fusion", {}).get("groups", [])),
                    **{k: v for k, v in raw.get("fusion", {}).items() if k != "groups"},
                ),
                bounds=Bounds(**raw.get("bounds", {})),
                flags=Flags(**raw.get("flags", {})),
                **{k: raw[k] for k in ("color_mode", "channels") if k in raw},
            ),
        )
    except TypeError as e:
        raise ConfigError([str(e)]) from e
