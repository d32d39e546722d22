"""Settings of the analyses: found above a target, read from JSON or TOML, checked before use."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields

ANALYSES = ("complexity", "deadcode", "clone", "cbo", "lcom", "deps")
NAMES = ("quarrel.json", ".quarrel.json", "quarrel.toml", ".quarrel.toml")
FORMATS, ORDERS, SEVERITIES = ("text", "json", "yaml", "csv", "html"), ("name", "complexity", "risk"), ("info", "warning", "critical")


@dataclass
class Settings:
    low: int = 9
    medium: int = 19
    max_complexity: int = 0  # no limit
    min_complexity: int = 1
    format: str = "text"
    sort_by: str = "name"
    min_severity: str = "info"
    include: list[str] = field(default_factory=lambda: ["**/*.js", "**/*.ts", "**/*.go"])
    exclude: list[str] = field(default_factory=list)
    clone_thresholds: tuple[float, float, float, float] = (0.85, 0.75, 0.7, 0.65)
    min_lines: int = 10
    min_nodes: int = 20
    use_bands: str = "auto"
    max_pairs: int = 10_000

    def risk(self, complexity: int) -> str:
        return "low" if complexity <= self.low else "medium" if complexity <= self.medium else "high"

    def problems(self) -> list[str]:
        """What is wrong with the values; nothing if they can be used."""
        steps = self.clone_thresholds
        rules = {
            "low must be 1 or more": self.low < 1,
            "medium must be above low": self.medium <= self.low,
            "max_complexity must be 0 or above medium": self.max_complexity < 0 or 0 < self.max_complexity <= self.medium,
            "min_complexity must be 1 or more": self.min_complexity < 1,
            f"format must be one of {', '.join(FORMATS)}": self.format not in FORMATS,
            f"sort_by must be one of {', '.join(ORDERS)}": self.sort_by not in ORDERS,
            f"min_severity must be one of {', '.join(SEVERITIES)}": self.min_severity not in SEVERITIES,
            "include must hold a pattern": not self.include,
            "clone_thresholds must fall from kind to kind, between 0 and 1": any(not 0 <= s <= 1 for s in steps) or any(a <= b for a, b in zip(steps, steps[1:], strict=False)),
            "min_lines and min_nodes must be 1 or more": min(self.min_lines, self.min_nodes) < 1,
            "use_bands must be on, off or auto": self.use_bands not in ("on", "off", "auto"),
            "max_pairs must be 0 or more": self.max_pairs < 0,
        }
        return [text for text, bad in rules.items() if bad]


def discover(target: str) -> str | None:
    """The settings file in the folder of target or the nearest above it."""
    at = os.path.abspath(target)
    at = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        for name in NAMES:
            if os.path.exists(path := os.path.join(at, name)):
                return path
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def load(path: str | None = None, target: str = ".") -> tuple[Settings, list[str]]:
    """Settings and the keys of the file that they do not know. Without a file the values are the default ones."""
    path = path or discover(target)
    if not path:
        return Settings(), []
    with open(path, "rb") as f:
        values = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    known = {x.name for x in fields(Settings)}
    settings = Settings(**{k: tuple(v) if k == "clone_thresholds" else v for k, v in values.items() if k in known})
    if wrong := settings.problems():
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return settings, sorted(set(values) - known)


def selected(names: list[str]) -> dict[str, bool]:
    """Which analyses run; an unknown name or none at all is an error."""
    if unknown := [n for n in names if n not in ANALYSES]:
        raise ValueError(f"no such analysis: {unknown[0]}; there are {', '.join(ANALYSES)}")
    if not names:
        raise ValueError("no analysis selected")
    return {n: n in names for n in ANALYSES}
