"""Configuration: the nearest TOML file with the section, checked; driver side only."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from hazardlens.functions.scoring import resolve_weights
from hazardlens.operators.coverage import POLICIES

SECTION = "hazardlens"


class ConfigError(ValueError):
    """A value that can't be used; the command line ends with status 2."""


@dataclass
class Config:
    new_above: float = 50.0
    regression_above: float = 5.0
    component_above: float = 15.0
    existing_above: float | None = None
    churn_days: int = 90
    missing_coverage: str = "pessimistic"
    weights: dict[str, float] = field(default_factory=resolve_weights)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    coverage: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    salt: str | None = None
    unknown: list[str] = field(default_factory=list)


def prefix(value: object, group: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"group {group}: a prefix must be text")
    p = value.replace("\\", "/").strip().removeprefix("./")
    p = "/".join(x for x in p.split("/") if x not in ("", ".")) or "."
    if p == ".." or p.startswith("../"):
        raise ConfigError(f"group {group}: a prefix must stay below the root")
    return p


def parse(raw: dict) -> Config:
    """Checks a section. Unknown keys are listed, not fatal; bad values raise ``ConfigError``."""
    c = Config(unknown=sorted(set(raw) - set(Config.__dataclass_fields__)))
    for key in ("new_above", "regression_above", "component_above", "existing_above"):
        if key in raw:
            v = raw[key]
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
                raise ConfigError(f"{key} must be a number of 0 or more")
            setattr(c, key, float(v))
    if "churn_days" in raw:
        if isinstance(raw["churn_days"], bool) or not isinstance(raw["churn_days"], int) or raw["churn_days"] < 1:
            raise ConfigError("churn_days must be a whole number of 1 or more")
        c.churn_days = raw["churn_days"]
    if raw.get("missing_coverage", c.missing_coverage) not in POLICIES:
        raise ConfigError(f"missing_coverage must be one of {', '.join(POLICIES)}")
    c.missing_coverage = raw.get("missing_coverage", c.missing_coverage)
    try:
        c.weights = resolve_weights(raw.get("weights"))
    except ValueError as e:
        raise ConfigError(str(e)) from e
    for name, values in raw.get("groups", {}).items():
        values = [values] if isinstance(values, str) else values
        if not name.strip() or not isinstance(values, list) or not values:
            raise ConfigError(f"group {name} needs a prefix or a list of them")
        c.groups[name] = tuple(prefix(v, name) for v in values)
    for key in ("exclude", "allow"):
        v = raw.get(key, [])
        if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
            raise ConfigError(f"{key} must be a list of globs")
        setattr(c, key, v)
    c.coverage = {str(k): str(v) for k, v in raw.get("coverage", {}).items()}
    c.salt = raw.get("salt")
    return c


def find(start: Path) -> tuple[Config, Path | None]:
    """The nearest pyproject.toml at or above ``start`` that has ``[tool.hazardlens]``; defaults if none has."""
    for folder in (start, *start.parents):
        file = folder / "pyproject.toml"
        if file.is_file():
            try:
                tool = tomllib.loads(file.read_text("utf-8")).get("tool", {})
            except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                raise ConfigError(f"{file}: {e}") from e
            if SECTION in tool:
                return parse(tool[SECTION]), folder
    return Config(), None
