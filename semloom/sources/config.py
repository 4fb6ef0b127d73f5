"""Settings from TOML, JSON and, where its reader is installed, YAML files."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any


def load(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    match path.suffix.lower():
        case ".toml":
            return tomllib.loads(path.read_text())
        case ".json":
            return json.loads(path.read_text())
        case ".yaml" | ".yml":
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path.name}: no YAML reader is installed; use TOML or JSON") from e
            return yaml.safe_load(path.read_text()) or {}
    raise ValueError(f"{path.name}: settings are TOML, JSON or YAML")


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones, tables merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def modalities(config: dict[str, Any]) -> dict[str, str]:
    """Column -> modality of a dataset's settings; columns not named are text."""
    return {c: d.get("modality", "text") for c, d in config.get("columns", {}).items()}
