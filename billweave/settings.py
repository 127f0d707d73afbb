"""Settings from a nested mapping or JSON file, looked up by dotted names, overridden by the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

PREFIX = "BILLWEAVE_"


def dotted(values: Mapping[str, Any], name: str, default: Any = None) -> Any:
    """The value under ``a.b.c``; the default where a step is missing or no mapping."""
    for step in name.split("."):
        if not isinstance(values, Mapping) or step not in values:
            return default
        values = values[step]
    return values


class Settings:
    """Settings that an environment variable overrides: ``a.b`` is BILLWEAVE_A_B, read as the default's type."""

    def __init__(self, values: Mapping[str, Any] | str | Path, environment: Mapping[str, str] | None = None) -> None:
        self.values = json.loads(Path(values).read_text(encoding="utf-8")) if isinstance(values, (str, Path)) else values
        self.environment = os.environ if environment is None else environment

    def get(self, name: str, default: Any = None) -> Any:
        """The setting of a dotted name."""
        value = dotted(self.values, name, default)
        said = self.environment.get(PREFIX + name.upper().replace(".", "_"))
        if said is None:
            return value
        if isinstance(value, bool):
            return said.strip().lower() in ("1", "true", "yes", "on")
        return type(value)(said) if isinstance(value, (int, float)) else said
