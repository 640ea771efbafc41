"""Settings of an engine run: plain objects, read from a mapping and checked."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Sizes of units and searches."""

    unit_size: int = 900
    unit_overlap: int = 150
    strategy: str = "legacy"
    target_size: int = 900
    hard_size: int = 1200
    top_k: int = 5
    candidates: int = 20
    context_budget: int = 4000

    def __post_init__(self):
        if self.strategy not in ("legacy", "clause"):
            raise ValueError(f"unknown strategy: {self.strategy}")
        if self.unit_size <= 0 or not 0 <= self.unit_overlap < self.unit_size:
            raise ValueError("unit_size must be positive and unit_overlap smaller")
        if self.target_size <= 0 or self.hard_size < self.target_size:
            raise ValueError("target_size must be positive and hard_size at least as large")
        if min(self.top_k, self.candidates, self.context_budget) <= 0:
            raise ValueError("top_k, candidates and context_budget must be positive")

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], prefix: str = "PAGELOOM_") -> EngineConfig:
        """Settings from environment-like values, e.g. PAGELOOM_TOP_K=7."""
        own = {f.name: values[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in values}
        return cls(**{k: v if k == "strategy" else int(v) for k, v in own.items()})

    @classmethod
    def from_file(cls, path: str) -> EngineConfig:
        """Settings from a JSON object; unknown names are an error."""
        value = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = set(value) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**value)


def differences(expected: Mapping[str, object], actual: Mapping[str, object]) -> list[str]:
    """Names whose values differ between two settings, all of them."""
    return [k for k in sorted({*expected, *actual}) if expected.get(k) != actual.get(k)]
