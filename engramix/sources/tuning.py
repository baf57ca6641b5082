"""The four knobs and what they stand for."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass

KNOBS = {"retention": ("preserve", "prune"), "capacity": ("standard", "compact", "expansive"), "forgetting": ("natural", "slow", "fast"), "connections": ("incremental", "thorough")}
SIZES = {"compact": (150, 300, 1500), "standard": (250, 500, 2500), "expansive": (400, 800, 5000)}
PACE = {"slow": 2.0, "natural": 1.0, "fast": 0.5}


def checked(name: str, value: object) -> str:
    if name not in KNOBS:
        raise ValueError(f"no knob {name!r}; there are {', '.join(KNOBS)}")
    v = str(value).strip().lower()
    if v not in KNOBS[name]:
        raise ValueError(f"{name} can't be {value!r}; it is one of {', '.join(KNOBS[name])}")
    return v


def number(value: str | None, fallback: float) -> float:
    try:
        return float(value) if value is not None and value.strip() else fallback
    except ValueError:
        return fallback


def boolean(value: str | None, fallback: bool) -> bool:
    if value is None or not value.strip():
        return fallback
    return value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Tuning:
    target: int
    most: int
    tier2: int
    forget_multiplier: float
    tiered: bool
    incremental: bool

    @classmethod
    def resolve(cls, knobs: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None) -> Tuning:
        """Environment before knobs before defaults (the first value of each knob)."""
        env = os.environ if env is None else env
        k = {n: v[0] for n, v in KNOBS.items()} | {n: checked(n, v) for n, v in (knobs or {}).items()}
        target, most, tier2 = SIZES[k["capacity"]]
        return cls(
            int(number(env.get("MEMORY_ENTRY_TARGET"), target)), int(number(env.get("MEMORY_ENTRY_MAX"), most)), int(number(env.get("MEMORY_TIER2_MAX"), tier2)),
            number(env.get("MEMORY_FORGET_MULTIPLIER"), PACE[k["forgetting"]]), boolean(env.get("MEMORY_TIERED"), k["retention"] == "preserve"), boolean(env.get("MEMORY_INCREMENTAL"), k["connections"] == "incremental"),
        )


def read_knobs(path: str) -> dict[str, str]:
    """The saved knobs, checked; none if there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f).get("knobs", {})
    except FileNotFoundError:
        return {}
    return {n: checked(n, v) for n, v in found.items()}


def save_knob(path: str, name: str, value: object) -> dict[str, str]:
    """Check and save one knob; the file is replaced as a whole."""
    knobs = read_knobs(path) | {name: checked(name, value)}
    spare = f"{path}.{os.getpid()}"
    with open(spare, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "knobs": knobs}, f, indent=2)
    os.replace(spare, path)
    return knobs
