"""Driver-side settings: numbered credentials and checked configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


def numbered(env: Mapping[str, str], name: str) -> list[str]:
    """Values of NAME_1, NAME_2, ... in the order of their numbers; blank ones are skipped."""
    found = [(int(m[1]), v.strip()) for k, v in env.items() if (m := re.fullmatch(rf"{re.escape(name)}_(\d+)", k))]
    return [v for _, v in sorted(found) if v]


def consecutive(env: Mapping[str, str], name: str) -> list[str]:
    """Values of NAME_1, NAME_2, ... up to the first gap, or else NAME alone."""
    out = []
    while value := env.get(f"{name}_{len(out) + 1}", "").strip():
        out.append(value)
    return out or [v for v in [env.get(name, "").strip()] if v]


@dataclass
class Evaluation:
    models: list[str] = field(default_factory=list)
    datasets: str = ""
    negatives: int = 7
    seed: int = 42
    top_k: int = 10
    max_queries: int | None = None

    @property
    def run_tag(self) -> str:
        return f"neg{self.negatives}_seed{self.seed}"

    def checked(self) -> "Evaluation":
        if not self.models or not self.datasets:
            raise ValueError("models and datasets are needed")
        if self.negatives < 0 or self.top_k < 1 or (self.max_queries is not None and self.max_queries < 1):
            raise ValueError("numbers out of range")
        return self


def from_mapping(kind, given: Mapping):
    """A settings object from flat keys or sections of keys; unknown and repeated keys raise."""
    flat: dict = {}
    for key, value in given.items():
        part = value if isinstance(value, Mapping) else {key: value}
        for k, v in part.items():
            if k in flat:
                raise ValueError(f"{k} is given twice")
            flat[k] = v
    if unknown := set(flat) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    return kind(**flat)


class Registry:
    """Scorers by name and alias, in any case."""

    def __init__(self):
        self.known: dict = {}

    def add(self, name: str, make, *aliases: str):
        for n in (name, *aliases):
            self.known[n.strip().lower()] = (name, make)
        return make

    def get(self, name: str):
        try:
            return self.known[name.strip().lower()][1]
        except KeyError:
            raise KeyError(f"unknown scorer {name!r}; known: {', '.join(sorted({n for n, _ in self.known.values()}))}") from None
