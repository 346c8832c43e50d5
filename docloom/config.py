"""Settings of a run, checked when they are loaded."""

from __future__ import annotations

import difflib
import json
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Chunking:
    max_tokens: int = 900
    min_tokens: int = 60
    dedup_threshold: float = 0.85


@dataclass
class Generation:
    tasks: list[str] = field(default_factory=lambda: ["qa", "multihop", "multiturn"])
    qa_per_chunk: int = 3
    multihop_pairs: int = 8
    cross_document_pairs: int = 6
    persona_share: float = 0.3
    preference_share: float = 0.4
    evolve_share: float = 0.0


@dataclass
class Verification:
    samples: int = 0
    symbolic: bool = True
    allow_python: bool = False


@dataclass
class Selection:
    min_quality: float = 0.55
    lexical_threshold: float = 0.8
    semantic_threshold: float = 0.92
    balance: bool = True


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    generation: Generation = field(default_factory=Generation)
    selection: Selection = field(default_factory=Selection)
    verification: Verification = field(default_factory=Verification)
    formats: list[str] = field(default_factory=lambda: ["chatml", "sharegpt", "dpo", "raw"])
    plugins: list[str] = field(default_factory=list)
    against: list[str] = field(default_factory=list)
    cache: str = ""
    seed: int = 7
    token_budget: int = 0

    def validate(self) -> "Config":
        c, g, s = self.chunking, self.generation, self.selection
        checks = {
            "chunking.max_tokens must be above chunking.min_tokens": c.max_tokens > c.min_tokens > 0,
            "thresholds must lie between 0 and 1": all(0 < t <= 1 for t in (c.dedup_threshold, s.lexical_threshold, s.semantic_threshold)),
            "shares must lie between 0 and 1": all(0 <= t <= 1 for t in (g.persona_share, g.preference_share, g.evolve_share, s.min_quality)),
            "counts must be positive": g.qa_per_chunk > 0 and g.multihop_pairs >= 0 and g.cross_document_pairs >= 0,
        }
        wrong = [text for text, ok in checks.items() if not ok]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def build(kind: type, data: dict, where: str = "") -> object:
    """A settings object from nested dictionaries; an unknown key is refused with the nearest known one."""
    known = {f.name: f for f in fields(kind)}
    made = kind()
    for key, value in data.items():
        if key not in known:
            near = difflib.get_close_matches(key, known, 1)
            raise ValueError(f"unknown setting {where}{key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        part = getattr(made, key)
        if isinstance(part, (Chunking, Generation, Selection, Verification)):
            value = build(type(part), value, f"{key}.")
        setattr(made, key, value)
    return made


def load(path: str | None = None) -> Config:
    if not path:
        return Config().validate()
    with open(path, encoding="utf-8") as file:
        return build(Config, json.load(file)).validate()


def dump(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)
