"""Settings of retrieval and chunking: profiles, checks, overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Zero, empty text and None in a request mean the value here."""

    candidate_pool: int = 50
    top_k: int = 10
    stitching_window: int = 5
    rrf_k: int = 60
    rerank: bool = True
    target_words: int = 350
    overlap_sentences: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    memory_turns: int = 4
    memory_chars: int = 400

    def __post_init__(self) -> None:
        for name in ("candidate_pool", "top_k", "rrf_k", "target_words", "memory_turns"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("stitching_window", "overlap_sentences", "memory_chars"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


#: The two profiles.
PROFILES = {
    "build": Settings(),
    "query": Settings(candidate_pool=20, top_k=6, stitching_window=2, rerank=False, target_words=400),
}
PREFIX = "SPARKQUARRY_"


def load(profile: str | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """A profile with overrides such as SPARKQUARRY_TOP_K; an unknown profile or a bad number is an error."""
    name = profile or env.get(PREFIX + "PROFILE") or "build"
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}; there are {sorted(PROFILES)}")
    settings, changed = PROFILES[name], {}
    for f in fields(Settings):
        raw = env.get(PREFIX + f.name.upper())
        if raw:
            kind = type(getattr(settings, f.name))
            try:
                changed[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
            except ValueError:
                raise ValueError(f"{PREFIX}{f.name.upper()} must be {kind.__name__}, not {raw!r}") from None
    return replace(settings, **changed)
