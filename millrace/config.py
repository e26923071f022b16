"""Settings of the engine: one frozen value that is handed to operators and serialises with them."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class CacheSettings:
    fuzzy_threshold: float = 90.0
    min_confidence: float = 0.85


@dataclass(frozen=True)
class RetrievalSettings:
    bm25_top_k: int = 20
    dense_top_k: int = 20
    rerank_top_k: int = 10
    rrf_k: int = 60
    min_rerank_score: float = 0.20
    min_confidence: float = 0.50
    synthesis_top_k: int = 5
    synthesis_chunk_chars: int | None = None


@dataclass(frozen=True)
class GenerativeSettings:
    confidence: float = 0.60
    min_confidence: float = 0.0
    context_chars: int = 2000
    max_tokens: int = 512
    backend_order: tuple[str, ...] = ("primary", "secondary", "local")


@dataclass(frozen=True)
class Settings:
    cache: CacheSettings = field(default_factory=CacheSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    generative: GenerativeSettings = field(default_factory=GenerativeSettings)
    enabled_tiers: tuple[str, ...] = ("cache", "retrieval", "generative")
    kb_path: str = ""  #: the knowledge base that is searched


#: The tiers that can answer, in order, and the one for no answer.
TIERS = ("cache", "retrieval", "generative", "none")

#: Start of the names of environment variables that set single values, as MILLRACE__CACHE__FUZZY_THRESHOLD.
PREFIX = "MILLRACE__"


def _changed(value, given: Mapping):
    """A settings value with what is given in place of its own; unknown names are an error."""
    known = {f.name: getattr(value, f.name) for f in fields(value)}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")

    def one(old, new):
        if is_dataclass(old):
            return _changed(old, new)
        return tuple(new) if isinstance(old, tuple) else type(old)(new) if isinstance(old, (int, float)) and not isinstance(old, bool) else new

    return replace(value, **{k: one(known[k], v) for k, v in given.items()})


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """The settings of a JSON file, if one is named, and of environment variables, which outweigh it. Values in variables are JSON or text."""
    out = _changed(Settings(), json.loads(Path(path).read_text()) if path else {})
    for name, text in sorted((os.environ if env is None else env).items()):
        if name.startswith(PREFIX):
            try:
                value = json.loads(text)
            except ValueError:
                value = text
            for part in reversed(name[len(PREFIX) :].lower().split("__")):
                value = {part: value}
            out = _changed(out, value)
    return out


class Current:
    """The settings of a process, read once: ``get`` gives the same value until it is asked to read again."""

    def __init__(self, path: str | None = None, env: Mapping[str, str] | None = None):
        self.path, self.env, self.value = path, env, None

    def get(self, again: bool = False) -> Settings:
        if self.value is None or again:
            self.value = load(self.path, self.env)
        return self.value
