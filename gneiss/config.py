"""Layered settings: command line over environment over file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import get_args, get_type_hints


@dataclass
class Settings:
    index_path: str = "index"
    limit: int = 10
    bm25_weight: float = 0.5
    semantic_weight: float = 0.5
    min_score: float = 0.01
    chunk_limit: int | None = None
    embedding_size: int = 64
    requests_per_minute: int = 60
    #: Where each value came from.
    sources: dict[str, str] = field(default_factory=dict, compare=False)


def _typed(name: str, value):
    """value as the field's annotation says; a text that is no number stays one, for the checks to find. An empty text is None where that is allowed."""
    kinds = [get_type_hints(Settings)[name], *get_args(get_type_hints(Settings)[name])]
    if isinstance(value, str) and type(None) in kinds and not value.strip():
        return None
    for kind in (int, float):
        if isinstance(value, str) and kind in kinds:
            try:
                return kind(value)
            except ValueError:
                return value
    return value


def load(path: str | None = None, prefix: str = "GNEISS_", environ: dict[str, str] | None = None, **given) -> Settings:
    """Settings from given (None: not given), then environment variables, then a JSON file, then defaults."""
    environ = os.environ if environ is None else environ
    layers = [("given", {k: v for k, v in given.items() if v is not None}), ("environment", {f.name: environ[prefix + f.name.upper()] for f in fields(Settings) if prefix + f.name.upper() in environ})]
    if path and os.path.exists(path):
        with open(path) as f:
            layers.append(("file", json.load(f)))
    out = Settings()
    for f in fields(Settings):
        if f.name == "sources":
            continue
        for source, values in layers:
            if f.name in values:
                setattr(out, f.name, _typed(f.name, values[f.name]))
                out.sources[f.name] = source
                break
        else:
            out.sources[f.name] = "default"
    return out


def conflicts(path: str, prefix: str = "GNEISS_", environ: dict[str, str] | None = None) -> dict[str, tuple]:
    """Keys that file and environment set to different values."""
    environ = os.environ if environ is None else environ
    with open(path) as f:
        own = json.load(f)
    both = {k: (v, _typed(k, environ[prefix + k.upper()])) for k, v in own.items() if prefix + k.upper() in environ}
    return {k: v for k, v in both.items() if v[0] != v[1]}
