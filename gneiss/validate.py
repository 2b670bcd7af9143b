"""Checks of requests on the driver."""

from __future__ import annotations

import os
import re

from gneiss.functions import fixed

_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def query(text: str | None, most: int = fixed.MAX_QUERY) -> str:
    """The query without control characters, cut to most characters and stripped; blank ones raise ValueError."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("empty query")
    return _CONTROLS.sub("", text[:most]).strip()


def language(name: str | None) -> str | None:
    clean = re.sub("[^a-zA-Z0-9_-]", "", name or "").lower()
    return clean if clean in fixed.REQUEST_LANGUAGES else None


def strict_query(text: str | None, most: int = fixed.MAX_STRICT_QUERY) -> str:
    """The stripped query; blank, longer ones and any control character raise ValueError."""
    text = (text or "").strip()
    if not text or len(text) > most or any(ord(c) < 32 for c in text):
        raise ValueError(f"a query has 1 to {most} characters and no control characters")
    return text


def language_name(name: str | None, known: list[str] | None = None) -> str:
    """The stripped name; other characters than letters, digits and . _ + -, and with known unknown names, raise ValueError."""
    name = (name or "").strip()
    if not re.fullmatch(r"[a-zA-Z0-9._+-]+", name) or (known and name not in known):
        raise ValueError("bad language")
    return name


def body_size(size: int | None, most: int = fixed.MAX_FILE_BYTES) -> None:
    if size and size > most:
        raise ValueError("request body too large")


def request(values: dict) -> dict:
    """A search request with its limits checked and defaults filled in: query, language, limit and per_repo."""
    text = values.get("query")
    if not isinstance(text, str) or not 1 <= len(text) <= fixed.MAX_QUERY:
        raise ValueError(f"query must have 1 to {fixed.MAX_QUERY} characters")
    limits = {"limit": number(values.get("limit", 10), 1, 100, "limit"), "per_repo": number(values.get("per_repo", 5), 1, 50, "per_repo")}
    return values | limits


def number(value, low: int, high: int, what: str) -> int:
    if isinstance(value, bool) or not re.fullmatch(r"-?\d+", str(value)) or not low <= int(value) <= high:
        raise ValueError(f"{what} must be from {low} to {high}")
    return int(value)


def limit(value) -> int:
    return number(value, 1, 10_000, "limit")


def port(value) -> int:
    return number(value, 1, 65_535, "port")


def repo_id(value) -> int:
    return number(value, 1, (1 << 63) - 1, "repo_id")


def host(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?", value or "") or ".." in value:
        raise ValueError("bad host")
    return value


def path(value: str, allowed: list[str] | None = None, must_exist: bool = True) -> str:
    """The real path; too long ones, parent steps and, with allowed, paths outside its folders raise ValueError."""
    if not value or len(value) > fixed.MAX_PATH or ".." in value.split("/") or "\0" in value:
        raise ValueError("bad path")
    real = os.path.realpath(os.path.expanduser(value))
    if allowed and not any(real == r or real.startswith(r + os.sep) for r in (os.path.realpath(os.path.expanduser(a)) for a in allowed)):
        raise ValueError("path outside the allowed folders")
    if must_exist and not os.path.exists(real):
        raise ValueError("no such path")
    return real


def directory(value: str, allowed: list[str] | None = None) -> str:
    if not os.path.isdir(found := path(value, allowed)):
        raise ValueError("not a folder")
    return found


def file(value: str, most_bytes: int = fixed.MAX_FILE_BYTES) -> str:
    if not os.path.isfile(found := path(value)):
        raise ValueError("not a file")
    if os.path.getsize(found) > most_bytes:
        raise ValueError("file too large")
    return found


def settings(values: dict, rules: dict) -> dict[str, str]:
    """Messages by key of values that a rule (a function that raises ValueError) refuses; keys without a rule pass."""
    wrong = {}
    for key, rule in rules.items():
        if key in values:
            try:
                rule(values[key])
            except ValueError as e:
                wrong[key] = str(e)
    return wrong


def startup(found) -> dict[str, str]:
    """Messages by key of Settings that an engine can't start with."""

    def share(value) -> None:
        if not isinstance(value, int | float) or not 0 <= value <= 1:
            raise ValueError("must be from 0 to 1")

    rules = {
        "limit": limit,
        "bm25_weight": share,
        "semantic_weight": share,
        "min_score": share,
        "embedding_size": lambda v: number(v, 1, 65_536, "embedding_size"),
        "requests_per_minute": lambda v: number(v, 1, 1_000_000, "requests_per_minute"),
        "chunk_limit": lambda v: v is None or number(v, 1, (1 << 63) - 1, "chunk_limit"),
        "index_path": lambda v: path(v, must_exist=False) if "://" not in v else v,
    }
    return settings({k: v for k, v in vars(found).items() if k != "sources"}, rules)
