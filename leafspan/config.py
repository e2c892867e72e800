"""Settings: defaults, then a mapping, then named options; unknown names are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    model: str = ""
    provider: str = ""
    toc_check_pages: int = 20
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 20000
    heading_scan_lines: int = 250
    pages_per_window: int = 20
    part_chars: int = 30000
    summary_chars: int = 4000
    reuse_context: bool = True
    max_turns: int = 15


def as_bool(raw: str) -> bool:
    return raw.strip().lower() in {"1", "true", "yes", "on"}


def settings(given: Mapping | None = None, models: Mapping[str, str] | None = None, **options) -> Settings:
    """``options`` win over ``given``, both over defaults; a provider's model stands in for a model that is not named."""
    values = dict(given or {}) | {k: v for k, v in options.items() if v is not None}
    unknown = set(values) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = replace(Settings(), **values)
    if not out.model and models and out.provider in models:
        out = replace(out, model=models[out.provider])
    return out


def resolved(value, name: str, default):
    """A value, else the environment variable of that name read as the default's type, else the default."""
    if value is not None:
        return value
    raw = os.environ.get(name)
    if raw is None:
        return default
    if isinstance(default, bool):
        return as_bool(raw)
    try:
        return type(default)(raw)
    except ValueError:
        return default
