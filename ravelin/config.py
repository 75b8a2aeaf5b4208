"""Settings of the engine with their bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace


def positive_int(value: str | None, default: int) -> int:
    """A whole number above 0 from a setting's text, else the default."""
    try:
        number = int((value or "").strip())
    except ValueError:
        return default
    return number if number > 0 else default


def whole_int(value: str | None, default: int) -> int:
    """A whole number of 0 or more from a setting's text, else the default."""
    try:
        number = int((value or "").strip())
    except ValueError:
        return default
    return number if number >= 0 else default


def seconds(value: str | None, default: float) -> float:
    """A finite number of 0 or more from a setting's text, else the default."""
    try:
        number = float((value or "").strip())
    except ValueError:
        return default
    return number if 0 <= number < float("inf") else default


def switch(value: str | None, default: bool) -> bool:
    """Yes or no from a setting's text, else the default."""
    text = (value or "").strip().lower()
    return True if text in ("1", "true", "yes", "on") else False if text in ("0", "false", "no", "off") else default


@dataclass(frozen=True)
class EngineConfig:
    """Values outside their bounds are moved to the bound."""

    top_k: int = 6
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    embedding_dim: int = 384
    graph_degree: int = 3
    crawl_depth: int = 1
    crawl_pages: int = 5
    crawl_chars: int = 20_000
    crawl_rate_sec: float = 1.0
    bare_references: bool = True
    paste_bytes: int = 5 * 1024 * 1024
    ask_bytes: int = 1024 * 1024
    provider: str = "stub"
    embedding: str = "auto"
    allow_urls: bool = False
    model_timeout_sec: float = 20.0

    def __post_init__(self) -> None:
        low = {"top_k": 1, "chunk_tokens": 1, "chunk_overlap": 0, "crawl_depth": 0, "crawl_pages": 0, "crawl_chars": 1000, "crawl_rate_sec": 0}
        for name, least in low.items():
            object.__setattr__(self, name, max(least, getattr(self, name)))

    @property
    def window(self) -> tuple[int, int]:
        """Size and overlap of chunks; an overlap of 0 is unset, one that reaches the size is halved."""
        size, overlap = self.chunk_tokens, self.chunk_overlap or 64
        return size, overlap if overlap < size else size // 2

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> EngineConfig:
        """RAVELIN_TOP_K and the like; blank or invalid values keep the default."""
        base = cls()
        told = lambda name: env.get(f"RAVELIN_{name.upper()}")
        kinds = {
            positive_int: ("top_k", "chunk_tokens", "embedding_dim", "crawl_chars", "paste_bytes", "ask_bytes", "graph_degree"),
            whole_int: ("chunk_overlap", "crawl_depth", "crawl_pages"),
            seconds: ("crawl_rate_sec", "model_timeout_sec"),
            switch: ("allow_urls", "bare_references"),
        }
        given = {name: read(told(name), getattr(base, name)) for read, names in kinds.items() for name in names}
        names = {name: (told(name) or getattr(base, name)).strip().lower() for name in ("provider", "embedding")}
        return replace(base, **given, **names)


def split_list(text: str | None) -> list[str]:
    """Parts of a comma-separated setting without blanks."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]
