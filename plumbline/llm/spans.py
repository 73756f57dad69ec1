"""Spans of kinds inside texts, and the digests the contracts ask for."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end of every span by start, then kind as listed, comma-joined."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], place[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
