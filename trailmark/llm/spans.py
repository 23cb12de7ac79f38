"""Spans of found text: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib


def render(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(render(spans, kinds).encode()).hexdigest()


def overlaps(spans: list[tuple[str, int, int]], a: int, b: int) -> bool:
    return any(s < b and a < e for _, s, e in spans)
