"""Numbers and durations as people write them."""

from __future__ import annotations

import re

# The multipliers of the suffixes.
SIZES = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}
SECONDS = {"": 1, "s": 1, "m": 60, "h": 3_600, "d": 86_400}


def _parsed(text: str, units: dict[str, int]) -> float:
    m = re.fullmatch(r"\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*([a-zA-Z]?)\s*", text)
    if not m or m[2].lower() not in units:
        raise ValueError(f"not a number with a suffix of {', '.join(u for u in units if u)}: {text!r}")
    return float(m[1]) * units[m[2].lower()]


def size(text: str) -> int:
    """10k, 2.5M, 1G; rounded to the nearest, halves down."""
    return int(_parsed(text, SIZES) + 0.499)


def seconds(text: str) -> float:
    """30m, 2h, 1d."""
    return _parsed(text, SECONDS)
